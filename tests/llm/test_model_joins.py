"""What operator 5 moves: pairs of listed words take their values where they are."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyweave.llm import language_model


def test_pairs_of_listed_words_are_not_joined(spark, monkeypatch):
    plans = {}
    written = language_model.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return written(df, name)

    monkeypatch.setattr(language_model, "written", noted)
    rows = spark.createDataFrame([(k, f"a b c a{k % 7} b a b") for k in range(60)], "doc_id long, text string").withColumn("trains", F.col("doc_id") % 5 != 0)
    assert language_model.seat(rows).hot.count() > 0
    for name in ("lm-pairs", "lm-hot-pairs"):
        plan = plans[name]
        depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
        at = next(k for k, line in enumerate(plan) if "MapInArrow" in line)
        below = []
        for line, d in zip(plan[at + 1 :], depth[at + 1 :], strict=True):
            if d <= depth[at]:
                break
            below.append(line)
        assert below and not any("Join" in line for line in below)


def test_texts_meet_pairs_in_blocks(spark, monkeypatch):
    """Neither counting nor scoring joins or groups a row for each pair, and the turns of the texts change no score."""
    plans, sizes = {}, {}
    written = language_model.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        found = written(df, name)
        sizes[name] = found.count()
        return found

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j * j + j) % 97}" for j in range(300)) + f" own{k} own{k}x") for k in range(40)], "doc_id long, text string")
    one = {r.doc_id: (r.n_known, r.base_score, r.score) for r in language_model.score_texts(docs, turns=1).collect()}
    monkeypatch.setattr(language_model, "written", noted)
    three = {r.doc_id: (r.n_known, r.base_score, r.score) for r in language_model.score_texts(docs, turns=3).collect()}
    assert one.keys() == three.keys() and all(three[k] == pytest.approx(one[k], rel=1e-12) for k in one)
    for name in ("lm-tallies", "lm-seats", "lm-pairs", "lm-scores"):
        assert "MapInArrow" in plans[name] and "Join" not in plans[name] and "Aggregate" not in plans[name]
    assert sizes["lm-pairs"] <= 2 * 8  # two kinds of each place, for thousands of pairs


def test_digests_tell_words_apart():
    words = [f"{a}{k}" for a in ("", "a" * 7, "b" * 8, "c" * 63, "d" * 64, "e" * 65, "é") for k in range(3000)] + ["", "a", "a\0", "a\0\0"]
    found = language_model.digests(pa.array(words))
    assert len(np.unique(found)) == len(set(words)) and (language_model.digests(pa.array(words).slice(5, 9)) == found[5:14]).all()
