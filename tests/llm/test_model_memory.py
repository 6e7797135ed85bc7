"""What operator 5's executors hold: rows of blocks may have 1 MB, so few of them may be in a batch or a row group."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkContext

from skyweave.llm import language_model


def test_large_rows_move_in_small_pieces(spark, monkeypatch, tmp_path):
    def large_rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"b": [os.urandom(500_000) for _ in range(batch.num_rows)]})

    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    found = {}
    written = language_model.written

    def noted(df, name):
        if name not in found:
            folder = str(tmp_path / name)
            spark.range(0, 60, 1, 1).mapInArrow(large_rows, "b binary").write.parquet(folder)
            meta = [pq.ParquetFile(f"{folder}/{f}").metadata for f in os.listdir(folder) if f.endswith(".parquet")]
            groups = [m.row_group(k).total_byte_size for m in meta for k in range(m.num_row_groups)]
            sent = [r.n for r in spark.read.parquet(folder).coalesce(1).mapInArrow(batch_sizes, "n long").collect()]
            found[name] = max(groups), max(sent), sum(groups), sum(sent)
        return written(df, name)

    monkeypatch.setattr(language_model, "written", noted)
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in range(20)], "doc_id long, text string")
    before = {k: spark.conf.get(k, None) for k in language_model.LARGE_ROWS}
    language_model.score_texts(docs).collect()
    assert {"lm-tallies", "lm-seats", "lm-pairs", "lm-scores"} <= found.keys()
    for group, batch, all_groups, all_sent in found.values():
        assert min(all_groups, all_sent) >= 30_000_000 and group <= 10_000_000 and batch <= 6_000_000
    assert {k: spark.conf.get(k, None) for k in before} == before


def test_dishes_drawn_together_get_what_each_gets_alone():
    rng = np.random.default_rng(5)
    keys, customers, base, others = rng.integers(0, 1 << 62, 600), rng.integers(1, 90, 600), rng.random(600) * 0.2, rng.integers(0, 500, 600).astype(float)
    together = language_model.draw_tables(keys, 3, customers, base, others, 0.7, 1.0)
    alone = [language_model.draw_tables(keys[k : k + 1], 3, customers[k : k + 1], base[k : k + 1], others[k : k + 1], 0.7, 1.0)[0] for k in range(600)]
    assert (together == alone).all() and (together >= 1).all() and (together <= customers).all()
    assert set(c for low, high in language_model.BANDS for c in range(low, high + 1)) == set(range(2, language_model.EXACT + 1))


def test_places_of_words_in_any_order():
    names = np.array([5, -3, 9, 9, 1 << 62, 0, -(1 << 62)])
    assert language_model.place_of(names, np.array([-3, 0, 9])).tolist() == [-1, 0, 2, 2, -1, 1, -1]
    assert language_model.place_of(names[:0], np.array([1])).tolist() == []


def test_seats_start_no_workers_of_a_second_kind(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"a b c d{k}", k % 3 > 0) for k in range(20)], "doc_id long, text string, trains boolean")
    made, parallelize = [], SparkContext.parallelize
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **b: made.append(a) or parallelize(self, *a, **b))
    seats = language_model.seat(rows)
    assert not made
    assert seats.tokens > 0 and seats.pairs.count() > 0
