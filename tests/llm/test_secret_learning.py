"""All credentials and all other candidates of a table teach operator 4, whole; what follows a state is counted as loops count it."""

import collections
import math
import random
import string

import pytest

from skyweave.llm import secret_scan


def credentials(n, seed=0):
    rng = random.Random(seed)
    return ["AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16)) for _ in range(n)]


def test_every_distinct_string_teaches(spark, monkeypatch):
    rng = random.Random(5)
    own = credentials(1500)
    long = "AKIA" + "".join(rng.choices(string.ascii_uppercase, k=600))
    plain = sorted({"".join(rng.choices(["the", "ing", "er", "tion", "keit"], k=9)) for _ in range(23_000)} | {"ordinary" * 60})
    assert len(plain) > 21_000
    rows = [(f"see {v} here",) for v in [*own, own[0], long, *plain, plain[0]]]
    automata, pairs = [], []
    smoothed, pair_model = secret_scan.smoothed, secret_scan.pair_model
    monkeypatch.setattr(secret_scan, "smoothed", lambda step, counts, **k: automata.append(counts) or smoothed(step, counts, **k))
    monkeypatch.setattr(secret_scan, "pair_model", lambda counts: pairs.append(counts) or pair_model(counts))
    scorer = secret_scan.learn(spark.createDataFrame(rows, "text string").repartition(3))
    # once for all, and for each of five folds without it; each string stops once, and all its characters count
    stops = sorted(int(c[:, 128].sum()) for c in automata)
    assert stops[-1] == 1501 and len(stops) == 6 and sum(stops) == 1501 * 5
    assert max(c[:, :128].sum() for c in automata) == sum(map(len, [*own, long]))
    assert pairs[0][128].sum() == len(plain) and pairs[0][:, :128].sum() == sum(map(len, plain))
    assert scorer.formats(credentials(300, 1)).mean() >= 0.9 and scorer.formats(plain[:3000]).mean() <= 0.01


def test_states_grow_as_statistics_differ(spark):
    own = sorted(set(credentials(400)))
    rows = spark.createDataFrame([(1, k % 5, v) for k, v in enumerate(own)], "g int, fold int, value string").repartition(3)
    sizes = {(1, -1): len(own), (1, 2): sum(k % 5 != 2 for k in range(len(own)))}
    steps = secret_scan.grown(rows, sizes)
    for step in steps.values():
        state, seen = 0, []
        for c in "AKIA":
            state = step[state, ord(c)]
            seen.append(state)
        # each character of the beginning has a state of its own, after it any may follow again and again
        assert len({0, *seen}) == 5 and len(step) - 1 < 20
        assert (step[state][[ord(c) for c in string.ascii_uppercase + string.digits]] >= 0).all()
    # every string that a model learns from can be walked
    s = secret_scan.Symbols.of(own)
    assert (s.states(steps[1, -1]) >= 0).all()


@pytest.mark.parametrize("parts", [1, 4])
def test_what_follows_is_counted_whole(spark, parts):
    rng = random.Random(3)
    own = sorted({"".join(rng.choices("ab", k=rng.randint(12, 15))) for _ in range(200)} | {"a" * 2000, "a" * 1999 + "b"})
    rows = spark.createDataFrame([(1, 0, v) for v in own], "g int, fold int, value string").repartition(parts)
    found = secret_scan._followed(rows.mapInArrow(lambda it: secret_scan._tails(it, {(1, -1): None}), "g int, left int, edge long, path long, symbol int, n long"), 4).collect()
    want = collections.defaultdict(collections.Counter)
    for v in own:
        for k, c in enumerate([*v, None]):
            want[v[:k]][128 if c is None else ord(c)] += 1
    brute = collections.Counter(tuple(sorted(c.items())) for c in want.values() if sum(c.values()) > 4)
    assert collections.Counter(tuple(sorted(zip(r.symbols, r.counts, strict=True))) for r in found) == brute
    assert [r.n for r in found if r.path == 0] == [len(own)]


def test_counted_scores_are_those_of_the_list():
    rng = random.Random(4)
    values = [rng.choice([0.25, 1.5, 2.0, rng.random()]) for _ in range(101)]
    scores = secret_scan.Scores.of(values)
    own = sorted(values)
    for q in (0, 0.01, 0.25, 0.333, 0.75, 1):
        place = q * (len(own) - 1)
        low, high = own[math.floor(place)], own[math.ceil(place)]
        assert math.isclose(scores.quantile(q), low + (high - low) * (place - math.floor(place)))
    assert len(scores) == 101 and math.isclose(scores.std(), math.sqrt(sum((x - sum(own) / 101) ** 2 for x in own) / 101))
