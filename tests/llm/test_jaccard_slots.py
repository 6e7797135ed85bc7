"""Slots of token counts grow with the texts, so that unlike sets don't meet."""

import random

from skyweave.llm import common, jaccard


def passages(n=400):
    """Unlike texts, each of which has a passage in common with the next one."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(10)] for _ in range(n + 1)]
    return [(k, " ".join([*shared[k], *(word() for _ in range(60)), *shared[k + 1]])) for k in range(n)] + [(n + k, " ".join(f"copy{w}" for w in range(50 - k))) for k in range(3)]


def test_slots_are_as_many_as_tokens():
    assert jaccard.slots_for(0) == jaccard.slots_for(125_000_000) == 1 << 28
    for n in (1_500_000_000, 7_500_000_000):
        assert n < jaccard.slots_for(n) <= 2 * n + 2
        assert jaccard.part_slots(jaccard.slots_for(n)) == jaccard.PART_SLOTS


def test_few_sets_meet_however_many_tokens_there_are(spark, monkeypatch):
    rows = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept, written = [], common.written

    def noted(df, name):
        out = written(df, name)
        if name == "jaccard-keepers":
            kept.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", noted)
    monkeypatch.setattr(jaccard, "LEAST_SLOTS", 1 << 13)
    monkeypatch.setattr(jaccard, "LOOKUP_TOKENS", 5_000)  # several readings of the files
    groups = lambda **options: {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, filter_bits=1 << 16, **options).collect()}
    found = groups()
    assert found == groups(slots=1 << 13) == {k: min(k, 400) if k < 400 else 400 for k, _ in rows}
    assert kept[0] < kept[1] / 4  # with fewer slots than tokens nearly all sets meet


def test_the_pipelines_stage_takes_as_many_slots_as_tokens(spark, monkeypatch):
    """Its stage passes no number of slots, so the one that its own texts ask for is taken."""
    import corpus_pipeline

    asked, slots_for = [], jaccard.slots_for
    monkeypatch.setattr(jaccard, "LEAST_SLOTS", 1 << 13)
    monkeypatch.setattr(jaccard, "slots_for", lambda n: asked.append((n, slots_for(n))) or asked[-1][1])
    rows = passages()
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in left.collect()} == set(range(401))
    assert [(slots >= n > 1 << 13) for n, slots in asked] == [True]
