"""How many Python workers the operators of the pipeline keep in an executor."""

import re

from pyspark import SparkContext
from pyspark.sql import functions as F

from skyweave.llm import common, jaccard, secret_scan


def chained(plan: str) -> bool:
    """Whether a Python step of a plan takes its rows from another one of the same task."""
    lines = [re.sub(r"^[ :+-]*", "", line) for line in plan.splitlines()]
    depth = [len(line) - len(re.sub(r"^[ :+-]*", "", line)) for line in plan.splitlines()]
    for k, line in enumerate(lines):
        if not line.startswith("MapIn"):
            continue
        for below, deeper in zip(lines[k + 1 :], depth[k + 1 :], strict=True):
            if deeper <= depth[k] or re.match(r"Repartition|Aggregate|Join|Window|Union|Relation|Generate", below):
                break
            if below.startswith("MapIn"):
                return True
    return False


def test_no_task_holds_two_workers_for_jaccard(spark, monkeypatch):
    plans = []
    written = common.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(common, "written", noted)
    monkeypatch.setattr(jaccard, "written", noted)
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{text} {k % 3}") for k in range(9)], "doc_id long, text string")
    found = jaccard.jaccard_groups(docs, slots=1 << 16, filter_bits=1 << 12).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(k, 0) for k in range(9)}
    assert any("MapInPandas" in plan for plan in plans) and not any(map(chained, plans))


def test_automata_grow_without_workers_of_a_second_kind(spark, monkeypatch):
    made, parallelize = [], SparkContext.parallelize
    rows = [(f"token = {'abcdefgh'[k % 8] * 3}{k * 7919:07d}{'xyz'[k % 3] * 4}",) for k in range(60)]
    texts = spark.createDataFrame(rows, "text string").withColumn("text", F.concat("text", F.lit(" ")))
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **b: made.append(a) or parallelize(self, *a, **b))
    named = []
    create = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: named.append(data) or create(self, data, *a, **b))
    assert secret_scan.learn(texts) is not None
    assert named and not made
