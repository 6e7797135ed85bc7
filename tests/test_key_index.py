"""The key index: files that a micro-batch opens, and that nothing stored is taken for new."""

import numpy as np
from pyspark.sql import functions as F

from skyweave.operators import ingest
from skyweave.sources import key_index
from skyweave.streaming import jobs

ID = "lsst_diaobject_diaobjectid"


def table(spark, tmp_path, name="h", partition_by=None):
    """Ten files: four whose ids grow from file to file, and six whose ids lie over the whole range."""
    path = str(tmp_path / name)
    for k in range(10):
        step, base = (1, k * 1000) if k < 4 else (7, k)
        rows = spark.range(500).select((F.col("id") * step * 8 + base).alias(ID), F.lit("b").alias("broker"), F.lit(k % 2).alias("half")).coalesce(1)
        writer = rows.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return key_index.KeyIndex(path, str(tmp_path / f"{name}-index"), ID, f"{ID} long, broker string, half int")


def test_filters_never_lose_a_key():
    rng = np.random.default_rng(0)
    stored = rng.integers(-(2**63), 2**63 - 1, 5000)
    bits = key_index.bloom(np.unique(stored))
    n = len(np.unique(stored))
    assert all(key_index.may_hold(bits, n, stored[k : k + 1]) for k in range(0, 5000, 50))
    assert not key_index.may_hold(bits, n, rng.integers(-(2**63), 2**63 - 1, 10_000)) and not key_index.may_hold(bits, n, stored[:0])


def test_files_that_a_batch_opens(spark, tmp_path):
    index = table(spark, tmp_path)
    batch = lambda *ids: spark.createDataFrame([(i,) for i in ids], f"{ID} long")
    assert len(index.files_for(spark, batch(10**9))) == 10  # nothing is indexed: all files may hold it
    assert index.update(spark) == 10 and index.update(spark) == 0
    assert index.files_for(spark, batch(10**9)) == [] and index.files_for(spark, batch()) == []
    assert index.files_for(spark, batch(1, 3)) == []  # inside ranges, in no file
    where = {i: [f for f in index._files(spark) if spark.read.parquet(f).where(F.col(ID) == i).count()] for i in (8, 1008, 5)}
    for i, names in where.items():
        assert names and sorted(index.files_for(spark, batch(i))) == sorted(names)
    # a file that came after the index was made is opened too, and what it holds isn't new
    spark.createDataFrame([(77_777, "b", 0)], index.schema).coalesce(1).write.mode("append").parquet(index.table)
    incoming = spark.createDataFrame([(77_777, "x"), (8, "x"), (3, "x"), (10**9, "x"), (None, "x")], f"{ID} long, broker string")
    assert len(index.files_for(spark, incoming)) == 1 + len(where[8])
    fresh = ingest.new_rows(index.history(spark, incoming), incoming, [ID], ["broker"], batch_rows=5)
    assert sorted(r[ID] or -1 for r in fresh.collect()) == [-1, 3, 10**9]


def test_more_keys_than_are_sent(spark, tmp_path, monkeypatch):
    index = table(spark, tmp_path, partition_by="half")
    index.update(spark)
    monkeypatch.setattr(key_index, "MOST_KEYS", 1)
    near = index.history(spark, spark.createDataFrame([(0,), (8,)], f"{ID} long"))
    assert near.where(f"{ID} = 8").count() and near.select("half").distinct().count() == 2
    assert index.files_for(spark, spark.createDataFrame([(10**9,), (10**9 + 1,)], f"{ID} long")) == []


def test_jobs_use_it(spark, tmp_path):
    tables, now = str(tmp_path / "tables"), F.lit("2024-01-01").cast("timestamp")

    def ingested(*ids):
        rows = spark.createDataFrame([(k, 1.0, 1.0, None, "p") for k in ids], f"{ID} long, ra_deg double, dec_deg double, lsst_diasource_diasourceid long, payload string")
        jobs.ingest_batch(rows.withColumn("event_time", now).withColumn("broker", F.lit("lasair")), tables, now)

    for k in range(4):
        ingested(*range(100 * k, 100 * k + 5))
    jobs.compact_states(spark, tables)
    index = jobs.key_index(tables, "alerts")
    assert len(index.files_for(spark, spark.createDataFrame([(102,)], f"{ID} long"))) == 1
    ingested(102, 103, 999)
    ingested(999, 0)
    ids = [r[0] for r in spark.read.parquet(f"{tables}/alerts").select(ID).collect()]
    assert sorted(ids) == sorted([*(100 * k + j for k in range(4) for j in range(5)), 999])
    assert spark.read.parquet(f"{tables}/alert_deliveries").count() == 21
