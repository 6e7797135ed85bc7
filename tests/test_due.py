"""Batches that are due by count or age."""

import time

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyweave.operators import batches
from skyweave.streaming import jobs
from skyweave.streaming.due import batch_stream, due_batches, take

ID = "lsst_diaobject_diaobjectid"


@given(st.lists(st.integers(0, 12), max_size=8), st.integers(1, 7), st.integers(0, 10))
def test_take_is_a_queue_of_single_rows(counts, max_size, max_wait):
    """Against a plain queue with an entry for each row."""
    waiting = [(s, n) for s, n in enumerate(counts) if n]
    queue, now = [s for s, n in waiting for _ in range(n)], len(counts) + 2
    want = []
    while len(queue) >= max_size:
        want.append((max_size, "count", now - queue[0]))
        queue = queue[max_size:]
    if queue and now - queue[0] >= max_wait:
        want.append((len(queue), "age", now - queue[0]))
        queue = []
    left, due = take(waiting, now, max_size, max_wait, 5)
    assert [d[1:] for d in due] == want and [d[0] for d in due] == list(range(5, 5 + len(want)))
    assert [s for s, n in left for _ in range(n)] == queue


def land(spark, folder, n):
    spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).alias("x")).coalesce(1).write.mode("append").parquet(folder)


def until(done, seconds=60):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.3)
    assert done()


def test_count_age_and_restart(spark, tmp_path):
    """Seven rows by threes are two batches; the one left is due by age, though the query was stopped and started meanwhile and nothing came."""
    folder, seen = str(tmp_path / "in"), {}

    def keep(df, _):
        seen.update({r.batch: (r.n, r.by, r.waited) for r in df.collect()})

    def start():
        rows = spark.readStream.schema("x long").parquet(folder)
        return due_batches(rows, 3, 20).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()

    land(spark, folder, 7)
    query = start()
    until(lambda: len(seen) == 2)
    query.stop()
    assert {b: s[:2] for b, s in seen.items()} == {0: (3, "count"), 1: (3, "count")}
    query = start()
    until(lambda: len(seen) == 3)
    assert seen[2][:2] == (1, "age") and seen[2][2] >= 20
    land(spark, folder, 3)
    until(lambda: len(seen) == 4)
    query.stop()
    assert seen[3][:2] == (3, "count")


def test_batches_of_a_stream(spark, tmp_path, monkeypatch):
    """Four alerts by twos; the second batch dies while its alerts are queued and is taken up when the query starts again."""
    tables, checkpoint = str(tmp_path / "tables"), str(tmp_path / "cp")
    now = F.timestamp_seconds(F.lit(1_600_000_000))
    rows = spark.createDataFrame([(k, 10.0 * k, 1.0, None, "p") for k in range(1, 5)], f"{ID} long, ra_deg double, dec_deg double, lsst_diasource_diasourceid long, payload string")
    jobs.ingest_batch(rows.withColumn("event_time", now).withColumn("broker", F.lit("lasair")), tables, now)
    catalog = spark.createDataFrame([("c", str(k), 10.0 * k, 1.0) for k in (1, 2, 3)], "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double")
    real, runs = jobs.run_batch, []

    def dies(*args, **kwargs):
        """The second run stops, like its driver, after it has marked its alerts."""
        runs.append(1)
        if len(runs) == 2:
            jobs.alert_states(tables).append(batches.status_changes(jobs.alert_states(tables).current(spark, ["INGESTED"]), "QUEUED", now, 1))
            raise RuntimeError("died")
        return real(*args, **kwargs)

    monkeypatch.setattr(jobs, "run_batch", dies)
    start = lambda: batch_stream(spark, tables, [catalog], checkpoint, lambda: now, max_size=2)
    states = lambda: sorted(r.status for r in jobs.alert_states(tables).current(spark).select("status").collect())
    query = start()
    until(lambda: not query.isActive)
    assert "died" in str(query.exception()) and states() == ["MATCHED", "MATCHED", "QUEUED", "QUEUED"]
    query = start()
    until(lambda: states() == ["MATCHED"] * 4)
    query.stop()
    assert spark.read.parquet(f"{tables}/catalog_matches").count() == 3
