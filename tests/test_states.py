"""State tables, the jobs over them, locks and dead letters: what they read, and what a crash leaves."""

import json

import pytest
from pyspark.sql import functions as F

from skyweave.operators import batches
from skyweave.sources import files
from skyweave.streaming import jobs

ID = "lsst_diaobject_diaobjectid"


def at(second, day=1):
    return F.lit(f"2024-01-{day:02d} 00:00:{second:02d}").cast("timestamp")


def ingested(spark, tables, ids, day=1):
    rows = spark.createDataFrame([(k, 10.0 * k % 360, 1.0, None, "p") for k in ids], f"{ID} long, ra_deg double, dec_deg double, lsst_diasource_diasourceid long, payload string")
    jobs.ingest_batch(rows.withColumn("event_time", at(0)).withColumn("broker", F.lit("lasair")), tables, at(0, day))


def statuses(table, spark, **which):
    return {r[ID]: r.status for r in table.current(spark, **which).collect()}


def test_snapshots_and_changes_since(spark, tmp_path):
    tables = str(tmp_path)
    states = jobs.alert_states(tables)
    assert states.compact(spark) is None and states.current(spark).count() == 0
    ingested(spark, tables, [1, 2, 3])
    ingested(spark, tables, [4, 5], day=2)
    assert states.compact(spark) == 1
    assert statuses(states, spark) == dict.fromkeys([1, 2, 3, 4, 5], "INGESTED")
    some = states.current(spark).where(f"{ID} IN (1, 4)")
    states.append(batches.status_changes(some, "MATCHED", at(5), 2))
    assert statuses(states, spark, states=["INGESTED"]) == dict.fromkeys([2, 3, 5], "INGESTED")
    assert statuses(states, spark, states=["MATCHED"]) == {1: "MATCHED", 4: "MATCHED"}
    assert states.compact(spark) == 2
    states.vacuum(spark)
    assert statuses(states, spark) == {1: "MATCHED", 2: "INGESTED", 3: "INGESTED", 4: "MATCHED", 5: "INGESTED"}
    row = states.current(spark).where(f"{ID} = 4").first()
    assert (row.ra_deg, row.status, row.step, row.ingest_time.day) == (40.0, "MATCHED", 2, 2)
    # another first change, of a micro-batch that runs again, doesn't undo what came after
    states.append(batches.status_changes(states.current(spark).where(f"{ID} = 1"), "INGESTED", at(9), -1))
    states.compact(spark)
    assert statuses(states, spark)[1] == "MATCHED"


def test_a_reader_opens_only_what_it_asks_for(spark, tmp_path):
    tables = str(tmp_path)
    states = jobs.alert_states(tables)
    for day in (1, 2, 3):
        ingested(spark, tables, range(10 * day, 10 * day + 5), day)
    states.append(batches.status_changes(states.current(spark).where(f"{ID} < 30"), "MATCHED", at(5), 2))
    states.compact(spark)
    states.vacuum(spark)
    opened = states.current(spark, ["INGESTED", "QUEUED"]).inputFiles()
    assert opened and all("state_=INGESTED" in f and "day_=2024-01-03" in f for f in opened)
    opened = states.current(spark, ["MATCHED"], days=["2024-01-02"]).inputFiles()
    assert opened and all("state_=MATCHED" in f and "day_=2024-01-02" in f for f in opened)
    # a compaction leaves the folders of days without changes where they are
    before = states.manifest(spark).folders
    states.append(batches.status_changes(states.current(spark, ["INGESTED"]), "QUEUED", at(6), 1))
    assert all("state_=INGESTED" in f or "/changes/" in f for f in states.current(spark, ["INGESTED", "QUEUED"]).inputFiles())
    states.compact(spark)
    after = states.manifest(spark).folders
    assert after["2024-01-01", "MATCHED"] == before["2024-01-01", "MATCHED"] and ("2024-01-03", "INGESTED") not in after


def test_a_crash_between_writing_and_publishing(spark, tmp_path, monkeypatch):
    tables = str(tmp_path)
    states = jobs.alert_states(tables)
    ingested(spark, tables, [1, 2])
    states.compact(spark)
    states.append(batches.status_changes(states.current(spark).where(f"{ID} = 1"), "QUEUED", at(3), 1))

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(files, "publish", die)
    with pytest.raises(OSError):
        states.compact(spark)
    monkeypatch.undo()
    assert states.manifest(spark).version == 1 and statuses(states, spark) == {1: "QUEUED", 2: "INGESTED"}
    assert states.compact(spark) == 2
    states.vacuum(spark)
    assert statuses(states, spark) == {1: "QUEUED", 2: "INGESTED"}
    assert len(files.listing(spark, f"{states.path}/snapshots")) == 1
    # two at once: the second to publish gives up, and the first one's manifest holds
    states.append(batches.status_changes(states.current(spark).where(f"{ID} = 2"), "QUEUED", at(4), 1))
    monkeypatch.setattr(type(states), "manifest", lambda self, _, m=states.manifest(spark): m)
    assert states.compact(spark) == 3 and states.compact(spark) is None
    monkeypatch.undo()
    assert states.manifest(spark).version == 3 and statuses(states, spark) == {1: "QUEUED", 2: "QUEUED"}


def test_jobs_with_compactions_between(spark, tmp_path):
    tables = str(tmp_path)
    catalog = spark.createDataFrame([("c", str(k), 10.0 * k % 360, 1.0) for k in range(1, 5)], "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double")
    ingested(spark, tables, [1, 2, 3, 50])
    jobs.compact_states(spark, tables)
    assert jobs.run_batch(spark, tables, [catalog], at(2), max_size=3).n_alerts == 3
    jobs.compact_states(spark, tables)
    sent = []
    senders = {"hopskotch": lambda rows: sent.extend(rows.select("payload").collect()) or rows.select("notification_key", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("connection"))}
    assert [tuple(r) for r in jobs.dispatch_round(spark, tables, senders, at(3), limit=2).collect()][-1] == ("hopskotch", 2, 0, 0)
    jobs.compact_states(spark, tables)
    counts = jobs.dispatch_round(spark, tables, senders, at(4), limit=2).collect()
    assert sum(r.n_sent for r in counts) == 1 and len(sent) == 3 and all(json.loads(r.payload)["catalog_name"] == "c" for r in sent)
    jobs.compact_states(spark, tables)
    assert statuses(jobs.alert_states(tables), spark) == {1: "NOTIFIED", 2: "NOTIFIED", 3: "NOTIFIED", 50: "INGESTED"}
    messages = jobs.message_states(tables).current(spark)
    assert messages.where("state = 'sent' AND payload IS NULL AND attempts = 1").count() == 3  # bodies of sent messages aren't kept twice
    assert jobs.dispatch_round(spark, tables, senders, at(5)).count() == 0
    assert spark.read.parquet(f"{tables}/catalog_matches").where("catalog_name = 'c'").count() == 3


def test_a_batch_that_stopped_half_way_runs_again(spark, tmp_path, monkeypatch):
    """Alerts whose states were stored before the failure get no second first state, and dead letters none twice."""
    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    good = [{"value": json.dumps({"diaObjectId": k, "ra": 1.0, "decl": 2.0, "firstDiaSourceMjdTai": 60000.5}), "timestamp": "2024-01-01T00:00:00.000Z", "offset": k} for k in (1, 2)]
    bad = [{"value": "not json", "timestamp": "2024-01-01T00:00:01.000Z", "offset": k} for k in (3, 4)]
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in good + bad))
    writes, whole = [], jobs.append_table

    def failing(df, path, *rest):
        writes.append(path)
        whole(df, path, *rest)
        if len(writes) == 3:  # the dead letters are stored, then the batch fails
            raise OSError("lost")

    monkeypatch.setattr(jobs, "append_table", failing)
    run = lambda: jobs.ingest_stream(spark.readStream.schema("value string, timestamp timestamp, offset long").json(str(source)), "lasair", tables, str(tmp_path / "c"), lambda: at(1)).awaitTermination(120)
    with pytest.raises(Exception, match="lost"):
        run()
    states = jobs.alert_states(tables)
    states.append(batches.status_changes(states.current(spark), "MATCHED", at(2), 2))
    states.compact(spark)
    run()
    assert len(writes) == 6
    assert spark.read.parquet(f"{tables}/alerts").count() == 2 and spark.read.parquet(f"{tables}/alert_deliveries").count() == 2
    assert spark.read.parquet(f"{tables}/dead_letters").count() == 2
    assert statuses(states, spark) == {1: "MATCHED", 2: "MATCHED"}


def test_one_writer(spark, tmp_path):
    lock = str(tmp_path / "lock")
    with files.only_writer(spark, lock):
        with pytest.raises(files.Busy), files.only_writer(spark, lock):
            pass
        with files.only_writer(spark, lock, stale_after=-1):  # the holder died
            pass
    assert not files.exists(spark, lock)
    ran = []
    with files.only_writer(spark, lock):
        jobs._alone(spark, lock, lambda: ran.append(1))
    jobs._alone(spark, lock, lambda: ran.append(2))
    assert ran == [2]
