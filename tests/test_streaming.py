"""Streams from JSON files, run twice over the same input."""

import json

from pyspark.sql import functions as F

from skyweave.operators import batches, crossmatch, ingest
from skyweave.sources.sinks import jdbc_append, send_each, send_results, to_json_lines
from skyweave.streaming import jobs

SCHEMA = "value string, attributes map<string,string>"


def message(k, ra, reliability=0.9):
    return {"value": json.dumps({"diaObject": {"diaObjectId": k, "ra": ra, "dec": 1.0}, "diaSource": {"diaSourceId": k, "reliability": reliability, "midpointMjdTai": 60000.5}}), "attributes": {"diaObject_diaObjectId": str(k)}}


def test_ingest_match_dispatch_twice(spark, tmp_path):
    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    rows = [message(1, 10.0), message(1, 99.0), message(2, 20.0), message(3, 30.0, 0.1), message(4, None)]
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    now = lambda: F.lit("2024-01-01").cast("timestamp")
    for run in ("one", "two"):
        stream = spark.readStream.schema(SCHEMA).json(str(source))
        jobs.ingest_stream(stream, "pittgoogle", tables, str(tmp_path / run), now).awaitTermination(120)
    alerts = spark.read.parquet(f"{tables}/alerts")
    assert sorted(r[0] for r in alerts.select("lsst_diaobject_diaobjectid").collect()) == [1, 2]
    assert spark.read.parquet(f"{tables}/alert_deliveries").count() == 2
    assert {r.reject_reason for r in spark.read.parquet(f"{tables}/dead_letters").collect()} == {"missing ra_deg"}

    catalog = spark.createDataFrame([("c", "7", 10.0, 1.0), ("c", "8", 99.0, 1.0), ("c", "9", 20.0001, 1.0)], "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double")
    for run in ("three", "four"):
        stream = spark.readStream.schema(jobs.ALERTS).parquet(f"{tables}/alerts")
        jobs.match_stream(stream, [catalog], tables, str(tmp_path / run), now).awaitTermination(120)
    assert spark.read.parquet(f"{tables}/catalog_matches").count() == 2
    messages = spark.read.parquet(f"{tables}/notifications")
    assert messages.count() == 2
    senders = {"hopskotch": lambda rows: send_results(rows, to_json_lines(str(tmp_path / "out")))}
    for n in (2, None):  # a second round has nothing to send
        assert [r.n_sent for r in jobs.dispatch_round(spark, tables, senders, now()).collect()] == [n] * (n is not None)
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_a_failing_catalog_leaves_the_others(spark, tmp_path):
    tables, gone = str(tmp_path / "tables"), tmp_path / "gone"
    columns = "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double"
    good = [spark.createDataFrame([(name, "7", 10.0, 1.0)], columns) for name in ("a", "z")]
    good[0].write.parquet(str(gone))
    bad = spark.read.parquet(str(gone))
    for f in gone.glob("*.parquet"):
        f.write_bytes(b"none")
    alerts = spark.createDataFrame([(1, 10.0, 1.0), (2, 50.0, 1.0)], "lsst_diaobject_diaobjectid long, ra_deg double, dec_deg double")
    now = F.lit("2024-01-01").cast("timestamp")
    for _ in range(2):
        assert list(jobs.match_batch(alerts, [good[0], bad, good[1]], tables, now)) == ["catalog 1"]
    assert sorted(r.catalog_name for r in spark.read.parquet(f"{tables}/catalog_matches").collect()) == ["a", "z"]
    assert spark.read.parquet(f"{tables}/notifications").count() == 2
    runs = {r.catalog_name: (r.n_matched, r.outcome == "ok") for r in spark.read.parquet(f"{tables}/match_runs").collect()}
    assert runs == {"a": (1, True), "z": (1, True), "catalog 1": (0, False)}


SOURCES = "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double"
ID = "lsst_diaobject_diaobjectid"


def at(second):
    return F.lit(f"2024-01-01 00:00:{second:02d}").cast("timestamp")


def status(spark, tables):
    return {r[ID]: r.status for r in jobs.alert_states(tables).current(spark).collect()}


def changed(spark, tables, rows, state, second, step):
    """Changes of alerts from outside the jobs."""
    now = jobs.alert_states(tables).current(spark).join(rows.select(ID), ID, "left_semi")
    jobs.alert_states(tables).append(batches.status_changes(now, state, at(second), step))


def test_batches_and_dispatches(spark, tmp_path):
    """Ingested, queued, matched, notified: with a failing catalog, failing sends, a lost connection and a failing batch."""
    tables = str(tmp_path / "tables")
    rows = spark.createDataFrame([(k, 10.0 * k, 1.0, None, "p") for k in range(1, 5)], f"{ID} long, ra_deg double, dec_deg double, lsst_diasource_diasourceid long, payload string")
    jobs.ingest_batch(rows.withColumn("event_time", at(0)).withColumn("broker", F.lit("lasair")), tables, at(0))
    good = spark.createDataFrame([("c", str(k), 10.0 * k, 1.0) for k in (1, 2, 3)], SOURCES)
    crossmatch.prepare_catalog(good, str(tmp_path / "prepared"))
    bad = good.where(F.raise_error(F.lit("gone")).isNull())
    catalogs = [spark.read.parquet(str(tmp_path / "prepared")), bad]
    assert jobs.run_batch(spark, tables, catalogs, at(1), max_size=10, max_wait=5).n_alerts == 0
    none = spark.createDataFrame([(1,)], "x int")
    run = jobs.run_batch(spark, tables, [none], at(6), max_size=10, max_wait=5)
    assert run.n_alerts == 4 and set(status(spark, tables).values()) == {"MATCHED"} and list(run.failed) == ["catalog 0"]
    changed(spark, tables, rows, "INGESTED", 7, 2)
    run = jobs.run_batch(spark, tables, catalogs, at(8), max_size=4)
    assert run.n_alerts == 4 and list(run.failed) == ["catalog 1"] and run.error is None
    assert spark.read.parquet(f"{tables}/catalog_matches").count() == 3
    assert jobs.run_batch(spark, tables, catalogs, at(9), max_size=1).n_alerts == 0

    def connect():
        def send(key, value):
            if key == "2":
                raise ValueError("x" * 900)

        return send

    def no_connection():
        raise ConnectionError("refused")

    counts = jobs.dispatch_round(spark, tables, {"hopskotch": lambda m: send_each(m, connect)}, at(10)).first()
    assert (counts.n_sent, counts.n_failed, counts.n_pending) == (2, 1, 0)
    assert status(spark, tables) == {1: "NOTIFIED", 2: "MATCHED", 3: "NOTIFIED", 4: "MATCHED"}
    log = {r.state: r for r in jobs.message_states(tables).current(spark).collect()}
    assert log["failed"].last_error == "x" * 500 and log["sent"].attempts == 1
    pending = spark.read.parquet(f"{tables}/notifications")
    lost = send_each(pending, no_connection).collect()
    assert {(r.ok, r.error, r.connection) for r in lost} == {(False, "Connection error: refused", True)}
    broken = send_results(pending, lambda df: no_connection())
    assert broken.first().connection and broken.first().error == "Connection error: refused"


def test_a_failed_batch_is_put_back(spark, tmp_path, monkeypatch):
    tables = str(tmp_path / "tables")
    rows = spark.createDataFrame([(1, 10.0, 1.0, None, "p")], f"{ID} long, ra_deg double, dec_deg double, lsst_diasource_diasourceid long, payload string")
    jobs.ingest_batch(rows.withColumn("event_time", at(0)).withColumn("broker", F.lit("lasair")), tables, at(0))
    good = spark.createDataFrame([("c", "1", 10.0, 1.0)], SOURCES)

    def fail(*_):
        raise RuntimeError("no cluster")

    monkeypatch.setattr(jobs, "match_batch", fail)
    assert jobs.run_batch(spark, tables, [good], at(1), max_size=1).error == "no cluster" and status(spark, tables) == {1: "INGESTED"}
    monkeypatch.undo()
    # a run that stopped while its alerts were queued: they wait until they are stuck, then go again
    changed(spark, tables, rows, "QUEUED", 2, 1)
    assert jobs.run_batch(spark, tables, [good], at(3), max_size=1, stuck_after=30).n_alerts == 0
    assert jobs.run_batch(spark, tables, [good], at(40), max_size=1, stuck_after=30).n_alerts == 1 and status(spark, tables) == {1: "MATCHED"}


def test_jobs_tick(spark, tmp_path):
    done = []
    query = jobs.every(spark, 0.5, lambda: done.append(1), str(tmp_path / "ticks"))
    query.awaitTermination(6)
    query.stop()
    assert len(done) > 1


def test_history_is_not_shuffled(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias(ID), F.lit("p").alias("payload")).write.parquet(str(tmp_path / "h"))
    history = spark.read.parquet(str(tmp_path / "h"))
    incoming = spark.createDataFrame([(5, "a"), (5000, "b"), (5000, "c")], f"{ID} long, payload string")
    new = ingest.new_rows(history, incoming, [ID], ["payload"], batch_rows=3)
    assert [(r[ID], r.payload) for r in new.collect()] == [(5000, "b")]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = ingest.new_rows(history, incoming, [ID], ["payload"], batch_rows=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    lines = plan.split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line)
    # from the scan upwards: the cut to the incoming keys comes before any exchange
    level, above = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    assert "BroadcastHashJoin" in next(line for line in above if "Exchange" in line or "Join" in line)


def test_rows_go_to_a_database(spark):
    """By the embedded database that Spark ships."""
    url = {"url": "jdbc:derby:memory:sinks;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.createDataFrame([(k, float(k)) for k in range(7)], "k long, x double")
    for _ in range(2):
        jdbc_append(rows, url["url"], "matches", batch_size=3, driver=url["driver"])
    back = spark.read.format("jdbc").options(**url, dbtable="matches").load()
    assert back.count() == 14 and back.agg(F.sum("x")).first()[0] == 42


def test_repeated_messages_go_before_parsing(spark, tmp_path):
    source, tables = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()
    body = json.dumps({"diaObjectId": 1, "ra": 1.0, "decl": 2.0, "firstDiaSourceMjdTai": 60000.5})
    rows = [{"value": body, "timestamp": f"2024-01-01T00:00:0{k}.000Z", "offset": k} for k in range(3)] + [{"value": "not json", "timestamp": "2024-01-01T00:00:00.000Z", "offset": 9}] * 2
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("value string, timestamp timestamp, offset long").json(str(source))
    jobs.ingest_stream(stream, "lasair", tables, str(tmp_path / "c"), lambda: at(1), repeats_within="1 hour").awaitTermination(120)
    assert spark.read.parquet(f"{tables}/alerts").count() == 1
    assert spark.read.parquet(f"{tables}/dead_letters").count() == 1
