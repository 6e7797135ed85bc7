"""Messages are sent once, whatever runs again."""

import os
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyweave.operators import notify
from skyweave.sources.outbox import KEY, UNKNOWN, LoggedSender, RoundWriter
from skyweave.streaming import jobs

ID = "lsst_diaobject_diaobjectid"


def at(second):
    return F.timestamp_seconds(F.lit(1_600_000_000 + second))


def to_folder(folder, dies_at=(), fails_at=()):
    """connect() of a receiver that keeps a file for each time a message comes; at some keys the worker dies, once, after it has sent."""

    def connect():
        def send(key, value):
            if key in fails_at:
                raise ValueError("refused")
            with open(f"{folder}/got", "a") as out:
                out.write(f"{key}\n")
            mark = f"{folder}/died-{key}"
            if key in dies_at and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(1)

        return send

    return connect


def got(folder):
    path = f"{folder}/got"
    return sorted(map(int, open(path).read().split())) if os.path.exists(path) else []


def messages(spark, keys):
    rows = spark.createDataFrame([(f"n{k:03d}", k, "c", f"s{k}", 1, "hopskotch", "{}") for k in keys], f"{KEY} string, {ID} long, catalog_name string, catalog_source_id string, match_version int, destination string, payload string")
    return rows.select("*", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), at(0).alias("created_at"), at(0).alias("updated_at"), F.lit(None).cast("timestamp").alias("sent_at"), F.lit(None).cast("timestamp").alias("alert_time"))


def batch(keys):
    return pa.RecordBatch.from_pylist([{KEY: f"n{k:03d}", "key": str(k), "value": "{}"} for k in keys])


@pytest.mark.parametrize(("resend", "twice"), [(False, []), (True, [4])])
def test_a_writer_goes_on_where_it_died(tmp_path, resend, twice):
    """The first attempt dies with messages 3 to 5 begun and 4 sent; the second sends what isn't begun, and 3 to 5 only if told so."""

    class Died(BaseException):
        pass

    sent = []

    def connect():
        def send(key, value):
            sent.append(int(key))
            if key == "4" and sent.count(4) == 1:
                raise Died

        return send

    log = str(tmp_path / "log")
    with pytest.raises(Died):
        RoundWriter(connect, log, 3, resend).write(iter([batch(range(0, 3)), batch(range(3, 9))]))
    assert sent == [0, 1, 2, 3, 4]
    writer = RoundWriter(connect, log, 3, resend)
    counts = writer.write(iter([batch(range(0, 3)), batch(range(3, 9))]))
    writer.commit([counts, None])
    again = [3, 4, 5] if resend else []
    assert sent[5:] == again + [6, 7, 8]
    assert (counts.n_ok, counts.n_failed) == ((9, 0) if resend else (6, 3))
    assert (tmp_path / "log" / "round.committed").read_text() == '{"n_ok": %d, "n_failed": %d, "n_tasks": 2}\n' % (counts.n_ok, counts.n_failed)
    writer.abort([counts, None])
    assert (tmp_path / "log" / "round.aborted").read_text() == '{"n_tasks": 2, "n_done": 1}\n'


def test_outcomes(spark, tmp_path):
    """Repeated keys are sent once, rows without one never; a failing message fails alone, a lost connection fails the rest."""
    sender = LoggedSender(to_folder(tmp_path, fails_at=("2",)), str(tmp_path / "log"))
    rows = messages(spark, [1, 2, 3, 3])
    found = {r[KEY]: (r.ok, r.error, r.connection) for r in sender(rows.union(rows.limit(1).withColumn(KEY, F.lit(None).cast("string")))).collect()}
    assert found == {"n001": (True, None, False), "n002": (False, "refused", False), "n003": (True, None, False)}
    assert got(tmp_path) == [1, 3]
    sender.settle(spark, messages(spark, []))
    assert os.listdir(tmp_path / "log") == []

    def nobody():
        raise ConnectionError("down")

    lost = LoggedSender(nobody, str(tmp_path / "lost"))(messages(spark, [1, 2])).collect()
    assert {(r.ok, r.error, r.connection) for r in lost} == {(False, "Connection error: down", True)}
    assert LoggedSender(nobody, str(tmp_path / "none"))(messages(spark, [])).count() == 0


def test_a_dispatch_that_died_is_taken_over(spark, tmp_path):
    """A worker dies in the round, which stores what was noted; another round dies before it stores anything. Each message comes once."""
    tables, log = str(tmp_path / "tables"), str(tmp_path / "log")
    states = jobs.message_states(tables)
    states.append(messages(spark, range(1, 31)))
    sender = LoggedSender(to_folder(tmp_path, dies_at=("7",)), log, together=1)
    jobs.dispatch_round(spark, tables, {"hopskotch": sender}, at(1))
    first = {r[KEY]: (r.state, r.last_error) for r in states.current(spark).collect()}
    assert first["n007"] == ("failed", UNKNOWN)
    assert sum(s == "sent" for s, _ in first.values()) == len(got(tmp_path)) - 1
    sender(notify.select_pending(states.current(spark, ["pending"]), 5))  # sends five, and the driver dies before their states are stored
    assert states.current(spark, ["sent"]).count() == sum(s == "sent" for s, _ in first.values())
    jobs.dispatch_round(spark, tables, {"hopskotch": sender}, at(2), limit=2)  # two of these five: what is known of the others is kept
    assert len(os.listdir(log)) <= 1
    jobs.dispatch_round(spark, tables, {"hopskotch": sender}, at(3))
    last = {r[KEY]: r.state for r in states.current(spark).collect()}
    assert {k for k, s in last.items() if s != "sent"} == {"n007"}
    assert got(tmp_path) == list(range(1, 31)) and os.listdir(log) == []


RETRY = """
import sys
sys.path[:0] = [{root!r}, {root!r} + "/tests"]
from pyspark.sql import SparkSession
from test_outbox import KEY, LoggedSender, messages, to_folder
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sender = LoggedSender(to_folder({folder!r}, dies_at=("3", "11")), {folder!r} + "/log", together=1)
print(sorted((r[KEY], r.ok) for r in sender(messages(spark, range(20))).collect() if not r.ok))
"""


def test_a_task_that_is_run_again_sends_nothing_twice(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = RETRY.format(root=root, folder=str(tmp_path))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([root, f"{root}/tests"])}
    out = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=240)
    assert out.stdout.strip().endswith("[('n003', False), ('n011', False)]"), out.stderr[-2000:]
    assert got(tmp_path) == list(range(20))


def test_a_round_without_a_limit_leaves_nothing(spark, tmp_path):
    """More messages than a tick takes: all are sent and stored at once, of alerts of two days."""
    tables = str(tmp_path / "tables")
    rows = messages(spark, range(1200)).withColumn("alert_time", F.timestamp_seconds(F.lit(1_600_000_000) + F.col(ID) % 2 * 86400))
    jobs.message_states(tables).append(rows)
    alerts = rows.select(ID, F.lit(None).cast("string").alias("uuid"), F.lit(0.0).alias("ra_deg"), F.lit(0.0).alias("dec_deg"), F.col("alert_time").alias("ingest_time"))
    jobs.alert_states(tables).append(jobs.batches.status_changes(alerts, "MATCHED", at(0), 2))
    sender = LoggedSender(to_folder(tmp_path, fails_at=("7",)), str(tmp_path / "log"), together=100)
    counts = jobs.dispatch_round(spark, tables, {"hopskotch": sender}, at(1), limit=None).agg(*(F.sum(c) for c in ("n_sent", "n_failed", "n_pending"))).first()
    assert tuple(counts) == (1199, 1, 0)
    assert got(tmp_path) == [k for k in range(1200) if k != 7]
    assert {(r.status, r["count"]) for r in jobs.alert_states(tables).current(spark).groupBy("status").count().collect()} == {("NOTIFIED", 1199), ("MATCHED", 1)}


def test_the_query_of_logged_sends_has_no_limit(spark, monkeypatch):
    from skyweave import job_queries

    limits = []
    whole = jobs.dispatch_round
    monkeypatch.setattr(jobs, "dispatch_round", lambda *args, limit=500: limits.append(limit) or whole(*args, limit=limit))
    rows = job_queries.snk2_logged_sends(spark, "/root/testdata/sf0.001")
    assert limits == [None] and rows.where("state = 'pending'").count() == 0
