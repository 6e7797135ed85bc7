"""Landed messages are read once each, with their attributes."""

import base64
import gzip
import json
import os
from datetime import UTC, datetime

from pyspark.sql import functions as F

from skyweave.sources.landed import LandedReader, landed_stream, message
from skyweave.streaming import jobs


def line(k, **more):
    body = {"diaObject": {"diaObjectId": k, "ra": 10.0, "dec": 1.0}, "diaSource": {"diaSourceId": k, "reliability": 0.9, "midpointMjdTai": 60000.0}}
    return json.dumps({"data": base64.b64encode(json.dumps(body).encode()).decode(), "attributes": {"diaObject_diaObjectId": str(k)}, "messageId": f"m{k}", "publishTime": "2026-01-02T03:04:05.123456789Z", **more})


def test_lines():
    row = message(line(7))
    assert row["timestamp"] == datetime(2026, 1, 2, 3, 4, 5, 123456, UTC) and row["attributes"] == [("diaObject_diaObjectId", "7")]
    assert json.loads(row["value"])["diaObject"]["diaObjectId"] == 7
    none = {"value": None, "attributes": None, "message_id": None, "timestamp": None}
    assert message("{}") == none
    assert message("not json") == {**none, "value": "not json"} and message("[1]") == {**none, "value": "[1]"}
    assert message('{"data": "?", "attributes": {"a": null, "b": 1}, "messageId": 5, "publishTime": "soon"}') == {"value": "?", "attributes": [("a", None), ("b", "1")], "message_id": "5", "timestamp": None}


def test_each_file_is_in_one_offset(tmp_path):
    folder, log, done = (str(tmp_path / n) for n in ("in", "log", "done"))
    make = lambda: LandedReader(folder, log, done, 10)
    assert make().latestOffset() == make().initialOffset() == {"entry": 0}
    os.makedirs(folder)
    for name in ("b", "c", "_hidden", ".draft"):
        (tmp_path / "in" / name).write_text("12345678")
    first = make()
    assert first.latestOffset() == {"entry": 1} == first.latestOffset()
    (tmp_path / "in" / "a").write_text("1")  # later, though its name comes first
    again = make()  # after a restart
    assert again.latestOffset() == {"entry": 2}
    names = lambda start, end: [p.names for p in again.partitions({"entry": start}, {"entry": end})]
    assert names(0, 2) == [["b"], ["c", "a"]] and names(1, 2) == [["a"]] and names(2, 2) == []
    again.commit({"entry": 1})
    assert sorted(os.listdir(done)) == ["b", "c"] and os.listdir(log) == ["000000000002.json"]
    last = make()
    assert last.latestOffset() == {"entry": 2}
    last.commit({"entry": 2})
    last.commit({"entry": 2})
    assert sorted(os.listdir(done)) == ["a", "b", "c"] and make().latestOffset() == {"entry": 2}
    (tmp_path / "in" / "d").write_text("1")
    assert make().latestOffset() == {"entry": 3}


def test_a_stream_that_restarts(spark, tmp_path):
    """Three runs from one checkpoint: files between them, long ones and compressed ones, nothing twice; then through the ingest job."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        rows = landed_stream(spark, str(folder), str(tmp_path / "log"), task_bytes=2000)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        return [r[0] for r in spark.read.parquet(out).orderBy(F.expr("CAST(substr(message_id, 2) AS INT)")).select("message_id").collect()]

    (folder / "m.json").write_text("\n".join(line(k) for k in range(2500)) + "\n\n")
    (folder / "n.json").write_text("")
    assert run() == [f"m{k}" for k in range(2500)]
    (folder / "a.json.gz").write_bytes(gzip.compress("\n".join(line(k) for k in range(2500, 2510)).encode()))
    assert run() == [f"m{k}" for k in range(2510)] == run()

    tables = str(tmp_path / "tables")
    stream = landed_stream(spark, str(folder), str(tmp_path / "log2"), str(tmp_path / "done"))
    jobs.ingest_stream(stream, "pittgoogle", tables, str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(f"{tables}/alerts").select("lsst_diaobject_diaobjectid").distinct().count() == 2510
