"""Sending messages one by one with a log of outcomes, so that a task or a dispatch that runs again sends none twice.

A task notes what it is about to send (files *.begun), sends it, and notes
what came of it (files *.json). A task that is run again takes over what its
earlier attempts noted. A dispatch that died leaves its rounds in the log's
folder; the next one takes over their outcomes too, until they are stored with
the messages' states (settle).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.times import connection_error, send_error
from . import files
from .sinks import ALERT

KEY = "notification_key"
OUTCOME = f"{KEY} string, ok boolean, error string, connection boolean"
UNKNOWN = "outcome of an earlier attempt is unknown"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """A shared folder as a task sees it, without a JVM."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def _note(where: pafs.FileSystem, path: str, rows: list[dict]) -> None:
    """A file of JSON lines that is there whole or not at all."""
    draft = "{}/_{}".format(*path.rsplit("/", 1))
    with where.open_output_stream(draft) as out:
        out.write("".join(f"{json.dumps(r)}\n" for r in rows).encode())
    where.move(draft, path)


def _noted(where: pafs.FileSystem, folder: str) -> tuple[dict[str, dict], set[str]]:
    """What earlier attempts of a task noted: outcomes by key, and keys that were begun and have none."""
    done: dict[str, dict] = {}
    begun: set[str] = set()
    for info in where.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.startswith("_"):
            continue
        with where.open_input_stream(info.path) as lines:
            rows = [json.loads(line) for line in lines.read().decode().splitlines()]
        if info.extension == "json":
            done |= {r[KEY]: r for r in rows}
        else:
            begun |= {r[KEY] for r in rows}
    return done, begun - set(done)


@dataclass
class Sent(WriterCommitMessage):
    n_ok: int
    n_failed: int


class RoundWriter(DataSourceArrowWriter):
    """Sends rows (notification_key, key, value); notes outcomes under a folder of the task's partition.

    together: messages that are noted as begun at once, which is as many as a
    task that dies leaves unknown. resend: these are sent again, else they fail.
    """

    def __init__(self, connect: Callable[[], Callable[[str, str], None]], path: str, together: int, resend: bool) -> None:
        self.connect, self.path, self.together, self.resend = connect, path, together, resend

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        task = TaskContext.get()
        where, root = _at(self.path)
        folder = f"{root}/part-{task.partitionId() if task else 0:05d}"
        where.create_dir(folder, recursive=True)
        done, unknown = _noted(where, folder)
        counts = Sent(sum(r["ok"] for r in done.values()), sum(not r["ok"] for r in done.values()))
        sender = _Sender(self.connect)
        for batch in iterator:
            rows = [r for r in batch.to_pylist() if r[KEY] not in done]
            lost = [] if self.resend else [r for r in rows if r[KEY] in unknown]
            if lost:
                _note(where, f"{folder}/{uuid.uuid4().hex}.json", [_outcome(r, False, UNKNOWN) for r in lost])
                counts.n_failed += len(lost)
                rows = [r for r in rows if r[KEY] not in unknown]
            for start in range(0, len(rows), self.together):
                some, name = rows[start : start + self.together], uuid.uuid4().hex
                _note(where, f"{folder}/{name}.begun", [{KEY: r[KEY]} for r in some])
                outcomes = [sender.send(r) for r in some]
                _note(where, f"{folder}/{name}.json", outcomes)
                counts.n_ok += sum(r["ok"] for r in outcomes)
                counts.n_failed += sum(not r["ok"] for r in outcomes)
        return counts

    def commit(self, messages: list[Sent | None]) -> None:
        there = [m for m in messages if m]
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        _note(where, f"{root}/round.committed", [{"n_ok": sum(m.n_ok for m in there), "n_failed": sum(m.n_failed for m in there), "n_tasks": len(messages)}])

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays sent and noted; the mark tells that the rest wasn't tried."""
        where, root = _at(self.path)
        where.create_dir(root, recursive=True)
        _note(where, f"{root}/round.aborted", [{"n_tasks": len(messages), "n_done": sum(m is not None for m in messages)}])


def _outcome(row: dict, ok: bool, error: str | None = None, connection: bool = False) -> dict:
    return {KEY: row[KEY], "ok": ok, "error": error, "connection": connection}


class _Sender:
    """A task's connection. A send that fails fails its message alone; a connection that fails or is lost fails what is left."""

    def __init__(self, connect: Callable[[], Callable[[str, str], None]]) -> None:
        self.connect, self.to, self.lost = connect, None, None

    def send(self, row: dict) -> dict:
        try:
            if self.lost is None:
                self.to = self.to or self.connect()
                self.to(row["key"], row["value"])
            return _outcome(row, self.lost is None, self.lost, self.lost is not None)
        except ConnectionError as failure:
            self.lost = str(failure)
            return _outcome(row, False, self.lost, True)
        except Exception as failure:  # noqa: BLE001  recorded with the message
            return _outcome(row, False, str(failure))


class LoggedSender:
    """A sender for dispatch_round. connect() opens a task's connection and gives its send(key, value).

    folder: of this destination's log, shared by driver and executors. Rows
    with the same key are one message: only one of them is sent. Rows without
    a key aren't sent and get no result. Speculative attempts would send at
    the same time as those that they double, so they must be off.
    """

    def __init__(self, connect: Callable[[], Callable[[str, str], None]], folder: str, together: int = 20, resend: bool = False) -> None:
        self.connect, self.folder, self.together, self.resend = connect, folder.rstrip("/"), together, resend

    def __call__(self, messages: DataFrame) -> DataFrame:
        """(notification_key, ok, error, connection) of each message that this round or one before it tried."""
        spark = messages.sparkSession
        if spark.conf.get("spark.speculation", "false") == "true":
            raise RuntimeError("spark.speculation must be off where messages are sent")
        rows = messages.where(F.col(KEY).isNotNull()).select(KEY, F.col(ALERT).cast("string").alias("key"), F.col("payload").alias("value")).dropDuplicates([KEY])
        unsent = rows.join(self.outcomes(spark).select(KEY), KEY, "left_anti") if files.listing(spark, self.folder) else rows
        connect, together, resend = self.connect, self.together, self.resend

        class Outbox(DataSource):
            @classmethod
            def name(cls) -> str:
                return "skyweave_outbox"

            def writer(self, schema: object, overwrite: bool) -> RoundWriter:
                return RoundWriter(connect, self.options["path"], together, resend)

        spark.dataSource.register(Outbox)
        try:
            unsent.write.format("skyweave_outbox").mode("append").save(f"{self.folder}/{uuid.uuid4().hex}")
            failure = None
        except Exception as error:  # noqa: BLE001  what was noted counts; the rest stays pending for the next round
            failure = error
        found = self.outcomes(spark).join(rows.select(KEY), KEY, "left_semi")
        if failure is not None and found.isEmpty():
            raise failure
        error = F.when(F.col("connection"), connection_error(F.col("error"))).otherwise(send_error(F.col("error")))
        return found.withColumn("error", error)

    def _read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.schema(OUTCOME).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").json(self.folder)

    def outcomes(self, spark: SparkSession) -> DataFrame:
        """One row for each message that a round in the log tried. Unless they are sent again, messages of unknown outcome have failed."""
        if not files.exists(spark, self.folder):
            return spark.createDataFrame([], OUTCOME)
        done = self._read(spark, "json")
        if not self.resend:
            begun = self._read(spark, "begun").select(KEY)
            lost = begun.join(done.select(KEY), KEY, "left_anti").select(KEY, F.lit(False).alias("ok"), F.lit(UNKNOWN).alias("error"), F.lit(False).alias("connection"))
            done = done.unionByName(lost)
        # of a message that was tried twice its success counts
        return done.groupBy(KEY).agg(F.max(F.struct("ok", "connection", "error")).alias("last_")).select(KEY, "last_.ok", "last_.error", "last_.connection")

    def settle(self, spark: SparkSession, pending: DataFrame) -> None:
        """Forget the rounds whose outcomes are stored. pending: messages that still wait; what is known of them is kept."""
        rounds = [name for name, folder in files.listing(spark, self.folder).items() if folder]
        kept = self.outcomes(spark).join(pending.select(KEY), KEY, "left_semi").coalesce(1)
        if rounds and not kept.isEmpty():
            kept.write.json(f"{self.folder}/{uuid.uuid4().hex}")
        for name in rounds:
            files.delete(spark, f"{self.folder}/{name}")
