"""Messages of a subscription that lands them as files: a stream with offsets of its own.

A file has a message in each line, as JSON: data (base64), attributes,
messageId, publishTime. New files are noted in a log, and an offset is a place
in it, so each file is in one micro-batch whatever its name or time is, also
after a restart from a checkpoint. With a folder for done files, those of
stored micro-batches are moved there, which keeps listings and log short.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .outbox import _at, _note

SCHEMA = "value string, attributes map<string, string>, message_id string, timestamp timestamp"
ARROW = pa.schema([("value", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("message_id", pa.string()), ("timestamp", pa.timestamp("us", tz="UTC"))])


@dataclass
class Files(InputPartition):
    names: list[str]


def message(line: str) -> dict:
    """A line as a row. What isn't a message goes on as value without attributes; parts that are missing or broken are null."""
    try:
        found = json.loads(line)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return {"value": line, "attributes": None, "message_id": None, "timestamp": None}
    data, time, attributes = found.get("data"), found.get("publishTime"), found.get("attributes")
    try:
        value = None if data is None else base64.b64decode(data, validate=True).decode(errors="replace")
    except (TypeError, binascii.Error):
        value = str(data)
    try:
        when = datetime.fromisoformat(time)
        when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
    except (TypeError, ValueError):
        when = None
    pairs = {str(k): None if v is None else str(v) for k, v in attributes.items()} if isinstance(attributes, dict) else None
    ident = found.get("messageId")
    return {"value": value, "attributes": None if pairs is None else list(pairs.items()), "message_id": None if ident is None else str(ident), "timestamp": when}


class LandedReader(DataSourceStreamReader):
    def __init__(self, path: str, log: str, done: str | None, task_bytes: int) -> None:
        self.path, self.log, self.done, self.task_bytes = path, log, done, task_bytes
        self.known: dict[str, int] | None = None  # names of the log, with their entry
        self.last = 0

    def _entry(self, n: int) -> str:
        return f"{_at(self.log)[1]}/{n:012d}.json"

    def _noted(self, where: pafs.FileSystem, n: int) -> list[dict]:
        with where.open_input_stream(self._entry(n)) as lines:
            return [json.loads(line) for line in lines.read().decode().splitlines()]

    def _load(self) -> dict[str, int]:
        if self.known is None:
            where, log = _at(self.log)
            where.create_dir(log, recursive=True)
            entries = sorted(int(f.base_name[:-5]) for f in where.get_file_info(pafs.FileSelector(log)) if f.extension == "json" and f.base_name[0] != "_")
            self.known = {r["name"]: n for n in entries for r in self._noted(where, n)}
            self.last = max(entries, default=0)
        return self.known

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        known = self._load()
        where, root = _at(self.path)
        there = where.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        new = sorted((f.base_name, f.size) for f in there if f.is_file and f.base_name[0] not in "_." and f.base_name not in known)
        if new:
            _note(_at(self.log)[0], self._entry(self.last + 1), [{"name": name, "size": size} for name, size in new])
            self.last += 1
            known |= {name: self.last for name, _ in new}
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Files of the entries after start, as many for a task as hold about task_bytes."""
        where, _ = _at(self.log)
        out, size = [], 0
        for n in range(start["entry"] + 1, end["entry"] + 1):
            for row in self._noted(where, n):
                if not out or size + row["size"] > self.task_bytes:
                    out.append(Files([]))
                    size = 0
                out[-1].names.append(row["name"])
                size += row["size"]
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, root = _at(self.path)
        for name in partition.names:
            with where.open_input_stream(f"{root}/{name}", compression="detect") as stream:
                rows = []
                for line in _lines(stream):
                    rows.append(message(line))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    def commit(self, end: dict) -> None:
        """Files up to end are stored. Without a folder for them they stay where they are."""
        if not self.done:
            return
        known = self._load()
        where, root = _at(self.path)
        _, done = _at(self.done)
        where.create_dir(done, recursive=True)
        stored = [name for name, n in known.items() if n <= end["entry"]]
        for name in stored:
            if where.get_file_info(f"{root}/{name}").is_file:  # else it was moved before a restart
                where.move(f"{root}/{name}", f"{done}/{name}")
        # the newest entry stays, since places in the log go on from it
        for n in sorted({known[name] for name in stored} - {self.last}):
            where.delete_file(self._entry(n))
        self.known = {name: n for name, n in known.items() if n > end["entry"] or n == self.last}


def _lines(stream: pa.NativeFile) -> Iterator[str]:
    """Lines that aren't blank, a part of the file at a time."""
    rest = b""
    while part := stream.read(1 << 20):
        *whole, rest = (rest + part).split(b"\n")
        yield from (line.decode(errors="replace") for line in whole if line.strip())
    if rest.strip():
        yield rest.decode(errors="replace")


class LandedMessages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skyweave_landed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> LandedReader:
        return LandedReader(self.options["path"], self.options["log"], self.options.get("done"), int(self.options.get("task_bytes", 32 << 20)))


def landed_stream(spark: SparkSession, path: str, log: str, done: str | None = None, task_bytes: int = 32 << 20) -> DataFrame:
    """Messages as they land in a folder: value, attributes, message_id, timestamp.

    log: a folder of this query's own, as its checkpoint is. A file must come
    into the folder whole and isn't changed later; names that begin with _ or .
    are passed over. A subscription may deliver a message in two files: see
    jobs.deduplicated. A file that is named as one that was read, and that is
    still in the log, isn't read again.
    """
    spark.dataSource.register(LandedMessages)
    reader = spark.readStream.format("skyweave_landed").option("log", log).option("task_bytes", task_bytes)
    return (reader.option("done", done) if done else reader).load(path)
