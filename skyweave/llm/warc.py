"""WARC archives written and read by Spark, with an external index merge.

Writing: one record per page. Spark's text sink writes each record's header
and block and ends it by the blank lines that end WARC records, so archives go
to any file system that Spark knows. Pages of equal payloads of at least
`revisit_bytes` bytes are written once; the others are revisit records.

Reading: whole files are parsed record by record, payload digests are checked,
and each archive gives a locally sorted run of captures. What a revisit refers
to is the record with the id that it names, whose digest must be the same. The runs are dealt to
ranges of (URL key, timestamp, page) and each range merges its parts of the
runs by a loser tree, so all captures come out in one global order.

A null html is an empty payload; a null url has no target line and an empty
key. Null page ids are written without an id and revisit like others, but
nothing refers to them unless all copies are null. A row that repeats both the
id and the payload of a response is a response again. Extra columns go.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, written

END = "\r\n\r\n"
DATE = "2025-01-01T00:00:00Z"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE, revisit_bytes: int = 1000, file_bytes: int = 8_000_000, broadcast_rows: int = 300_000) -> None:
    """Write WARC files of about file_bytes each to a new folder."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1("html"))
    facts = written(rows.select("id", "bytes", "sha1"), "warc-facts")
    copies = facts.where(F.col("bytes") >= revisit_bytes).groupBy("sha1", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    # only rows that revisit are joined to the pages
    revisits = facts.join(copies.select("sha1", "bytes", "first"), ["sha1", "bytes"]).where("not (id <=> first)").select("sha1", "id", "first").distinct()
    revisits = written(revisits, "warc-revisits")
    if revisits.count() <= broadcast_rows:  # about 100 bytes each; more are joined by a shuffle
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits.withColumnRenamed("id", "again").withColumnRenamed("sha1", "digest"), F.expr("id <=> again and sha1 = digest"), "left")
    urn = lambda c: F.expr(f"concat('<urn:uuid:', regexp_replace(md5(concat('page ', {c})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5'), '>')")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.when(F.col("id").isNull(), F.concat(F.lit("<urn:sha1:"), F.col("sha1"), F.lit(">"))).otherwise(urn("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(revisit, urn("first"))),
        line("X-Page", F.col("id")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"), block,
    )
    size = facts.agg(F.avg("bytes")).first()[0] or 0
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(file_bytes / (size + 600)))).text(folder)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers with names in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = head + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield at, end + 4 - at, headers, data[head + 4 : end]
        at = end + 4


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the rest, in lower case: captures of a site sort together."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url.lower())
    return ",".join(m[1].split(".")[::-1]) + ")" + (m[2] or "/") if m else url.lower()


RUN_COLUMNS = "run string, url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, record_id string, refers_to_record string, file string, offset long, length long"
NAMES = [c.split()[0] for c in RUN_COLUMNS.split(", ")]


def _run(path: str, data: bytes) -> list[tuple]:
    """The captures of one archive, sorted: its run."""
    name, rows = path.rsplit("/", 1)[-1], []
    for offset, length, h, block in records(data):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)^content-length: (\d+)", head, re.MULTILINE)[1])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        kind = h["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"the payload at byte {offset} of {path} isn't what its header says")
        url = h.get("warc-target-uri")
        page = h.get("x-page")
        rows.append((name, url_key(url or ""), h["warc-date"], int(page) if page else None, url, kind, size, digest, h["warc-record-id"], h.get("warc-refers-to"), path, offset, length))
    return sorted(rows, key=capture_key)


def capture_key(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[11]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0), batch.column(1), strict=True):
            yield _as_batch(_run(path.as_py(), data.as_py()))


_TYPES = {"string": pa.string(), "long": pa.int64()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in RUN_COLUMNS.split(", ")])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def read_runs(spark, folder: str) -> DataFrame:
    """The sorted runs of all archives of a folder. An archive is a row of binaryFile; few are held at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 2)
    try:
        files = spark.read.format("binaryFile").load(folder).select("path", "content")
        return written(files.mapInArrow(_runs, RUN_COLUMNS), "warc-runs")
    finally:
        spark.conf.set(setting, before)


def resolved(captures: DataFrame, runs: DataFrame) -> DataFrame:
    """captures with refers_to: the page of the record that a revisit refers to. One that isn't there, or has another payload, is an error."""
    named = runs.where("refers_to_record is not null").select(F.col("refers_to_record").alias("target"), F.col("payload_digest").alias("copied")).distinct()
    there = runs.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).dropDuplicates(["target"])
    targets = written(named.join(there, "target", "left"), "warc-targets")
    lost = targets.where("not (copied <=> digest)").first()
    if lost:
        raise ValueError(f"a revisit refers to {lost['target']}, which is no response with its payload")
    return captures.join(targets.select(F.col("target").alias("refers_to_record"), "refers_to").distinct(), "refers_to_record", "left")


class LoserTree:
    """Merges sorted runs: each inner node holds the run that lost there, the root's winner comes next."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.losers = [-1] * max(len(runs), 1)
        self.winner = self._play(1) if runs else -1

    def _key(self, run: int) -> tuple:
        at = self.at[run]
        return (0, *capture_key(self.runs[run][at])) if at < len(self.runs[run]) else (1,)

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are the nodes from the number of runs on."""
        order, stack = [], [node]
        while stack:  # inner nodes, parents first
            x = stack.pop()
            if x < len(self.runs):
                order.append(x)
                stack += [2 * x, 2 * x + 1]
        won: dict[int, int] = {}
        best = lambda x: won[x] if x in won else x - len(self.runs)
        for x in reversed(order):
            a, b = best(2 * x), best(2 * x + 1)
            if self._key(b) < self._key(a):
                a, b = b, a
            won[x], self.losers[x] = a, b
        return best(node)

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            key, node = self._key(run), (run + len(self.runs)) // 2
            while node:
                other = self.losers[node]
                if other >= 0 and (k := self._key(other)) < key:
                    self.losers[node], run, key = run, other, k
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
            runs.setdefault(row[0], []).append(row)
    held, number = [], TaskContext.get().partitionId() << 40
    for row in LoserTree(list(runs.values())):
        held.append(row)
        if len(held) == 5000:
            yield _numbered(held, number)
            number += len(held)
            held = []
    if held:
        yield _numbered(held, number)


def _numbered(rows: list[tuple], first: int) -> pa.RecordBatch:
    batch = _as_batch(rows)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(first, first + len(rows)), pa.int64())], names=[*NAMES, "place"])


def merge_index(runs: DataFrame, rows_per_range: int = 200_000) -> DataFrame:
    """All captures with `place`, a number that grows in the global order of (URL key, timestamp, page)."""
    small_batches(runs.sparkSession)
    ranges = max(2, int(runs.count() // rows_per_range) + 1)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", F.col("page_id").asc_nulls_first(), "run", "offset")
    # a run's rows come in the run's order
    dealt = dealt.sortWithinPartitions("run", "url_key", "captured", F.col("page_id").asc_nulls_first(), "offset")
    return dealt.mapInArrow(_merge, RUN_COLUMNS + ", place long")


def archive_and_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives to the shared folder, read them back and merge their index."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col, url_col, html_col)
    runs = read_runs(spark, folder)
    return resolved(merge_index(runs), runs)
