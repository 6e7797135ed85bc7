"""Which files of a stored table may hold the keys of a micro-batch.

For each data file the index has its smallest and largest key and a Bloom
filter of its keys. A lookup reads the two numbers of all files first, then the
filters of files whose range takes in a key that comes: object ids grow with
time, so few do. A file that isn't indexed yet counts as one that may hold
anything, so the index may lag behind the table and is never wrong about what
is new; it says `may hold` of about one file in a million keys in vain.

Appends don't touch it: `update` indexes files that it doesn't know, and a job
runs that now and then. Null keys aren't indexed (stored rows have none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Bits of a filter for each key, and how many of them a key sets: 3 in 10 million other keys seem to be there.
BITS, PROBES = 32, 16
#: Keys of a micro-batch up to so many are sent to the tasks that look at filters (8 bytes each); beyond, files are chosen by range alone.
MOST_KEYS = 1_000_000
ENTRY = "file string, low long, high long, n long, bits binary"


def probes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places [key, probe] in a filter of so many bits."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)


def bloom(hashes: np.ndarray) -> bytes:
    size = max(64, BITS * len(hashes))
    flags = np.zeros(size, bool)
    flags[probes(hashes, size).reshape(-1)] = True
    return np.packbits(flags).tobytes()


def may_hold(bits: bytes, n: int, hashes: np.ndarray) -> bool:
    """Whether a filter of n keys may have one of the keys."""
    table, left = np.frombuffer(bits, np.uint8), hashes
    size = max(64, BITS * n)
    for k in range(PROBES):  # each probe leaves fewer keys
        at = probes(left, size)[:, k] if len(left) else np.zeros(0, np.uint64)
        left = left[(table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    return bool(len(left))


@dataclass(frozen=True)
class KeyIndex:
    """An index at `path` of the Parquet table at `table`, by a long column."""

    table: str
    path: str
    key: str
    schema: str

    def _files(self, spark: SparkSession) -> list[str]:
        return spark.read.schema(self.schema).parquet(self.table).inputFiles() if files.exists(spark, self.table) else []

    def _read(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return spark.read.option("basePath", self.table).schema(self.schema).parquet(*names) if names else spark.createDataFrame([], self.schema)

    def _entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ENTRY).parquet(self.path) if files.exists(spark, self.path) else spark.createDataFrame([], ENTRY)

    def update(self, spark: SparkSession) -> int:
        """Index the files that aren't yet; how many."""
        known = {r["file"] for r in self._entries(spark).select("file").distinct().collect()}
        new = [f for f in self._files(spark) if f not in known]
        if not new:
            return 0
        rows = self._read(spark, new).where(F.col(self.key).isNotNull()).select(F.input_file_name().alias("file"), F.col(self.key).cast("long").alias("key"), F.xxhash64(F.col(self.key).cast("long")).alias("hash"))

        def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                names, keys, hashes = (batch.column(0).dictionary_encode(), batch.column(1).to_numpy(), batch.column(2).to_numpy())
                for k, name in enumerate(names.dictionary.to_pylist()):
                    here = names.indices.to_numpy() == k
                    own.setdefault(name, []).append((keys[here], hashes[here]))
            # a file that several tasks read has an entry of each
            for name, parts in own.items():
                keys, hashes = np.concatenate([p[0] for p in parts]), np.unique(np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(keys.min())], pa.int64()), pa.array([int(keys.max())], pa.int64()), pa.array([len(hashes)], pa.int64()), pa.array([bloom(hashes)], pa.binary())], names=["file", "low", "high", "n", "bits"])

        rows.mapInArrow(collect, ENTRY).sortWithinPartitions("file").write.mode("append").parquet(self.path)
        return len(new)

    def files_for(self, spark: SparkSession, incoming: DataFrame) -> list[str]:
        """Files that may hold a key of incoming."""
        there = self._files(spark)
        entries = self._entries(spark)
        ranges = entries.select("file", "low", "high")
        known = {r["file"] for r in ranges.select("file").distinct().collect()}
        fresh = [f for f in there if f not in known]
        keys = incoming.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast("long").alias("key")).distinct()
        if not known or (many := keys.count()) == 0:
            return fresh
        if many > MOST_KEYS:
            span = keys.agg(F.min("key").alias("least"), F.max("key").alias("most"))
            near = ranges.join(F.broadcast(span), (F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most"))).select("file")
            return fresh + sorted({r["file"] for r in near.distinct().collect()} & set(there))
        rows = keys.select("key", F.xxhash64("key").alias("hash")).toArrow()  # at most MOST_KEYS
        order = np.argsort(rows["key"].to_numpy())
        sent = spark.sparkContext.broadcast((rows["key"].to_numpy()[order], rows["hash"].to_numpy()[order]))

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, _ = sent.value
            for batch in batches:
                first = np.searchsorted(own, batch.column("low").to_numpy())
                hit = np.searchsorted(own, batch.column("high").to_numpy(), side="right") > first
                yield batch.select(["file"]).filter(pa.array(hit))

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, hashes = sent.value
            for batch in batches:
                hit = []
                for low, high, n, bits in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "n", "bits")), strict=True):
                    s, e = np.searchsorted(own, low), np.searchsorted(own, high, side="right")
                    hit.append(may_hold(bits, n, hashes[s:e]))
                yield batch.select(["file"]).filter(pa.array(hit, pa.bool_()))

        near = sorted({r["file"] for r in ranges.mapInArrow(inside, "file string").distinct().collect()} & set(there))
        if not near:
            return fresh
        found = entries.where(F.col("file").isin(near)).mapInArrow(held, "file string").distinct().collect()
        return fresh + sorted(r["file"] for r in found)

    def history(self, spark: SparkSession, incoming: DataFrame) -> DataFrame:
        """The table's rows in files that may hold a key of incoming: all that a merge with it needs."""
        return self._read(spark, self.files_for(spark, incoming))
