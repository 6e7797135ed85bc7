"""What the operators share: tables written to the shared folder, and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:  # workers that need no pandas don't load it
    import pandas as pd

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset only a local session (tests) gets a folder of its own; else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _OWN.setdefault(app, tempfile.mkdtemp(prefix="skyweave-"))
    return folder.rstrip("/")


#: Whether Spark deletes the shuffles of a query once the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """The session has these settings meanwhile, and then those of before."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and lost executors don't matter. The shuffles that made it go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, name: str) -> str:
    """Write a table of a bounded size to one file in the shared folder that every executor fetches; its name there, for `fetched`.

    The driver holds none of it.
    """
    file = written(df.repartition(1), name).inputFiles()[0]
    df.sparkSession.sparkContext.addFile(file)
    return file.rsplit("/", 1)[-1]


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `written` that are read no more, and let the driver's collector find what nothing refers to: executors hold the task code of all earlier stages until it does."""
    sc = spark.sparkContext
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = sc._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
    sc._jvm.System.gc()


def spread_parts(df: DataFrame, name: str) -> list[str]:
    """Like `spread`, for a table that grows with the input: its files as they were written, none of which holds it all."""
    files = written(df, name).inputFiles()
    for file in files:
        df.sparkSession.sparkContext.addFile(file)
    return [file.rsplit("/", 1)[-1] for file in files]


_FETCHED: dict[str, dict[str, np.ndarray]] = {}


def fetched(name: str, make: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], rows: int = 16) -> dict[str, np.ndarray]:
    """In a task: what `make` makes of the batches of a table of `spread`. A worker keeps the last two."""
    if name not in _FETCHED:
        while len(_FETCHED) > 1:
            del _FETCHED[next(iter(_FETCHED))]
        _FETCHED[name] = make(pq.ParquetFile(SparkFiles.get(name), pre_buffer=False).iter_batches(batch_size=rows, use_threads=False))
        pa.default_memory_pool().release_unused()
    return _FETCHED[name]


def drop_fetched(*names: str) -> None:
    """In a task: forget tables of `fetched`. A worker goes on to other stages, and would hold them meanwhile."""
    for name in names:
        _FETCHED.pop(name, None)
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_rows(df: DataFrame, id_col: str, text_col: str, rows: int = 1000) -> DataFrame:
    """(doc_id, text) alone. Python gets at most that many rows at a time in this session: texts can be long."""
    small_batches(df.sparkSession, rows)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def union_find(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a list of edges, and for each the smallest node that it is linked with."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        # hang the roots of both ends below the smaller label, then shorten the paths
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, shorter := label[label]):
            label = shorter
        if np.array_equal(before, label):
            return nodes, nodes[label]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd

    parts = []
    for pdf in batches:
        parts.append(pdf)
        if sum(map(len, parts)) >= 500_000:
            parts = [_contract(pd.concat(parts))]
            if len(parts[0]) >= 250_000:
                yield parts.pop()
    if parts:
        yield _contract(pd.concat(parts))


def _contract(pdf: pd.DataFrame) -> pd.DataFrame:
    import pandas as pd

    nodes, low = union_find(pdf["a"].to_numpy(), pdf["b"].to_numpy())
    keep = nodes != low
    return pd.DataFrame({"a": low[keep], "b": nodes[keep]})


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable node of every node with an edge: (node, component).

    edges: long columns a, b in any direction, repeats allowed. Each round
    contracts the edges of a partition to a forest, then hangs every node and
    its neighbours below the node's smallest neighbour (large and small stars).
    Only minima are grouped, so a node with very many edges needs no large
    group. Tables of each round are written to the shared folder.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(edges.mapInPandas(_forest, "a long, b long").distinct(), f"{name}-edges")
    while True:
        # large star: the larger neighbours of a node hang below the smallest of node and neighbours
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours hang below the smallest of these
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array("a", "b")).alias("b")).where("m <> b").select(F.col("m").alias("a"), "b").distinct()
        after = written(small, f"{name}-edges")
        # done when every node has one edge, to a node that has no smaller neighbour
        tops = after.select(F.col("a").alias("b")).distinct()
        twice = after.groupBy("b").count().where("count > 1").select("b")
        done = after.join(tops, "b", "left_semi").select("b").union(twice).isEmpty()
        forget(after.sparkSession, edges)
        if done:
            return after.select(F.col("b").alias("node"), F.col("a").alias("component")).union(after.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        edges = after


def group_edges(rows: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of a table that is sorted by keys begin and end; nulls are a group."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        code = rows.column(key).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    low = np.flatnonzero(new)
    return low, np.append(low[1:], len(rows))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of many whole groups each, from batches that are sorted by keys; a group may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([*held, batch])
            last = int(group_edges(rows, keys)[0][-1])
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def task_tables(batches: Iterator[pa.RecordBatch], column: str = "task") -> Iterator[pa.Table]:
    """The rows of each task, from batches that are sorted by task; a task's rows may go over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(column)[0].as_py() != task[s]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)
