"""Batches that are due by count or by age, told by the stream itself.

The state is how many rows came in each second and aren't in a batch yet, so it
has at most max_wait + 1 entries, whatever the stream brings. Tasks count what
they read; one row for each goes to the task that keeps the state.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import files
from . import jobs

DUE = "batch long, n long, by string, waited double"
WAITING = "seconds array<long>, counts array<long>, batch long"


def take(waiting: list[tuple[int, int]], now: float, max_size: int, max_wait: float, batch: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, float]]]:
    """(what waits on, batches that are due). waiting: (second, rows that came in it), oldest first.

    A batch is max_size rows, or all that wait if the oldest has waited max_wait seconds.
    """
    due, left, n, oldest = [], [], 0, None
    for second, count in waiting:
        while n + count >= max_size:
            oldest = second if oldest is None else oldest
            due.append((batch + len(due), max_size, "count", max(now - oldest, 0.0)))
            count -= max_size - n
            n, oldest, left = 0, None, []
        if count:
            n, oldest = n + count, second if oldest is None else oldest
            left.append((second, count))
    if left and now - left[0][0] >= max_wait:
        due.append((batch + len(due), n, "age", now - left[0][0]))
        left = []
    return left, due


def due_batches(arrivals: DataFrame, max_size: int = 100_000, max_wait: float = 900, heartbeat: bool = True) -> DataFrame:
    """A row for each batch that is due: its number, rows, whether count or age made it due, and how long its oldest row waited.

    arrivals: a stream with a row for each object that begins to wait; which
    columns it has makes no difference, nulls and repeated rows count like any
    other. Age is by processing time, from the micro-batch that read the row.
    heartbeat: a row each second that counts for nothing, so age is looked at
    though nothing comes. Spark's own timers sleep after a restart until
    something comes, and keep triggers that end by themselves from ending;
    these go without a heartbeat and look at age when rows come.
    """
    if max_size < 1:
        raise ValueError("max_size must be at least 1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(b.num_rows for b in batches)
        if n:
            yield pa.RecordBatch.from_pydict({"queue": pa.array([0], pa.int32()), "n": pa.array([n], pa.int64())})

    def fire(_: tuple, counts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, before, batch = state.get if state.exists else ([], [], 0)
        now = state.getCurrentProcessingTimeMs() / 1000
        came = sum(int(pdf["n"].sum()) for pdf in counts)
        rows = [*zip(seconds, before, strict=True), *([(int(now), came)] if came else [])]
        rows = [(second, sum(n for _, n in same)) for second, same in itertools.groupby(rows, key=lambda r: r[0])]
        left, due = take(rows, now, max_size, max_wait, batch)
        state.update(([s for s, _ in left], [n for _, n in left], batch + len(due)))
        if due:
            yield pd.DataFrame(due, columns=["batch", "n", "by", "waited"])

    # of the columns only their number of rows is needed, so none is moved to the workers
    rows = arrivals.select(F.lit(True).alias("row")).mapInArrow(count, "queue int, n long")
    if heartbeat:
        beats = arrivals.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load()
        rows = rows.union(beats.select(F.lit(0).alias("queue"), F.lit(0).cast("long").alias("n")))
    return rows.groupBy("queue").applyInPandasWithState(fire, DUE, WAITING, "append", GroupStateTimeout.NoTimeout)


def batch_stream(spark: SparkSession, tables: str, catalogs: list[DataFrame], checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, max_size: int = 100_000, max_wait: float = 900, seconds: float = 1, trigger: dict | None = None, **options: float) -> StreamingQuery:
    """Match a batch whenever one is due. Unlike batch_job, it reads stored states only then, not every 30 seconds.

    New alerts are counted as their files land. A micro-batch that failed or
    whose driver died is run again from the checkpoint: what it left QUEUED
    waits again at once, as no other job works on these tables. A checkpoint is
    of one kind of trigger: those that end by themselves have no heartbeat.
    """
    trigger = trigger or {"processingTime": f"{seconds} seconds"}
    arrivals = spark.readStream.schema(jobs.ALERTS).parquet(f"{tables}/alerts")

    def run(due: DataFrame, batch: int) -> None:
        begun = f"{checkpoint}/begun"
        n_due = due.count()
        if not n_due:
            return
        again = files.exists(spark, begun) and int(files.read_text(spark, begun)) >= batch
        files.replace(spark, begun, str(batch))
        with files.only_writer(spark, f"{tables}/batch.lock", 0 if again else 7600):
            for k in range(n_due):
                did = jobs.run_batch(spark, tables, catalogs, clock(), max_size, 0, **({**options, "stuck_after": 0} if again and not k else options))
                if did.error:  # its alerts wait again, and so does the signal
                    raise RuntimeError(did.error)

    stream = due_batches(arrivals, max_size, max_wait, "processingTime" in trigger).writeStream.foreachBatch(run).outputMode("append")
    return stream.option("checkpointLocation", checkpoint).trigger(**trigger).start()
