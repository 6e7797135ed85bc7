"""Writers of tables and messages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import connection_error, send_error

ALERT = "lsst_diaobject_diaobjectid"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that spark.checkpoint.dir names. Where that is unset only a local session gets one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="skyweave-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again. A persisted frame isn't the same: Spark makes it anew when a table that it reads is appended to."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def jdbc_append(df: DataFrame, url: str, name: str, batch_size: int = 5000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=str(batch_size), **options).mode("append").save()


def send_results(messages: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Write messages (key, value) as one batch; (notification_key, ok, error, connection) of each. A failed write fails its batch as a whole."""
    ok, error, lost = F.lit(True), F.lit(None).cast("string"), F.lit(False)
    try:
        write(messages.select(F.col(ALERT).cast("string").alias("key"), F.col("payload").alias("value")))
    except ConnectionError as failure:
        ok, error, lost = F.lit(False), connection_error(F.lit(str(failure))), F.lit(True)
    except Exception as failure:  # noqa: BLE001  recorded with the messages
        ok, error = F.lit(False), send_error(F.lit(str(failure)))
    return messages.select("notification_key", ok.alias("ok"), error.alias("error"), lost.alias("connection"))


def send_each(messages: DataFrame, connect: Callable[[], Callable[[str, str], None]]) -> DataFrame:
    """Send messages one by one, in parallel tasks; (notification_key, ok, error, connection) of each.

    connect() opens a task's connection and gives its send(key, value). A send
    that fails fails its message alone; a connection that fails or is lost
    fails what the task still has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send, lost = None, None
        for pdf in batches:
            out = []
            for name, key, value in zip(pdf["notification_key"], pdf["key"], pdf["value"], strict=True):
                try:
                    if lost is None:
                        send = send or connect()
                        send(key, value)
                    out.append((name, lost is None, lost, lost is not None))
                except ConnectionError as failure:
                    lost = str(failure)
                    out.append((name, False, lost, True))
                except Exception as failure:  # noqa: BLE001  recorded with the message
                    out.append((name, False, str(failure), False))
            yield pd.DataFrame(out, columns=["notification_key", "ok", "error", "connection"])

    rows = messages.select("notification_key", F.col(ALERT).cast("string").alias("key"), F.col("payload").alias("value"))
    sent = rows.mapInPandas(run, "notification_key string, ok boolean, error string, connection boolean")
    return sent.withColumn("error", F.when(F.col("connection"), connection_error(F.col("error"))).otherwise(send_error(F.col("error"))))


def to_kafka(servers: str, topic: str) -> Callable[[DataFrame], None]:
    return lambda df: df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def to_json_lines(path: str) -> Callable[[DataFrame], None]:
    return lambda df: df.select("value").write.mode("append").text(path)


def isolated(actions: dict[str, Callable[[], object]]) -> dict[str, str]:
    """One action for each catalog; a failure is told by its name and the rest go on."""
    failed = {}
    for name, action in actions.items():
        try:
            action()
        except Exception as error:  # noqa: BLE001  the outcome of this catalog
            failed[name] = str(error)[:500]
    return failed
