"""Broker messages: parsing of JSON values, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import has_object_id
from ..schema import ANTARES_MESSAGE, JSON_OPTIONS, LASAIR_MESSAGE, PITTGOOGLE_MESSAGE


def _parsed(df: DataFrame, schema: str) -> DataFrame:
    """With message_, payload, and arrival: the stream's own time and offset where the frame has them, else null."""
    raw = F.col("value").cast("string")
    there = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
    arrival = F.struct(there("timestamp", "timestamp").alias("time"), there("offset", "long").alias("offset"))
    return df.select("*", F.from_json(raw, schema, JSON_OPTIONS).alias("message_"), raw.alias("payload"), arrival.alias("arrival"))


def read_antares(df: DataFrame) -> DataFrame:
    """Properties of the newest alert (the first) of each locus; those without an object id go."""
    rows = _parsed(df, ANTARES_MESSAGE).withColumn("newest_", F.get("message_.alerts", F.lit(0)).getField("properties"))
    return rows.select("newest_.*", "payload", "arrival").transform(has_object_id, "lsst_diaObject_diaObjectId")


def read_lasair(df: DataFrame) -> DataFrame:
    return _parsed(df, LASAIR_MESSAGE).select("message_.*", "payload", "arrival")


def read_pittgoogle(df: DataFrame) -> DataFrame:
    """Messages whose attributes name an object. df: value, and attributes as a map."""
    rows = _parsed(df.where(F.col("attributes")["diaObject_diaObjectId"].isNotNull()), PITTGOOGLE_MESSAGE)
    return rows.select("message_.*", "payload", "arrival")


def kafka_stream(spark: SparkSession, servers: str, topic: str, batch_size: int = 100_000, max_delay: str = "900s", start: str = "earliest", **options: str) -> DataFrame:
    """A Kafka stream that fires at so many messages or after so long, and takes at most that many at once."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    reader = reader.option("minOffsetsPerTrigger", batch_size).option("maxTriggerDelay", max_delay).option("maxOffsetsPerTrigger", batch_size)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
