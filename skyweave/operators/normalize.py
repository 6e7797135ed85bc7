"""Three message shapes to one canonical alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import from_mjd, from_unix


def kept_arrival(df: DataFrame) -> list[str]:
    return ["arrival"] if "arrival" in df.columns else []


def normalize_antares(df: DataFrame) -> DataFrame:
    """Flat, prefixed properties of the newest alert of a locus."""
    return df.select(
        F.col("lsst_diaObject_diaObjectId").alias("lsst_diaobject_diaobjectid"),
        F.col("lsst_diaObject_ra").alias("ra_deg"),
        F.col("lsst_diaObject_dec").alias("dec_deg"),
        F.col("lsst_diaSource_diaSourceId").alias("lsst_diasource_diasourceid"),
        from_unix(F.col("ant_time_received")).alias("event_time"),
        "payload",
        *kept_arrival(df),
    )


def normalize_lasair(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("diaObjectId").alias("lsst_diaobject_diaobjectid"),
        F.col("ra").alias("ra_deg"),
        F.col("decl").alias("dec_deg"),
        F.lit(None).cast("long").alias("lsst_diasource_diasourceid"),
        from_mjd(F.col("firstDiaSourceMjdTai")).alias("event_time"),
        "payload",
        *kept_arrival(df),
    )


def normalize_pittgoogle(df: DataFrame, now: Column) -> DataFrame:
    """Nested object and source; a zero or missing first date falls through to the second, then to now."""
    given = lambda c: F.when(F.col(c) != 0, F.col(c))
    mjd = F.coalesce(given("diaSource.midpointMjdTai"), given("diaSource.midPointTai"))
    return df.select(
        F.col("diaObject.diaObjectId").alias("lsst_diaobject_diaobjectid"),
        F.col("diaObject.ra").alias("ra_deg"),
        F.col("diaObject.dec").alias("dec_deg"),
        F.col("diaSource.diaSourceId").alias("lsst_diasource_diasourceid"),
        F.coalesce(from_mjd(mjd), now).alias("event_time"),
        "payload",
        *kept_arrival(df),
    )


def one_stream(frames: dict[str, DataFrame]) -> DataFrame:
    """Canonical rows of several brokers in one frame, with the broker's name."""
    named = [df.withColumn("broker", F.lit(name)) for name, df in sorted(frames.items())]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df)
    return out


def alert_uuid(object_id: Column) -> Column:
    """The same id each time a row is made again, formatted as a UUID."""
    return F.regexp_replace(F.md5(object_id.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
