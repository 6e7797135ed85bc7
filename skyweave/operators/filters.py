"""Which messages and rows go on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each broker's messages carry the reliability.
RELIABILITY = {"antares": "lsst_diaSource_reliability", "lasair": "latestR", "pittgoogle": "diaSource.reliability"}


def check_threshold(value: float) -> float:
    """A finite number in [0, 1], or an error."""
    if not isinstance(value, int | float) or isinstance(value, bool) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"a reliability threshold is a number from 0 to 1, not {value!r}")
    return float(value)


def is_reliable(reliability: Column, threshold: float = 0.6) -> Column:
    """Spark sorts NaN above all numbers, so it is ruled out by name; null is false."""
    return F.coalesce(~F.isnan(reliability) & (reliability >= check_threshold(threshold)), F.lit(False))


def reliable(df: DataFrame, threshold: float = 0.6, column: str = RELIABILITY["pittgoogle"]) -> DataFrame:
    return df.where(is_reliable(F.col(column), threshold))


def lasair_filter(objects: DataFrame, now_mjd: float, threshold: float = 0.6) -> DataFrame:
    """Objects with a source, reliable, seen less than a day ago; four columns."""
    fresh = now_mjd - F.col("lastDiaSourceMjdTai") < 1
    kept = objects.where((F.col("nDiaSources") >= 1) & is_reliable(F.col("latestR"), threshold) & fresh)
    return kept.select("diaObjectId", "firstDiaSourceMjdTai", "ra", "decl")


def has_object_id(df: DataFrame, column: str = "lsst_diaobject_diaobjectid") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def valid_coordinates(df: DataFrame) -> DataFrame:
    """Rows whose position is neither null nor NaN."""
    return df.na.drop(subset=["ra_deg", "dec_deg"])


def with_reject_reason(df: DataFrame, required: list[str]) -> DataFrame:
    """df with reject_reason: the first required column that is missing, or null."""
    reason = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required), F.lit(None).cast("string"))
    return df.withColumn("reject_reason", reason)


def split_malformed(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with reject_reason) of one parsed frame; a reject is for good and never retried."""
    marked = with_reject_reason(df, required)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
