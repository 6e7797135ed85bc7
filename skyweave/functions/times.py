"""Times and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_mjd(mjd: Column) -> Column:
    """UTC timestamp of a modified Julian date; the offset of TAI is ignored on purpose. NaN and null give null.

    Whole days and the rest are multiplied apart: both are exact then, and a time
    that was made into a double is found again to the microsecond (until 2038).
    """
    days = F.floor(mjd).cast("double")
    micros = (days - 40587) * F.lit(86400e6) + F.round((mjd - days) * F.lit(86400e6))
    return F.timestamp_micros(F.when(~F.isnan(mjd), micros).cast("long"))


def from_unix(seconds: Column) -> Column:
    """UTC timestamp of seconds since 1970, to the microsecond."""
    return F.timestamp_micros(F.when(~F.isnan(seconds), F.round(seconds * F.lit(1e6))).cast("long"))


def age_seconds(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(1e6)


def send_error(text: Column) -> Column:
    return F.substring(text, 1, 500)


def connection_error(text: Column) -> Column:
    return F.concat(F.lit("Connection error: "), F.substring(text, 1, 480))
