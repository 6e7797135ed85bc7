"""Alerts and deliveries: what is new against the stored tables. First deliveries win; rows are never changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .normalize import alert_uuid

ALERT = "lsst_diaobject_diaobjectid"


#: Keys of a batch up to so many rows (some 40 bytes each) are broadcast to the stored tables.
BROADCAST_ROWS = 1_000_000
#: What stored matches are known by.
MATCH_KEY = [ALERT, "catalog_name", "catalog_source_id", "match_version"]


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, as a minimum: each task sends its own first alone."""
    first = F.min(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct("*").alias("row")))
    return rows.groupBy(*(F.col(c).alias(f"key{k}_") for k, c in enumerate(keys))).agg(first.alias("first")).select("first.row.*")


def first_deliveries(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row of each object: the first to arrive, by `order`; nulls come first. Only the first of each task is shuffled, so a payload travels once at most for each."""
    return _first(rows, [ALERT], order)


def latest_source(rows: DataFrame, object_id: str, mjd: str, source_id: str) -> DataFrame:
    """The newest source of each object; equal dates by the larger source id."""
    rank = F.row_number().over(Window.partitionBy(object_id).orderBy(F.desc(mjd), F.desc(source_id)))
    return rows.withColumn("rank_", rank).where("rank_ = 1").drop("rank_")


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None, batch_rows: int | None = None) -> DataFrame:
    """Incoming rows whose key isn't stored, one of each key (the first by order).

    batch_rows: how many rows come in, where the caller knows. Up to
    BROADCAST_ROWS their keys are broadcast and the stored keys are cut to these
    as they are read, so a long history isn't shuffled. Beyond that, or unknown,
    Spark joins as it sees fit.
    """
    incoming = _first(incoming, keys, order) if order else incoming.dropDuplicates(keys)
    stored = existing.select(*keys)
    if batch_rows is not None and batch_rows <= BROADCAST_ROWS:
        stored = stored.join(F.broadcast(incoming.select(*keys)), keys, "left_semi")
    same = reduce(lambda a, b: a & b, (F.col(f"i.{k}") == F.col(f"e.{k}") for k in keys))
    return incoming.alias("i").join(stored.alias("e"), same, "left_anti")


def merge_alerts(existing: DataFrame, incoming: DataFrame, now: Column, order: list[str], batch_rows: int | None = None) -> DataFrame:
    """Rows to append to alerts: of each new object what arrived first."""
    fresh = new_rows(existing, incoming, [ALERT], order, batch_rows)
    return fresh.select(alert_uuid(F.col(ALERT)).alias("uuid"), ALERT, "lsst_diasource_diasourceid", "ra_deg", "dec_deg", "event_time", now.alias("ingest_time"), F.lit(1).alias("schema_version"), "payload", F.lit("INGESTED").alias("status"))


def merge_deliveries(existing: DataFrame, incoming: DataFrame, order: list[str], batch_rows: int | None = None) -> DataFrame:
    """Rows to append to deliveries: the first of each object and broker that isn't stored."""
    return new_rows(existing, incoming.select(ALERT, "broker", *order), [ALERT, "broker"], order, batch_rows)


def merge_matches(existing: DataFrame, incoming: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Rows to append to matches; another match_version adds rows beside the old ones."""
    return new_rows(existing, incoming, MATCH_KEY, ["match_distance_arcsec"], batch_rows)


def delivery_summary(deliveries: DataFrame) -> DataFrame:
    """The brokers that delivered each object, and the first delivery."""
    return deliveries.groupBy(ALERT).agg(F.array_join(F.sort_array(F.collect_set("broker")), ",").alias("brokers"), F.countDistinct("broker").alias("n_brokers"), F.min("ingest_time").alias("first_delivery"))
