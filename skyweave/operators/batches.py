"""When a batch is due, what is in it, and the states of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import age_seconds

INGESTED, QUEUED, MATCHED, NOTIFIED = "INGESTED", "QUEUED", "MATCHED", "NOTIFIED"


def queue_state(alerts: DataFrame, now: Column) -> DataFrame:
    """One row: how many alerts wait or are queued, and the age of the oldest of each."""
    is_in = lambda s: F.col("status") == s
    oldest = lambda s: F.min(F.when(is_in(s), F.col("ingest_time")))
    one = alerts.agg(F.count_if(is_in(INGESTED)).alias("n_ingested"), F.count_if(is_in(QUEUED)).alias("n_queued"), oldest(INGESTED).alias("oldest_ingested"), oldest(QUEUED).alias("oldest_queued"))
    return one.withColumn("ingested_age", age_seconds(now, F.col("oldest_ingested"))).withColumn("queued_age", age_seconds(now, F.col("oldest_queued")))


def recover_stuck(alerts: DataFrame, now: Column, stuck_after: float = 7600) -> DataFrame:
    """All queued alerts wait again if the oldest of them is that old; done before the thresholds are looked at."""
    state = queue_state(alerts, now).select((F.col("queued_age") >= stuck_after).alias("stuck_"))
    rows = alerts.join(F.broadcast(state))  # one row
    return rows.withColumn("status", F.when(F.col("stuck_") & (F.col("status") == QUEUED), INGESTED).otherwise(F.col("status"))).drop("stuck_")


def select_batch(alerts: DataFrame, now: Column, max_size: int = 100_000, max_wait: float = 900, stuck_after: float = 7600, object_id: str = "lsst_diaobject_diaobjectid") -> DataFrame:
    """The oldest waiting alerts, at most max_size; none unless there are that many or the oldest waited max_wait seconds, or while others are queued."""
    alerts = recover_stuck(alerts, now, stuck_after)
    state = queue_state(alerts, now)
    due = (F.col("n_queued") == 0) & (F.col("n_ingested") > 0) & ((F.col("n_ingested") >= max_size) | (F.col("ingested_age") >= max_wait))
    rows = alerts.where(F.col("status") == INGESTED).join(F.broadcast(state.select(due.alias("due_")))).where("due_").drop("due_")
    return rows.orderBy("ingest_time", object_id).limit(max_size)


def current_alerts(alerts: DataFrame, changes: DataFrame, object_id: str = "lsst_diaobject_diaobjectid") -> DataFrame:
    """alerts with the status that was set last. changes: (object id, status, at, step), appended by the jobs and never rewritten."""
    last = changes.groupBy(object_id).agg(F.max(F.struct("at", "step", F.col("status").alias("now_"))).alias("last_")).select(object_id, "last_.now_")
    return alerts.join(last, object_id, "left").withColumn("status", F.coalesce("now_", "status")).drop("now_")


def status_changes(rows: DataFrame, status: str, at: Column, step: int, object_id: str = "lsst_diaobject_diaobjectid") -> DataFrame:
    """Rows to append to changes; step orders those of one moment. What else the state table keeps of an alert goes along where rows have it."""
    kept = [c for c in ("uuid", "ra_deg", "dec_deg", "ingest_time") if c in rows.columns]
    return rows.select(object_id, F.lit(status).alias("status"), at.alias("at"), F.lit(step).alias("step"), *kept)


def load_batch(alerts: DataFrame, batch_ids: DataFrame, key: str = "uuid") -> DataFrame:
    return alerts.join(batch_ids.select(key), key, "left_semi").select(key, "lsst_diaobject_diaobjectid", "ra_deg", "dec_deg")


def set_status(alerts: DataFrame, batch_ids: DataFrame, status: str, key: str = "uuid") -> DataFrame:
    """alerts with the batch's rows in a new state: QUEUED when taken, MATCHED when done (matched or not), INGESTED when it failed."""
    marked = batch_ids.select(key).distinct().withColumn("in_batch_", F.lit(True))
    return alerts.join(marked, key, "left").withColumn("status", F.when(F.col("in_batch_"), status).otherwise(F.col("status"))).drop("in_batch_")


def match_counts(matches: DataFrame, total: int) -> DataFrame:
    return matches.groupBy("catalog_name").agg(F.count("*").alias("matched")).withColumn("total", F.lit(total).cast("long"))


def run_summary(batch: DataFrame, matches: DataFrame, catalogs: list[str], match_version: int = 1, failed: dict[str, str] | None = None) -> DataFrame:
    """A row for each catalog of a run: rows in, rows with a position, matched, no match, outcome."""
    found = matches.where(F.col("match_version") == match_version).groupBy("catalog_name").agg(F.countDistinct("lsst_diaobject_diaobjectid").alias("n_matched"))
    return _summary(batch, found, catalogs, match_version, failed)


def counted_summary(batch: DataFrame, n_matched: dict[str, int], catalogs: list[str], match_version: int = 1, failed: dict[str, str] | None = None) -> DataFrame:
    """run_summary where the alerts that each catalog matched were counted as they were found."""
    found = batch.sparkSession.createDataFrame(list(n_matched.items()), "catalog_name string, n_matched long")
    return _summary(batch, found, catalogs, match_version, failed)


def _summary(batch: DataFrame, found: DataFrame, catalogs: list[str], match_version: int, failed: dict[str, str] | None) -> DataFrame:
    failed = failed or {}
    spark = batch.sparkSession
    valid = F.coalesce(~F.isnan("ra_deg") & ~F.isnan("dec_deg"), F.lit(False))
    totals = batch.agg(F.count("*").alias("n_input"), F.count_if(valid).alias("n_valid"))
    names = spark.createDataFrame([(c, failed.get(c, "ok")) for c in catalogs], "catalog_name string, outcome string")
    rows = names.join(F.broadcast(totals)).join(found, "catalog_name", "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    return rows.select("catalog_name", "n_input", "n_valid", "n_matched", (F.col("n_valid") - F.col("n_matched")).alias("n_no_match"), "outcome", F.lit(match_version).alias("match_version"))


def adaptive_tiles(df: DataFrame, max_rows: int, lowest: int = 0, highest: int = 7, ra: str = "ra_deg", dec: str = "dec_deg", pixel: Column | None = None, most_tiles: int | None = None) -> DataFrame:
    """df with tile_order and tile: the coarsest HEALPix tile of each row that holds at most max_rows rows (the finest if none does). pixel: of order `highest`, where rows have it already.

    most_tiles: a tile may also hold the so-manieth part of all rows, which
    bounds the number of tiles (by about four times as many).
    """
    from ..functions.sky import healpix_nested

    rows = df.withColumn("pixel_", pixel if pixel is not None else healpix_nested(F.col(ra), F.col(dec), highest))
    counts = rows.groupBy("pixel_").agg(F.count("*").alias("n_"))  # at most 12 * 4**highest rows
    levels = F.explode(F.sequence(F.lit(lowest), F.lit(highest))).alias("tile_order")
    up = counts.select("pixel_", "n_", levels).withColumn("tile_", F.expr(f"shiftright(pixel_, 2 * ({highest} - tile_order))"))
    full = up.groupBy("tile_order", "tile_").agg(F.sum("n_").alias("sum_"))
    fits = (F.col("sum_") <= max_rows) | (F.col("tile_order") == highest)
    if most_tiles is not None:
        full = full.join(F.broadcast(counts.agg((F.sum("n_") / most_tiles).alias("part_"))))  # one row
        fits = fits | (F.col("sum_") <= F.col("part_"))
    chosen = up.join(full.where(fits).select("tile_order", "tile_"), ["tile_order", "tile_"]).groupBy("pixel_").agg(F.min("tile_order").alias("tile_order"))
    tile = F.expr(f"shiftright(pixel_, 2 * ({highest} - tile_order))")
    return rows.join(F.broadcast(chosen), "pixel_").withColumn("tile", tile).drop("pixel_")
