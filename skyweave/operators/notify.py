"""Outgoing messages: one for each match, their states, and the alerts that are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERT = "lsst_diaobject_diaobjectid"
KEY = "notification_key"


def notification_rows(matches: DataFrame, now: Column, destination: str = "hopskotch") -> DataFrame:
    """One pending message for each match; its position is that of the catalog source."""
    body = F.to_json(F.struct(F.col(ALERT).alias("diaObjectId"), F.col("source_ra_deg").alias("ra"), F.col("source_dec_deg").alias("dec"), "catalog_name", "catalog_source_id", F.col("match_distance_arcsec").alias("separation_arcsec")))
    key = F.sha2(F.concat_ws("|", F.col(ALERT).cast("string"), "catalog_name", "catalog_source_id", F.col("match_version").cast("string"), F.lit(destination)), 256)
    return matches.select(key.alias(KEY), ALERT, "catalog_name", "catalog_source_id", "match_version", F.lit(destination).alias("destination"), body.alias("payload"), F.lit("pending").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("timestamp").alias("sent_at"))


def select_pending(notifications: DataFrame, limit: int | None = 500) -> DataFrame:
    """The oldest pending messages, or all of them."""
    pending = notifications.where("state = 'pending'")
    return pending if limit is None else pending.orderBy("created_at", KEY).limit(limit)


def route(notifications: DataFrame, writers: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows of each known destination, rows of unknown ones, which stay pending)."""
    known = {name: notifications.where(F.col("destination") == name) for name in writers}
    return known, notifications.where(~F.coalesce(F.col("destination").isin(list(writers)), F.lit(False)))


def apply_send_results(notifications: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """notifications after a dispatch. results: (notification_key, ok boolean, error, connection boolean).

    A connection error fails only those that are still pending.
    """
    r = results.select(F.col(KEY), F.col("ok").alias("ok_"), F.col("error").alias("error_"), F.coalesce("connection", F.lit(False)).alias("connection_"))
    rows = notifications.join(r, KEY, "left")
    sent = F.coalesce(F.col("ok_"), F.lit(False))
    failed = F.coalesce(~F.col("ok_") & (~F.col("connection_") | (F.col("state") == "pending")), F.lit(False))
    changed = {
        "state": F.when(sent, "sent").when(failed, "failed").otherwise(F.col("state")),
        "attempts": F.col("attempts") + F.when(sent | failed, 1).otherwise(0),
        "last_error": F.when(failed, F.substring("error_", 1, 500)).otherwise(F.col("last_error")),
        "sent_at": F.when(sent, now).otherwise(F.col("sent_at")),
        "updated_at": F.when(sent | failed, now).otherwise(F.col("updated_at")),
    }
    return rows.withColumns(changed).drop("ok_", "error_", "connection_")


#: What a dispatch changes of a message.
STATE = ["state", "attempts", "last_error", "updated_at", "sent_at"]


def current_messages(notifications: DataFrame, changes: DataFrame) -> DataFrame:
    """notifications with their last state. changes: (notification_key, STATE...), appended by dispatches and never rewritten."""
    last = changes.groupBy(KEY).agg(F.max(F.struct("attempts", "updated_at", *(F.col(c).alias(f"{c}_") for c in STATE))).alias("last_"))
    rows = notifications.join(last, KEY, "left")
    return rows.withColumns({c: F.when(F.col("last_").isNull(), F.col(c)).otherwise(F.col(f"last_.{c}_")) for c in STATE}).drop("last_")


def dispatch_counts(notifications: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return notifications.groupBy("destination").agg(count("sent"), count("failed"), count("pending"))


def fully_sent(notifications: DataFrame) -> DataFrame:
    """Objects all of whose messages are sent."""
    return notifications.groupBy(ALERT).agg(F.bool_and(F.col("state") == "sent").alias("all_")).where("all_").select(ALERT)


def sent_objects(touched: DataFrame, unsent: DataFrame) -> DataFrame:
    """Of the objects of a dispatch those that have no message left that isn't sent: what is sent already needn't be read."""
    return touched.select(ALERT).distinct().join(unsent.select(ALERT), ALERT, "left_anti")


def mark_notified(alerts: DataFrame, notifications: DataFrame) -> DataFrame:
    """Matched alerts all of whose messages are sent become NOTIFIED."""
    done = fully_sent(notifications).withColumn("done_", F.lit(True))
    rows = alerts.join(done, ALERT, "left")
    return rows.withColumn("status", F.when(F.col("done_") & (F.col("status") == "MATCHED"), "NOTIFIED").otherwise(F.col("status"))).drop("done_")
