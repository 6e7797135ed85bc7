"""Structured Streaming jobs: ingest, matching and dispatch, each safe to run again over the same input.

Tables are plain Parquet folders. A micro-batch appends only rows whose keys
aren't stored, so a batch that runs again after a failure adds nothing twice,
and there is no streaming state that would grow. States of alerts and messages
are state tables (sources.states): changes are appended, and compactions make
snapshots of them by day and state, so a tick reads open rows and new changes
only. One job of a kind works on a set of tables; a lock file sees to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import crossmatch as cross
from ..operators import batches, filters, ingest, normalize, notify
from ..sources import brokers
from ..sources import files
from ..sources.key_index import KeyIndex
from ..sources.outbox import LoggedSender
from ..sources.sinks import append_table, isolated, snapshot
from ..sources.states import States

ALERTS = "uuid string, lsst_diaobject_diaobjectid long, lsst_diasource_diasourceid long, ra_deg double, dec_deg double, event_time timestamp, ingest_time timestamp, schema_version int, payload string, status string"
DELIVERIES = "lsst_diaobject_diaobjectid long, broker string, ingest_time timestamp"
MATCHES = "lsst_diaobject_diaobjectid long, catalog_name string, catalog_source_id string, match_distance_arcsec double, match_score double, source_ra_deg double, source_dec_deg double, catalog_payload string, match_version int"
CHANGES = "lsst_diaobject_diaobjectid long, status string, at timestamp, step int, uuid string, ra_deg double, dec_deg double, ingest_time timestamp"
NOTIFICATIONS = "notification_key string, lsst_diaobject_diaobjectid long, catalog_name string, catalog_source_id string, match_version int, destination string, payload string, state string, attempts int, last_error string, created_at timestamp, updated_at timestamp, sent_at timestamp"
SENDS = "notification_key string, lsst_diaobject_diaobjectid long, destination string, payload string, created_at timestamp, alert_time timestamp, state string, attempts int, last_error string, updated_at timestamp, sent_at timestamp"
LETTERS = "letter_key string, payload string, broker string, reject_reason string, ingest_time timestamp"
REQUIRED = ["lsst_diaobject_diaobjectid", "ra_deg", "dec_deg", "event_time", "payload"]


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of Parquet files; empty while there is no folder."""
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def alert_states(tables: str) -> States:
    """States of alerts with what a batch needs of them. The first change (step -1) never goes over a later one."""
    return States(f"{tables}/alert_states", CHANGES, cross.ALERT, "status", "ingest_time", "struct(step >= 0, at, step)", ("uuid", "ra_deg", "dec_deg", "ingest_time"))


def message_states(tables: str) -> States:
    """States of messages with what sending needs of them; of sent ones the body isn't kept here."""
    return States(f"{tables}/notification_states", SENDS, notify.KEY, "state", "created_at", "struct(attempts, updated_at)", (cross.ALERT, "destination", "payload", "created_at", "alert_time"), ("sent", ("payload",)))


#: Tables that micro-batches are merged with, by object id.
INDEXED = {"alerts": ALERTS, "alert_deliveries": DELIVERIES, "catalog_matches": MATCHES, "notifications": NOTIFICATIONS}


def key_index(tables: str, name: str) -> KeyIndex:
    return KeyIndex(f"{tables}/{name}", f"{tables}/key_index/{name}", cross.ALERT, INDEXED[name])


def history(spark: SparkSession, tables: str, name: str, incoming: DataFrame) -> DataFrame:
    """What is stored in files that may hold the objects of incoming."""
    return key_index(tables, name).history(spark, incoming)


def canonical(broker: str, df: DataFrame, now: Column, threshold: float = 0.6) -> DataFrame:
    """Messages (value, and attributes for pittgoogle) of one broker to canonical rows."""
    if broker == "antares":
        return normalize.normalize_antares(filters.reliable(brokers.read_antares(df), threshold, filters.RELIABILITY[broker]))
    if broker == "lasair":  # filtered at the broker
        return normalize.normalize_lasair(brokers.read_lasair(df))
    if broker == "pittgoogle":
        return normalize.normalize_pittgoogle(filters.reliable(brokers.read_pittgoogle(df), threshold), now)
    raise ValueError(f"unknown broker {broker!r}")


def ingest_batch(rows: DataFrame, tables: str, now: Column, again: bool = False) -> None:
    """Append the new alerts, their states, deliveries and rejects of canonical rows (with broker). Messages are parsed once; of an object what arrived first wins.

    again: rows that were begun before and may be stored in part: what has a
    state then gets no second one.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("ingest_time", now)
    if "arrival" not in rows.columns:
        rows = rows.withColumn("arrival", F.lit(None).cast("struct<time: timestamp, offset: bigint>"))
    rows = rows.persist()
    try:
        n = rows.count()
        good, bad = filters.split_malformed(rows, REQUIRED)
        alerts = snapshot(ingest.merge_alerts(history(spark, tables, "alerts", good), good, now, ["arrival", "broker", "event_time"], n), "alerts")
        first, states = batches.status_changes(alerts, batches.INGESTED, now, -1), alert_states(tables)
        if again:
            first = ingest.new_rows(states.current(spark), first, [cross.ALERT], batch_rows=n)
        states.append(first)
        append_table(alerts, f"{tables}/alerts")
        deliveries = ingest.merge_deliveries(history(spark, tables, "alert_deliveries", good), good, ["ingest_time"], n)
        append_table(deliveries, f"{tables}/alert_deliveries")
        letters = bad.withColumn("letter_key", F.sha2(F.concat_ws("|", "broker", "reject_reason", F.to_json("arrival"), "payload"), 256))
        append_table(ingest.new_rows(stored(spark, f"{tables}/dead_letters", LETTERS), letters, ["letter_key"], batch_rows=n), f"{tables}/dead_letters")
    finally:
        rows.unpersist()


def ingest_stream(messages: DataFrame, broker: str, tables: str, checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, threshold: float = 0.6, trigger: dict | None = None, repeats_within: str | None = None) -> StreamingQuery:
    """A broker's stream into the tables; a transient failure replays the batch from the checkpoint.

    repeats_within: drop messages that a stream with a timestamp repeats within so long, before they are parsed.
    """

    def upsert(df: DataFrame, batch: int) -> None:
        now, spark = clock(), df.sparkSession
        begun = f"{checkpoint}/begun"
        last = int(files.read_text(spark, begun)) if files.exists(spark, begun) else -1
        files.replace(spark, begun, str(batch))
        rows = canonical(broker, df, now, threshold).withColumn("broker", F.lit(broker))
        ingest_batch(rows, tables, now, again=batch <= last)

    if repeats_within:
        messages = deduplicated(messages, "timestamp", ["value"], repeats_within)
    return messages.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingest_kafka(spark: SparkSession, broker: str, servers: str, topic: str, tables: str, checkpoint: str, threshold: float = 0.6, batch_size: int = 100_000, max_delay: str = "900s", repeats_within: str | None = None, **options: str) -> StreamingQuery:
    """A broker's Kafka topic into the tables, as many messages at once or after so long; it goes on until it is stopped."""
    messages = brokers.kafka_stream(spark, servers, topic, batch_size, max_delay, **options)
    return ingest_stream(messages, broker, tables, checkpoint, threshold=threshold, trigger={"processingTime": "1 second"}, repeats_within=repeats_within)


def match_batch(alerts: DataFrame, catalogs: list[DataFrame | cross.PayloadCatalog], tables: str, now: Column, radius_arcsec: float = 1.0, match_version: int = 1, dedupe: bool = True) -> dict[str, str]:
    """Match alerts with static catalogs and append new matches and their messages, one catalog after another.

    A catalog that fails is told by its name, in what is returned and in the
    run's summary (table match_runs); the others' matches are stored. Matches
    are counted as they are found, so stored ones are read once, for their keys.
    dedupe: messages only for matches that weren't stored; else one for each match found.
    """
    spark = alerts.sparkSession
    alerts = alerts.persist()
    try:
        n = alerts.count()  # alerts that can't be read fail the batch, not its catalogs
        named: dict[str, DataFrame | cross.PayloadCatalog] = {}
        for k, c in enumerate(catalogs):
            name = c.spec.name if isinstance(c, cross.PayloadCatalog) else _catalog_name(c, k)
            named[f"{name} ({k})" if name in named else name] = c
        counts: dict[str, int] = {}

        def match(name: str, catalog: DataFrame | cross.PayloadCatalog) -> None:
            sources = catalog.positions if isinstance(catalog, cross.PayloadCatalog) else catalog
            if cross.is_prepared(sources):  # only the folders near an alert are read
                sources = cross.prune_catalog(sources, alerts, radius_arcsec)
            found = cross.crossmatch_catalogs(alerts, [sources], radius_arcsec, match_version, n).persist()
            try:
                many = found.count()
                fresh = ingest.merge_matches(history(spark, tables, "catalog_matches", found), found, many)
                if isinstance(catalog, cross.PayloadCatalog):
                    fresh = cross.with_payloads(snapshot(fresh, "found"), catalog, many)
                fresh = snapshot(fresh, "matches")
                # messages first, keyed like the matches: a run that fails between the two makes the same messages again
                messages = snapshot(_new_messages(spark, notify.notification_rows(fresh if dedupe else found, now), tables, dedupe, many), "messages")
                message_states(tables).append(_message_changes(messages, alerts))
                append_table(messages, f"{tables}/notifications")
                append_table(fresh, f"{tables}/catalog_matches", "catalog_name")
                counts[name] = many
            finally:
                found.unpersist()

        failed = isolated({name: lambda name=name, c=c: match(name, c) for name, c in named.items()})
        append_table(batches.counted_summary(alerts, counts, list(named), match_version, failed).withColumn("run_time", now), f"{tables}/match_runs")
        return failed
    finally:
        alerts.unpersist()


def _message_changes(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """The first states of messages, with the time of their alerts where that is known (it tells the day of their states)."""
    if "ingest_time" not in alerts.columns:
        return messages.withColumn("alert_time", F.lit(None).cast("timestamp"))
    times = alerts.select(cross.ALERT, F.col("ingest_time").alias("alert_time"))
    return messages.join(times, cross.ALERT, "left")


def _catalog_name(catalog: DataFrame, place: int) -> str:
    """The name that a catalog's rows have; its place where there is none to read."""
    try:
        first = catalog.select("catalog_name").first()
    except Exception:  # noqa: BLE001  the catalog's own action tells it
        first = None
    return first[0] if first else f"catalog {place}"


def _new_messages(spark: SparkSession, rows: DataFrame, tables: str, dedupe: bool, n_rows: int) -> DataFrame:
    if not dedupe:
        return rows
    return ingest.new_rows(history(spark, tables, "notifications", rows), rows, [notify.KEY], batch_rows=n_rows)


def match_stream(alerts: DataFrame, catalogs: list[DataFrame], tables: str, checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, radius_arcsec: float = 1.0, trigger: dict | None = None) -> StreamingQuery:
    def run(df: DataFrame, _: int) -> None:
        match_batch(df, catalogs, tables, clock(), radius_arcsec)

    return alerts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class BatchRun:
    """What a tick of the batch job did: rows taken (0: no batch was due), catalogs that failed, and the error that put the batch back."""

    n_alerts: int = 0
    failed: dict[str, str] = field(default_factory=dict)
    error: str | None = None


def run_batch(spark: SparkSession, tables: str, catalogs: list[DataFrame], now: Column, max_size: int = 100_000, max_wait: float = 900, stuck_after: float = 7600, radius_arcsec: float = 1.0, match_version: int = 1) -> BatchRun:
    """One tick: stuck alerts wait again; if a batch is due its alerts become QUEUED, are matched, and become MATCHED, or INGESTED again if the batch fails.

    Only alerts that wait or are queued are read, and changes since the last
    compaction. A catalog that fails doesn't fail the batch.
    """
    states = alert_states(tables)
    alerts = snapshot(states.current(spark, [batches.INGESTED, batches.QUEUED]), "open")
    stuck = alerts.where(F.col("status") == batches.QUEUED).join(batches.recover_stuck(alerts, now, stuck_after).where(F.col("status") == batches.INGESTED).select(cross.ALERT), cross.ALERT, "left_semi")
    taken = snapshot(batches.select_batch(alerts, now, max_size, max_wait, stuck_after), "batch")
    run = BatchRun(taken.count())
    if not stuck.isEmpty():
        states.append(batches.status_changes(stuck, batches.INGESTED, now, 0))
    if not run.n_alerts:
        return run
    states.append(batches.status_changes(taken, batches.QUEUED, now, 1))
    try:
        run.failed = match_batch(taken.drop("status", "at", "step"), catalogs, tables, now, radius_arcsec, match_version)
        states.append(batches.status_changes(taken, batches.MATCHED, now, 2))
    except Exception as error:  # noqa: BLE001  the batch is put back and tried again
        run.error = str(error)[:500]
        states.append(batches.status_changes(taken, batches.INGESTED, now, 2))
    return run


def dispatch_round(spark: SparkSession, tables: str, senders: dict[str, Callable[[DataFrame], DataFrame]], now: Column, limit: int | None = 500) -> DataFrame:
    """One tick: the oldest pending messages are sent by destination and their states stored; alerts whose messages are all sent become NOTIFIED.

    limit: how many are sent at most, the rest with later ticks; None: all of them now.
    senders: from rows of a destination to their results (send_each, or
    send_results of a writer, or a LoggedSender, which sends nothing twice when
    a task or a round runs again). Messages of unknown destinations stay pending.
    What is stored are the results of this very sending: they are evaluated
    once, as they are written. Read are the messages that aren't sent, the
    matched alerts of the days of those that were, and changes since the last
    compaction. Returns the counts of this round.
    """
    states, alerts = message_states(tables), alert_states(tables)
    pending = snapshot(notify.select_pending(states.current(spark, ["pending"]), limit), "pending")
    known, rest = notify.route(pending, senders)
    tried = [notify.dispatch_counts(rest)]
    for name, rows in known.items():
        if not rows.isEmpty():
            after = snapshot(notify.apply_send_results(rows, senders[name](rows), now), "sent")
            states.append(after.where("state <> 'pending'"))
            tried.append(notify.dispatch_counts(after))
            if isinstance(senders[name], LoggedSender):
                senders[name].settle(spark, states.current(spark, ["pending"]))
    touched = pending.select(cross.ALERT, F.to_date("alert_time").cast("string").alias("day")).distinct()  # at most `limit` objects
    few = F.broadcast if limit is not None and limit <= cross.BROADCAST_ALERTS else lambda rows: rows  # else Spark joins as it sees fit
    days = {r[0] for r in touched.select("day").distinct().collect()}
    unsent = states.current(spark, ["pending", "failed"]).join(few(touched.select(cross.ALERT)), cross.ALERT, "left_semi")
    done = notify.sent_objects(touched, unsent)
    matched = alerts.current(spark, [batches.MATCHED], None if None in days else sorted(days))
    alerts.append(batches.status_changes(matched.join(few(done), cross.ALERT, "left_semi"), batches.NOTIFIED, now, 3))
    counts = [tuple(r) for c in tried for r in c.collect()]
    return spark.createDataFrame(counts, "destination string, n_sent long, n_failed long, n_pending long")


def compact_states(spark: SparkSession, tables: str) -> None:
    """New snapshots of both state tables, and entries of the files that the key indexes don't know."""
    for states in (alert_states(tables), message_states(tables)):
        states.compact(spark)
    for name in INDEXED:
        key_index(tables, name).update(spark)


def every(spark: SparkSession, seconds: float, action: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Run an action over the tables again and again; one that fails stops the query, which may be started again."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, __: action()).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def batch_job(spark: SparkSession, tables: str, catalogs: list[DataFrame], checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, seconds: float = 30, **options: float) -> StreamingQuery:
    """A batch as soon as there are max_size alerts or the oldest has waited max_wait seconds, looked at every 30 seconds."""
    return every(spark, seconds, lambda: _alone(spark, f"{tables}/batch.lock", lambda: run_batch(spark, tables, catalogs, clock(), **options)), checkpoint)


def dispatch_job(spark: SparkSession, tables: str, senders: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str, clock: Callable[[], Column] = F.current_timestamp, seconds: float = 10, limit: int | None = 500) -> StreamingQuery:
    return every(spark, seconds, lambda: _alone(spark, f"{tables}/dispatch.lock", lambda: dispatch_round(spark, tables, senders, clock(), limit)), checkpoint)


def compaction_job(spark: SparkSession, tables: str, checkpoint: str, seconds: float = 300) -> StreamingQuery:
    return every(spark, seconds, lambda: _alone(spark, f"{tables}/compaction.lock", lambda: compact_states(spark, tables)), checkpoint)


def _alone(spark: SparkSession, lock: str, action: Callable[[], object]) -> None:
    """Run a tick unless another job is in the middle of one over the same tables."""
    try:
        with files.only_writer(spark, lock):
            action()
    except files.Busy:
        pass


def deduplicated(messages: DataFrame, event_time: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """An optional filter before ingest, for streams: repeats within the broker's retention go."""
    return messages.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)

