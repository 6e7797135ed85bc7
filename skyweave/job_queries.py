"""Registered queries that run whole jobs over the given tables into new folders and return what is stored then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import crossmatch as cross
from .operators import notify
from .plans import tables as t
from .queries import _CANONICAL, _MATCH, ID, _now, _with, query
from .schema import CatalogSpec
from .sources import catalogs, files
from .sources.landed import landed_stream
from .sources.outbox import LoggedSender
from .sources.sinks import send_results, snapshot, to_json_lines, work_folder
from .streaming import jobs
from .streaming.due import due_batches

_DENSE = t.CATALOGS["dense"].format(text="VARCHAR")


@query(_DENSE)
def src2_collection(spark: SparkSession, d: str) -> DataFrame:
    """A catalog that lies in a member of a collection, found by the collection's note."""
    path = work_folder(spark, "collection")
    rows = t.catalog(spark, d, "dense").select(F.col("catalog_source_id").alias("ID"), F.col("source_ra_deg").alias("RA"), F.col("source_dec_deg").alias("DEC"), F.lit(1).alias("unused"))
    rows.write.parquet(f"{path}/member/dataset")
    files.publish(spark, f"{path}/collection.properties", "obs_collection=dense\ndefault_catalog=member\n")
    return catalogs.read_catalog(spark, CatalogSpec("dense", path, "ID", "RA", "DEC"))


@query("""SELECT 'parts' AS catalog, column_name, count(*) OVER () AS n_columns, false AS failed FROM (DESCRIBE SELECT * FROM part) UNION ALL SELECT 'gone', NULL, NULL, true""")
def src3_catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of a catalog, and one that can't be read beside it."""
    specs = [CatalogSpec("parts", f"{d}/part.parquet", "p_partkey", "", ""), CatalogSpec("gone", f"{d}/nothing.parquet", "", "", "")]
    found = catalogs.catalog_columns(spark, specs)
    return found.select("catalog", F.col("column").alias("column_name"), F.col("n_columns").cast("long").alias("n_columns"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS catalog_source_id, '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '","p_type":"' || p_type || '"}' AS catalog_payload FROM part""")
def prj8_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flag columns after the payload's; one that is in both is written once."""
    spec = CatalogSpec("parts", f"{d}/part.parquet", "p_partkey", "p_size", "p_retailprice", {"brightness": ("p_size", "p_brand")}, ("p_type", "p_brand"))
    return catalogs.read_with_payload(spark, spec, quality_flags=True).select("catalog_source_id", "catalog_payload")


@query(_with(f"SELECT {_MATCH} FROM pairs"))
def join3_dense_fields(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, with smaller cells wherever one holds more than two sources."""
    alerts, sources = t.alerts(spark, d), t.catalog(spark, d, "dense")
    return cross.cone_pairs(alerts, sources, dense=cross.dense_cells(sources, 2)).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH} FROM pairs WHERE {ID} % 5 = 0", radius=60.0))
def join7_wide_cones_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Cones wider than parts of tiles lose nothing by the coverage map."""
    path = work_folder(spark, "catalog-tiles")
    cross.prepare_catalog(t.catalog(spark, d, "dense"), path, max_rows=500)
    alerts = t.alerts(spark, d).where(F.col(ID) % 5 == 0)
    return cross.cone_pairs(alerts, cross.prune_catalog(spark.read.parquet(path), alerts, 60.0), 60.0).select(*_MATCH.split(", "))


@query(_with(f"""SELECT {ID}, catalog_source_id, '{{"digits":' || length(catalog_source_id) || ',"even":' || CAST(CAST(catalog_source_id AS BIGINT) % 2 = 0 AS VARCHAR) || '}}' AS catalog_payload FROM best"""))
def join4_late_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Matches first, then payload columns of matched sources from tiles around them."""
    path = work_folder(spark, "catalog-payload")
    rows = t.catalog(spark, d, "dense").withColumn("digits", F.length("catalog_source_id")).withColumn("even", F.col("catalog_source_id").cast("long") % 2 == 0)
    cross.prepare_catalog(rows, path, max_rows=20_000)
    catalog = cross.PayloadCatalog(spark.read.parquet(path), CatalogSpec("dense", "", "", "", "", {"shape": ("digits",), "classification": ("even",)}))
    # written first, as in match_batch: what is read for the payloads depends on the matches, which would be made again
    found = snapshot(cross.crossmatch_catalogs(t.alerts(spark, d), [catalog.positions]), "found")
    return cross.with_payloads(found, catalog).select(ID, "catalog_source_id", "catalog_payload")


@query(f"SELECT DISTINCT {ID}, broker FROM ({_CANONICAL})")
def str2_ingest_streams(spark: SparkSession, d: str) -> DataFrame:
    """STR-1, STR-2, STR-7: a stream of each broker into the tables, one of them replayed from its beginning; the deliveries of stored alerts."""
    path = work_folder(spark, "ingest")
    t.messages(spark, d).select("broker", "value", "attributes").write.partitionBy("broker").json(f"{path}/in")
    for run, broker in enumerate(("antares", "lasair", "pittgoogle", "lasair")):
        stream = spark.readStream.schema("value string, attributes map<string, string>").json(f"{path}/in/broker={broker}")
        jobs.ingest_stream(stream, broker, f"{path}/tables", f"{path}/checkpoint-{run}", _now).awaitTermination()
    stored = spark.read.schema(jobs.DELIVERIES).parquet(f"{path}/tables/alert_deliveries")
    return stored.join(spark.read.schema(jobs.ALERTS).parquet(f"{path}/tables/alerts").select(ID), ID, "left_semi").select(ID, "broker")


@query(f"SELECT 'missing dec_deg' AS reject_reason, count(*) AS n FROM events WHERE {t.BROKER} = 'lasair' AND event_id % 7 = 0 HAVING count(*) > 0")
def str6_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Messages without a declination, read twice: each is one dead letter."""
    path = work_folder(spark, "letters")
    broken = F.when(F.col("event_id") % 7 == 0, F.regexp_replace("value", '"decl":[^,}]*', '"decl":null')).otherwise(F.col("value"))
    rows = t.messages(spark, d).where("broker = 'lasair'").select(broken.alias("value"), F.col("event_id").alias("offset"))
    for _ in range(2):
        jobs.ingest_batch(jobs.canonical("lasair", rows, _now()).withColumn("broker", F.lit("lasair")), path, _now())
    return spark.read.schema(jobs.LETTERS).parquet(f"{path}/dead_letters").groupBy("reject_reason").agg(F.count("*").alias("n"))


def _stored_alerts(spark: SparkSession, d: str, path: str) -> None:
    rows = t.alerts(spark, d).select(ID, "ra_deg", "dec_deg", F.lit(None).cast("long").alias("lsst_diasource_diasourceid"), F.lit("{}").alias("payload"), F.col("ingest_time").alias("event_time"), F.lit("lasair").alias("broker"))
    jobs.ingest_batch(rows, path, _now())


@query(_with(f"SELECT {ID}, CASE WHEN {ID} IN (SELECT {ID} FROM best) THEN 'NOTIFIED' ELSE 'MATCHED' END AS status FROM alerts", ("dense", "sparse")))
def str5_jobs_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    """STR-3 to STR-5, SNK-1, SNK-2: alerts are stored, matched as a batch and their messages sent, with compactions between; their states."""
    path = work_folder(spark, "jobs")
    _stored_alerts(spark, d, path)
    jobs.compact_states(spark, path)
    jobs.run_batch(spark, path, [t.catalog(spark, d, c) for c in ("dense", "sparse")], _now(), max_size=1_000_000, max_wait=0)
    senders = {"hopskotch": lambda rows: send_results(rows, to_json_lines(f"{path}/sent"))}
    jobs.dispatch_round(spark, path, senders, _now(), limit=1_000_000)
    jobs.compact_states(spark, path)
    return jobs.alert_states(path).current(spark).select(ID, "status")


@query("SELECT i AS batch, 100 AS n, 'count' AS due_by FROM range((SELECT count(*) // 100 FROM orders)) r(i)")
def str3_due_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches that a stream of alerts makes due by count; what is left waits for its age."""
    path = work_folder(spark, "due")
    t.alerts(spark, d).repartition(12).write.parquet(f"{path}/in")
    arrivals = spark.readStream.schema(f"{ID} long").option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
    due = due_batches(arrivals, 100, 1e9, heartbeat=False)
    due.writeStream.format("parquet").option("path", f"{path}/due").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/due").select("batch", "n", F.col("by").alias("due_by"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS message_id, CAST(170055002004914000 + user_id AS VARCHAR) AS object_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published FROM events WHERE {t.BROKER} = 'pittgoogle'")
def src6_landed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages that a subscription landed in files, read by two runs of one stream."""
    path = work_folder(spark, "landed")
    body = F.to_json(F.struct(F.base64("value").alias("data"), "attributes", F.col("event_id").cast("string").alias("messageId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("publishTime")))
    rows = t.messages(spark, d).where("broker = 'pittgoogle'").select("event_id", body.alias("value"))
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(f"{path}/in")
        stream = landed_stream(spark, f"{path}/in", f"{path}/log")
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    # the zone that messages are without is UTC, in the session as in the files
    return out.select("message_id", F.col("attributes")["diaObject_diaObjectId"].alias("object_id"), F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("published"))


def _refuses_tens():
    """A receiver that takes all messages but those of every tenth object."""

    def send(key: str, value: str) -> None:
        if int(key) % 10 == 0:
            raise ValueError("refused")

    return send


@query(_with(f"SELECT {ID}, CASE WHEN {ID} % 10 = 0 THEN 'failed' ELSE 'sent' END AS state, 1 AS attempts, CASE WHEN {ID} % 10 = 0 THEN 'refused' END AS last_error FROM best"))
def snk2_logged_sends(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all matches are sent by a dispatch that dies before it stores what came of them; the next one takes it over and sends none again."""
    path = work_folder(spark, "outbox")
    alerts = t.alerts(spark, d)
    found = cross.crossmatch_catalogs(alerts, [t.catalog(spark, d, "dense")])
    states = jobs.message_states(path)
    states.append(notify.notification_rows(found, _now()).join(alerts.select(ID, F.col("ingest_time").alias("alert_time")), ID, "left"))
    sender = LoggedSender(_refuses_tens, f"{path}/log", together=500)
    sender(states.current(spark, ["pending"]))
    jobs.dispatch_round(spark, path, {"hopskotch": sender}, _now(), limit=None)
    return states.current(spark).select(ID, "state", "attempts", "last_error")


_RUN = ("dense", "far")


def _matched_with_a_failure(spark: SparkSession, d: str) -> str:
    path = work_folder(spark, "matches")
    dense, far = (t.catalog(spark, d, c) for c in _RUN)
    jobs.match_batch(t.alerts(spark, d), [dense, far.where(F.raise_error(F.lit("gone")).isNull()), far], path, _now())
    return path


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, match_distance_arcsec, 1 AS match_version FROM best", _RUN))
def snk3_stored_matches(spark: SparkSession, d: str) -> DataFrame:
    """What a run stores, in folders by catalog; a catalog between them fails."""
    path = _matched_with_a_failure(spark, d)
    return jobs.stored(spark, f"{path}/catalog_matches", jobs.MATCHES).select(ID, "catalog_name", "catalog_source_id", "match_distance_arcsec", "match_version")


_RUNS = "SELECT '{0}' AS catalog_name, (SELECT count(*) FROM alerts) AS n_input, (SELECT count(*) FROM best WHERE catalog_name = '{0}') AS n_matched, {1} AS ok"


@query(_with(" UNION ALL ".join(_RUNS.format(*x) for x in (("dense", "true"), ("far", "true"), ("catalog 1", "false"))), _RUN))
def snk4_failing_catalog(spark: SparkSession, d: str) -> DataFrame:
    """A catalog that fails is told in the run's summary; the others are stored."""
    runs = spark.read.parquet(f"{_matched_with_a_failure(spark, d)}/match_runs")
    return runs.select("catalog_name", "n_input", "n_matched", (F.col("outcome") == "ok").alias("ok"))
