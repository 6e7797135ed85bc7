"""Registered queries of the alert jobs and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sky
from .functions.times import age_seconds, connection_error, from_mjd, from_unix, send_error
from .operators import batches, filters, ingest, normalize, notify
from .operators import crossmatch as cross
from .plans import tables as t
from .schema import CatalogSpec
from .sources import brokers, catalogs
from .sources.sinks import snapshot, work_folder

Query = Callable[[SparkSession, str], DataFrame]
ID = "lsst_diaobject_diaobjectid"
NOW = "2024-01-01 00:00:00"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _now():
    return F.lit(NOW).cast("timestamp")


# -- SQL parts for DuckDB -----------------------------------------------------------------------

_CATALOG = {name: sql.format(text="VARCHAR") for name, sql in t.CATALOGS.items()}
_PAIRS = """SELECT lsst_diaobject_diaobjectid, ra_deg, dec_deg, catalog_name, catalog_source_id, source_ra_deg, source_dec_deg, round(d, 6) AS match_distance_arcsec FROM (
  SELECT a.lsst_diaobject_diaobjectid, a.ra_deg, a.dec_deg, s.*, degrees(2 * asin(least(1.0, sqrt(
    sin(radians(source_dec_deg - dec_deg) / 2) ** 2 + cos(radians(dec_deg)) * cos(radians(source_dec_deg)) * sin(radians(source_ra_deg - ra_deg) / 2) ** 2)))) * 3600 AS d
  FROM alerts a JOIN sources s ON s.source_dec_deg BETWEEN a.dec_deg - {r} / 3600.0 - 1e-9 AND a.dec_deg + {r} / 3600.0 + 1e-9) WHERE d <= {r}"""
_NEAREST = "SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY lsst_diaobject_diaobjectid, catalog_name ORDER BY match_distance_arcsec, length(catalog_source_id), catalog_source_id) AS rank FROM pairs) WHERE rank <= {k}"


def _with(final: str, catalogs: tuple[str, ...] = ("dense",), radius: float = 1.0, k: int = 1) -> str:
    sources = " UNION ALL ".join(_CATALOG[c] for c in catalogs)
    return f"WITH alerts AS ({t.ALERTS}), sources AS ({sources}), pairs AS ({_PAIRS.format(r=radius)}), best AS ({_NEAREST.format(k=k)}) {final}"


_MATCH = "lsst_diaobject_diaobjectid, catalog_name, catalog_source_id, match_distance_arcsec, source_ra_deg, source_dec_deg"
_BOTH = ("dense", "sparse")
_STATE = "CASE WHEN CAST(catalog_source_id AS BIGINT) % 7 = 0 THEN 'failed' WHEN CAST(catalog_source_id AS BIGINT) % 7 <= 3 THEN 'sent' ELSE 'pending' END"


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return cross.crossmatch_catalogs(t.alerts(spark, d), [t.catalog(spark, d, c) for c in ("dense", "sparse", "far")])


def _notifications(spark: SparkSession, d: str, matches: DataFrame | None = None) -> DataFrame:
    rows = notify.notification_rows(matches if matches is not None else _matches(spark, d), _now())
    return rows.withColumn("state", F.expr(_STATE))


# HEALPix pixels of order 7, written out for DuckDB
_SPREAD = "(" + " + ".join(f"((({{v}} >> {k}) & 1) << {2 * k})" for k in range(7)) + ")"
_PIXELS = f"""WITH alerts AS ({t.ALERTS}), a AS (SELECT {ID}, sin(radians(dec_deg)) AS z, (ra_deg % 360) / 90 AS t FROM alerts),
  b AS (SELECT *, abs(z) <= 2.0 / 3 AS belt, least(3, floor(t))::BIGINT AS q, 128 * sqrt(3 * (1 - abs(z))) AS w, floor(128 * (0.5 + t) - 128 * z * 0.75)::BIGINT AS jp, floor(128 * (0.5 + t) + 128 * z * 0.75)::BIGINT AS jm FROM a),
  c AS (SELECT *, least(127, floor((t - q) * w))::BIGINT AS kp, least(127, floor((1 - (t - q)) * w))::BIGINT AS km FROM b),
  d AS (SELECT {ID}, CASE WHEN belt THEN CASE WHEN jp >> 7 = jm >> 7 THEN (jp >> 7) | 4 WHEN jp >> 7 < jm >> 7 THEN jp >> 7 ELSE (jm >> 7) + 8 END WHEN z >= 0 THEN q ELSE q + 8 END AS face,
    CASE WHEN belt THEN jm & 127 WHEN z >= 0 THEN 127 - km ELSE kp END AS x, CASE WHEN belt THEN 127 - (jp & 127) WHEN z >= 0 THEN 127 - kp ELSE km END AS y FROM c),
  pixels AS (SELECT {ID}, CAST((face << 14) + {_SPREAD.format(v="x")} + ({_SPREAD.format(v="y")} << 1) AS BIGINT) AS pixel7 FROM d)"""


# -- joins --------------------------------------------------------------------------------------


@query(_with(f"SELECT {_MATCH} FROM best"))
def join1_nearest_source(spark: SparkSession, d: str) -> DataFrame:
    return cross.crossmatch(t.alerts(spark, d), t.catalog(spark, d, "dense")).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH} FROM best", radius=2.0, k=3))
def join2_three_nearest(spark: SparkSession, d: str) -> DataFrame:
    return cross.crossmatch(t.alerts(spark, d), t.catalog(spark, d, "dense"), 2.0, 3).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH} FROM pairs"))
def join3_cone_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cross.cone_pairs(t.alerts(spark, d), t.catalog(spark, d, "dense")).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH}, 1 AS match_version FROM best", ("dense", "sparse", "far")))
def join4_all_catalogs(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select(*_MATCH.split(", "), "match_version")


@query(_with(f"SELECT {_MATCH} FROM pairs", radius=30.0))
def join5_wide_cones(spark: SparkSession, d: str) -> DataFrame:
    """Cones wider than the cells that are asked for: they reach over several zones and bins."""
    return cross.cone_pairs(t.alerts(spark, d), t.catalog(spark, d, "dense"), 30.0, cell_arcsec=7.0).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH} FROM best"))
def join7_prepared_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog written by declination zones, cut to those near an alert, then matched."""
    path = work_folder(spark, "catalog-dense")
    cross.prepare_catalog(t.catalog(spark, d, "dense"), path, max_rows=20_000)
    alerts = t.alerts(spark, d)
    return cross.crossmatch(alerts, cross.prune_catalog(spark.read.parquet(path), alerts)).select(*_MATCH.split(", "))


@query(_with(f"SELECT {_MATCH} FROM best", ("far",)))
def join6_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    return cross.crossmatch(t.alerts(spark, d), t.catalog(spark, d, "far")).select(*_MATCH.split(", "))


@query(_with(f"SELECT {ID}, ra_deg, dec_deg, status FROM alerts WHERE {ID} NOT IN (SELECT {ID} FROM best)"))
def join8_unmatched(spark: SparkSession, d: str) -> DataFrame:
    alerts = t.alerts(spark, d)
    return cross.unmatched(alerts, cross.crossmatch(alerts, t.catalog(spark, d, "dense"))).select(ID, "ra_deg", "dec_deg", "status")


@query(_with(f"SELECT {ID}, ra_deg, dec_deg, status FROM alerts WHERE {ID} IN (SELECT {ID} FROM best)"))
def join9_matched(spark: SparkSession, d: str) -> DataFrame:
    alerts = t.alerts(spark, d)
    return cross.matched(alerts, cross.crossmatch(alerts, t.catalog(spark, d, "dense"))).select(ID, "ra_deg", "dec_deg", "status")


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, 'hopskotch' AS destination, {_STATE} AS state, match_distance_arcsec FROM best", _BOTH))
def join10_link_matches(spark: SparkSession, d: str) -> DataFrame:
    matches = snapshot(_matches(spark, d), "matches")
    linked = cross.link_matches(_notifications(spark, d, matches), matches)
    return linked.select(ID, "catalog_name", "catalog_source_id", "destination", "state", "match_distance_arcsec")


@query(_with(f"SELECT a.{ID}, a.status, b.catalog_name, b.catalog_source_id, b.match_distance_arcsec FROM alerts a LEFT JOIN best b USING ({ID})", _BOTH))
def join11_annotated_alerts(spark: SparkSession, d: str) -> DataFrame:
    rows = cross.annotated_alerts(t.alerts(spark, d), _matches(spark, d))
    return rows.select(ID, "status", "catalog_name", "catalog_source_id", "match_distance_arcsec")


# -- aggregations -------------------------------------------------------------------------------

_AGE = f"(epoch_us(TIMESTAMP '{NOW}') - epoch_us({{}})) / 1e6"


@query(
    f"WITH alerts AS ({t.ALERTS}), s AS (SELECT count(*) FILTER (status = 'INGESTED') AS n_ingested, count(*) FILTER (status = 'QUEUED') AS n_queued, min(ingest_time) FILTER (status = 'INGESTED') AS oldest_ingested, min(ingest_time) FILTER (status = 'QUEUED') AS oldest_queued FROM alerts) "
    f"SELECT *, {_AGE.format('oldest_ingested')} AS ingested_age, {_AGE.format('oldest_queued')} AS queued_age FROM s"
)
def agg1_queue_state(spark: SparkSession, d: str) -> DataFrame:
    return batches.queue_state(t.alerts(spark, d), _now())


_DELIVERIES = f"SELECT 170055002004914000 + user_id AS {ID}, {t.BROKER} AS broker, CAST(ts AS TIMESTAMP) AS ingest_time, event_id FROM events"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "events")
    return spark.sql(_DELIVERIES)


@query(f"WITH d AS ({_DELIVERIES}) SELECT {ID}, string_agg(DISTINCT broker, ',' ORDER BY broker) AS brokers, count(DISTINCT broker) AS n_brokers, min(ingest_time) AS first_delivery FROM d GROUP BY 1")
def agg2_delivery_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.delivery_summary(_deliveries(spark, d))


@query(_with("SELECT catalog_name, count(*) AS matched, (SELECT count(*) FROM alerts) AS total FROM best GROUP BY 1", _BOTH))
def agg3_match_counts(spark: SparkSession, d: str) -> DataFrame:
    return batches.match_counts(_matches(spark, d), t.alerts(spark, d).count())


@query(_with(f"SELECT 'hopskotch' AS destination, count(*) FILTER (s = 'sent') AS n_sent, count(*) FILTER (s = 'failed') AS n_failed, count(*) FILTER (s = 'pending') AS n_pending FROM (SELECT {_STATE} AS s FROM best)", _BOTH))
def agg4_dispatch_counts(spark: SparkSession, d: str) -> DataFrame:
    return notify.dispatch_counts(_notifications(spark, d))


@query(_with(f"SELECT {ID} FROM best GROUP BY 1 HAVING bool_and({_STATE} = 'sent')", _BOTH))
def agg5_fully_sent(spark: SparkSession, d: str) -> DataFrame:
    return notify.fully_sent(_notifications(spark, d))


@query(
    _with("SELECT c AS catalog_name, n AS n_input, n AS n_valid, m AS n_matched, n - m AS n_no_match, 'ok' AS outcome, 1 AS match_version FROM (SELECT c, (SELECT count(*) FROM alerts) AS n, (SELECT count(DISTINCT lsst_diaobject_diaobjectid) FROM best WHERE catalog_name = c) AS m FROM (VALUES ('dense'), ('sparse'), ('far')) v(c))", ("dense", "sparse", "far"))
)
def agg6_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return batches.run_summary(t.alerts(spark, d), _matches(spark, d), ["dense", "sparse", "far"])


@query(
    _PIXELS + ", l AS (SELECT pixel7, k, pixel7 >> (2 * (7 - k)) AS tile FROM pixels, range(0, 8) r(k)), n AS (SELECT k, tile, count(*) AS c FROM l GROUP BY ALL), "
    "f AS (SELECT pixel7, min(k) AS k FROM l JOIN n USING (k, tile) WHERE c <= 500 OR k = 7 GROUP BY 1) SELECT CAST(f.k AS INT) AS tile_order, pixel7 >> (2 * (7 - f.k)) AS tile, count(*) AS n_rows FROM pixels JOIN f USING (pixel7) GROUP BY ALL"
)
def agg7_adaptive_tiles(spark: SparkSession, d: str) -> DataFrame:
    rows = batches.adaptive_tiles(t.alerts(spark, d), max_rows=500)
    return rows.groupBy("tile_order", "tile").agg(F.count("*").alias("n_rows"))


# -- ingest -------------------------------------------------------------------------------------


@query(f"WITH d AS ({_DELIVERIES}) SELECT {ID}, broker, ingest_time, event_id FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY ingest_time, broker, event_id) AS r FROM d) WHERE r = 1")
def win2_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_deliveries(_deliveries(spark, d), ["ingest_time", "broker", "event_id"])


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def win3_latest_source(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "events")
    return ingest.latest_source(spark.table("events"), "user_id", "ts", "event_id").select("user_id", "ts", "event_id", "event_type")


_RA, _DEC = t.position("user_id")
_CANONICAL = f"""SELECT 170055002004914000 + user_id AS {ID}, CASE WHEN {t.BROKER} = 'lasair' THEN NULL ELSE event_id END AS lsst_diasource_diasourceid, {t.BROKER} AS broker, date_trunc('second', ts + INTERVAL 500 MILLISECOND) AS event_second, {_RA} AS ra_deg, {_DEC} AS dec_deg, ts, CAST(170055002004914000 + user_id AS VARCHAR) AS named
 FROM events WHERE {t.BROKER} = 'lasair' OR CAST(json_extract(props, '$.k') AS DOUBLE) / 100 >= 0.6"""


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    m = t.messages(spark, d)
    of = lambda b: m.where(F.col("broker") == b)
    return normalize.one_stream({
        "antares": normalize.normalize_antares(filters.reliable(brokers.read_antares(of("antares")), 0.6, filters.RELIABILITY["antares"])),
        "lasair": normalize.normalize_lasair(brokers.read_lasair(of("lasair"))),
        "pittgoogle": normalize.normalize_pittgoogle(filters.reliable(brokers.read_pittgoogle(of("pittgoogle"))), _now()),
    })


@query(f"SELECT {ID}, lsst_diasource_diasourceid, broker, count(*) AS n FROM ({_CANONICAL}) GROUP BY ALL")
def set1_canonical_stream(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4..6, FLT-1..4 and SET-1 over all messages."""
    return _canonical(spark, d).groupBy(ID, "lsst_diasource_diasourceid", "broker").agg(F.count("*").alias("n"))


# times that went through a double may be a microsecond off, so seconds are rounded on both sides
_SECOND = "date_trunc('second', event_time + INTERVAL '0.5' SECOND)"


@query(f"SELECT {ID}, lsst_diasource_diasourceid, broker, ra_deg, dec_deg, event_second, named FROM ({_CANONICAL})")
def prj1_canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-1..4, FN-1/2: all columns of the canonical rows; of the payload the object's id."""
    named = F.regexp_extract("payload", r'[dD]iaObjectId":(\d+)', 1)
    return _canonical(spark, d).select(ID, "lsst_diasource_diasourceid", "broker", "ra_deg", "dec_deg", F.expr(_SECOND).alias("event_second"), named.alias("named"))


@query(f"WITH c AS ({_CANONICAL}) SELECT {ID}, lsst_diasource_diasourceid, event_second, ra_deg, 'INGESTED' AS status, 1 AS schema_version FROM (SELECT *, row_number() OVER (PARTITION BY {ID} ORDER BY ts, broker, lsst_diasource_diasourceid NULLS FIRST) AS r FROM c) WHERE r = 1 AND {ID} % 3 <> 0")
def set2_merge_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The winner of each object is compared too."""
    incoming = _canonical(spark, d)
    existing = incoming.where(F.col(ID) % 3 == 0).select(ID)
    fresh = ingest.merge_alerts(existing, incoming, _now(), ["event_time", "broker", "lsst_diasource_diasourceid"])
    return fresh.select(ID, "lsst_diasource_diasourceid", F.expr(_SECOND).alias("event_second"), "ra_deg", "status", "schema_version")


@query(f"WITH d AS ({_DELIVERIES}) SELECT {ID}, broker, min(ingest_time) AS ingest_time FROM d WHERE NOT (broker = 'lasair' AND {ID} % 2 = 0) GROUP BY 1, 2")
def set3_merge_deliveries(spark: SparkSession, d: str) -> DataFrame:
    rows = _deliveries(spark, d)
    existing = rows.where((F.col("broker") == "lasair") & (F.col(ID) % 2 == 0))
    return ingest.merge_deliveries(existing, rows, ["ingest_time"])


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, match_distance_arcsec, 1 AS match_version FROM best WHERE {ID} % 4 <> 0", _BOTH))
def set4_merge_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot(_matches(spark, d), "matches")
    return ingest.merge_matches(rows.where(F.col(ID) % 4 == 0), rows.unionByName(rows)).select(ID, "catalog_name", "catalog_source_id", "match_distance_arcsec", "match_version")


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, 2 AS match_version FROM best", _BOTH))
def set5_rematch(spark: SparkSession, d: str) -> DataFrame:
    """Alerts are matched again under another version beside the stored matches; those of another version hide nothing."""
    old = _matches(spark, d)
    again = cross.crossmatch_catalogs(t.alerts(spark, d), [t.catalog(spark, d, c) for c in _BOTH], match_version=2)
    return ingest.merge_matches(old, again).select(ID, "catalog_name", "catalog_source_id", "match_version")


# -- filters and projections ----------------------------------------------------------------------

_LASAIR = "SELECT event_id AS diaObjectId, CAST(user_id AS DOUBLE) AS ra, CAST(event_id % 90 AS DOUBLE) AS decl, 60000.0 + event_id AS firstDiaSourceMjdTai, event_id % 3 AS nDiaSources, value / 100 AS latestR, 60310 + CAST(event_id % 100 AS DOUBLE) / 50 AS lastDiaSourceMjdTai FROM events"


@query(f"SELECT diaObjectId, firstDiaSourceMjdTai, ra, decl FROM ({_LASAIR.replace('60000.0', 'CAST(60000 AS DOUBLE)')}) WHERE nDiaSources >= 1 AND latestR >= 0.6 AND 60311.5 - lastDiaSourceMjdTai < 1")
def flt3_lasair_filter(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "events")
    return filters.lasair_filter(spark.sql(_LASAIR.replace("60000.0", "CAST(60000 AS DOUBLE)").replace("60310", "CAST(60310 AS DOUBLE)")), 60311.5)


@query("SELECT event_id, event_type, CASE WHEN user_id % 10 = 0 THEN 'missing user' WHEN event_id % 7 = 0 THEN 'missing value' END AS reject_reason FROM events WHERE user_id % 10 = 0 OR event_id % 7 = 0")
def flt7_rejects(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "events")
    rows = spark.table("events").select("event_id", "event_type", F.expr("nullif(user_id, if(user_id % 10 = 0, user_id, -1))").alias("user"), F.expr("if(event_id % 7 = 0, null, value)").alias("value"))
    return filters.split_malformed(rows, ["user", "value"])[1].select("event_id", "event_type", "reject_reason")


_BAD = f"CASE {ID} % 10 WHEN 0 THEN NULL WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE ra_deg END"


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, ra_deg, dec_deg FROM a WHERE {ID} % 10 NOT IN (0, 1)")
def flt5_valid_coordinates(spark: SparkSession, d: str) -> DataFrame:
    rows = t.alerts(spark, d).withColumn("ra_deg", F.expr(_BAD))
    return filters.valid_coordinates(rows).select(ID, "ra_deg", "dec_deg")


@query("SELECT 'parts' AS catalog_name, CAST(p_partkey AS VARCHAR) AS catalog_source_id, CAST(p_size AS DOUBLE) AS source_ra_deg, CAST(p_retailprice AS DOUBLE) AS source_dec_deg, p_brand FROM part")
def src1_read_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.read_catalog(spark, CatalogSpec("parts", f"{d}/part.parquet", "p_partkey", "p_size", "p_retailprice"), ("p_brand",))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS catalog_source_id, '{"p_size":' || p_size || ',"p_brand":"' || p_brand || '"}' AS catalog_payload FROM part""")
def prj7_core_payload(spark: SparkSession, d: str) -> DataFrame:
    """A column of two keywords is written once; one that the catalog lacks is left out."""
    spec = CatalogSpec("parts", f"{d}/part.parquet", "p_partkey", "p_size", "p_retailprice", {"brightness": ("p_size", "p_brand"), "shape": ("p_brand", "nowhere")})
    return catalogs.read_with_payload(spark, spec).select("catalog_source_id", "catalog_payload")


_UUID = r"regexp_replace(md5(CAST({} AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')"


@query(f"WITH a AS ({t.ALERTS}) SELECT {_UUID.format(ID)} AS uuid, {ID}, ra_deg, dec_deg FROM a WHERE {ID} % 4 = 0")
def src7_load_batch(spark: SparkSession, d: str) -> DataFrame:
    alerts = t.alerts(spark, d).withColumn("uuid", normalize.alert_uuid(F.col(ID)))
    return batches.load_batch(alerts, alerts.where(F.col(ID) % 4 == 0))


@query("SELECT o_orderkey, make_timestamp(CAST(o_orderkey AS BIGINT) * 1000000000 + 250000) AS from_unix FROM orders")
def fn2_from_unix(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "orders")
    return spark.table("orders").select("o_orderkey", from_unix(F.expr("CAST(o_orderkey AS DOUBLE) * 1000D + 0.25D")).alias("from_unix"))


_LONG = "repeat(o_orderstatus, CAST(o_orderkey % 700 AS INT))"


@query(f"SELECT o_orderkey, substring({_LONG}, 1, 500) AS send_error, 'Connection error: ' || substring({_LONG}, 1, 480) AS connection_error FROM orders")
def fn7_error_texts(spark: SparkSession, d: str) -> DataFrame:
    t.register(spark, d, "orders")
    return spark.table("orders").select("o_orderkey", send_error(F.expr(_LONG)).alias("send_error"), connection_error(F.expr(_LONG)).alias("connection_error"))


_WHERE_TO = f"CASE {ID} % 3 WHEN 0 THEN 'hopskotch' WHEN 1 THEN 'elsewhere' END"


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, {_WHERE_TO} AS destination, {ID} % 3 = 0 AS known FROM best", _BOTH))
def snk1_route(spark: SparkSession, d: str) -> DataFrame:
    """Messages of unknown destinations, or none, are told apart and stay."""
    rows = _notifications(spark, d).withColumn("destination", F.expr(_WHERE_TO))
    known, unknown = notify.route(rows, {"hopskotch": lambda df: df})
    both = known["hopskotch"].withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
    return both.select(ID, "catalog_name", "catalog_source_id", "destination", "known")


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id, source_ra_deg AS ra, source_dec_deg AS dec, match_distance_arcsec AS separation_arcsec, 'hopskotch' AS destination, 'pending' AS state FROM best", _BOTH))
def prj6_notifications(spark: SparkSession, d: str) -> DataFrame:
    body = F.from_json("payload", "ra double, dec double, separation_arcsec double")
    rows = notify.notification_rows(_matches(spark, d), _now()).withColumn("b", body)
    return rows.select(ID, "catalog_name", "catalog_source_id", "b.ra", "b.dec", "b.separation_arcsec", "destination", "state")


@query(
    f"WITH a AS ({t.ALERTS}) SELECT {ID}, date_trunc('second', ingest_time) AS ingest_time, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ingest_time)) / 1e6 AS age, make_timestamp(CAST((CAST({ID} % 20000 AS DOUBLE) + 0.5 + 40000 - 40587) * 86400000000 AS BIGINT)) AS from_mjd FROM a"
)
def fn1_times(spark: SparkSession, d: str) -> DataFrame:
    a = t.alerts(spark, d)
    mjd = F.expr(f"CAST({ID} % 20000 AS DOUBLE) + 0.5D + 40000D")
    return a.select(ID, F.date_trunc("second", "ingest_time").alias("ingest_time"), age_seconds(_now(), F.col("ingest_time")).alias("age"), from_mjd(mjd).alias("from_mjd"))


@query(_PIXELS + f" SELECT {ID}, pixel7, pixel7 >> 8 AS pixel3 FROM pixels")
def fn5_healpix(spark: SparkSession, d: str) -> DataFrame:
    pixel = sky.healpix_nested(F.col("ra_deg"), F.col("dec_deg"), 7)
    return t.alerts(spark, d).select(ID, pixel.alias("pixel7"), sky.coarsen(pixel, 3, 7).alias("pixel3"))


# -- batches and states ---------------------------------------------------------------------------


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, ra_deg, dec_deg, ingest_time FROM a WHERE status IN ('INGESTED', 'QUEUED') ORDER BY ingest_time, {ID} LIMIT 1000")
def top1_select_batch(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the operator's own: a batch of the oldest 1000. The queued alerts are stuck by then and wait again."""
    return batches.select_batch(t.alerts(spark, d), _now(), max_size=1000).select(ID, "ra_deg", "dec_deg", "ingest_time")


@query(_with(f"SELECT {ID}, catalog_name, catalog_source_id FROM (SELECT *, {_STATE} AS s, sha256(concat_ws('|', {ID}, catalog_name, catalog_source_id, 1, 'hopskotch')) AS k FROM best) WHERE s = 'pending' ORDER BY k LIMIT 500", _BOTH))
def top2_select_pending(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the operator's own: the 500 oldest pending messages."""
    return notify.select_pending(_notifications(spark, d)).select(ID, "catalog_name", "catalog_source_id")


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, CASE WHEN {ID} % 5 = 0 THEN 'MATCHED' ELSE status END AS status FROM a")
def st2_batch_matched(spark: SparkSession, d: str) -> DataFrame:
    a = t.alerts(spark, d)
    return batches.set_status(a, a.where(F.col(ID) % 5 == 0), "MATCHED", ID).select(ID, "status")


@query(f"WITH a AS ({t.ALERTS}), b AS (SELECT {ID} FROM a WHERE status IN ('INGESTED', 'QUEUED') ORDER BY ingest_time, {ID} LIMIT 1000) SELECT {ID}, CASE WHEN {ID} IN (SELECT * FROM b) THEN 'QUEUED' ELSE status END AS status FROM a")
def st1_batch_queued(spark: SparkSession, d: str) -> DataFrame:
    """The cap is the batch's own."""
    a = t.alerts(spark, d)
    return batches.set_status(a, batches.select_batch(a, _now(), max_size=1000), "QUEUED", ID).select(ID, "status")


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, CASE WHEN status = 'QUEUED' AND {ID} % 2 = 0 THEN 'INGESTED' ELSE status END AS status FROM a")
def st3_batch_put_back(spark: SparkSession, d: str) -> DataFrame:
    a = t.alerts(spark, d)
    return batches.set_status(a, a.where((F.col("status") == "QUEUED") & (F.col(ID) % 2 == 0)), "INGESTED", ID).select(ID, "status")


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, CASE WHEN {ID} % 6 = 0 THEN 'NOTIFIED' WHEN {ID} % 2 = 0 THEN 'MATCHED' ELSE status END AS status FROM a")
def st_current_states(spark: SparkSession, d: str) -> DataFrame:
    """The states that the jobs' appended changes give."""
    a = t.alerts(spark, d)
    even, sixth = a.where(F.col(ID) % 2 == 0), a.where(F.col(ID) % 6 == 0)
    parts = [batches.status_changes(even, "QUEUED", _now(), 1), batches.status_changes(even, "MATCHED", _now(), 2), batches.status_changes(sixth, "NOTIFIED", _now(), 3)]
    return batches.current_alerts(a, parts[0].union(parts[1]).union(parts[2])).select(ID, "status")


@query(f"WITH a AS ({t.ALERTS}) SELECT {ID}, CASE WHEN status = 'QUEUED' THEN 'INGESTED' ELSE status END AS status FROM a")
def st4_recover_stuck(spark: SparkSession, d: str) -> DataFrame:
    return batches.recover_stuck(t.alerts(spark, d), _now()).select(ID, "status")


@query(_with(f"SELECT a.{ID}, CASE WHEN a.status = 'MATCHED' AND f.ok THEN 'NOTIFIED' ELSE a.status END AS status FROM alerts a LEFT JOIN (SELECT {ID}, bool_and({_STATE} = 'sent') AS ok FROM best GROUP BY 1) f USING ({ID})", _BOTH))
def st5_mark_notified(spark: SparkSession, d: str) -> DataFrame:
    return notify.mark_notified(t.alerts(spark, d), _notifications(spark, d)).select(ID, "status")


@query(
    _with(f"""SELECT {ID}, catalog_name, catalog_source_id, CASE WHEN s <> 'pending' THEN s WHEN m < 2 THEN 'sent' WHEN m < 4 THEN 'failed' ELSE s END AS state, CASE WHEN s = 'pending' AND m < 4 THEN 1 ELSE 0 END AS attempts,
      CASE WHEN s = 'pending' AND m IN (2, 3) THEN 'refused' END AS last_error FROM (SELECT *, {_STATE} AS s, CAST(catalog_source_id AS BIGINT) % 5 AS m FROM best)""", _BOTH)
)
def st6_send_results(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshot(_notifications(spark, d), "messages")
    m = F.col("catalog_source_id").cast("long") % 5
    results = rows.where((m < 4) & (F.col("state") == "pending")).select("notification_key", (m < 2).alias("ok"), F.when(m >= 2, "refused").alias("error"), F.lit(False).alias("connection"))
    return notify.apply_send_results(rows, results, _now()).select(ID, "catalog_name", "catalog_source_id", "state", "attempts", "last_error")
