"""Alerts, catalogs and messages that the queries derive from the given tables, as SQL for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("orders", "lineitem", "part", "supplier", "events")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names or GIVEN:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def position(key: str) -> tuple[str, str]:
    return f"CAST(({key} * 137508) % 360000 AS DOUBLE) / CAST(1000 AS DOUBLE)", f"CAST(({key} * 7919) % 170001 AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(85 AS DOUBLE)"


def _shift(column: str, width: int, base: int) -> str:
    return f"CAST(({column} % {width}) - {base} AS DOUBLE) / CAST(36000 AS DOUBLE)"


_ra, _dec = position("o_orderkey")
ALERTS = f"""SELECT o_orderkey AS lsst_diaobject_diaobjectid, {_ra} AS ra_deg, {_dec} AS dec_deg, CAST(o_orderdate AS TIMESTAMP) AS ingest_time,
  CASE o_orderstatus WHEN 'O' THEN 'INGESTED' WHEN 'F' THEN 'MATCHED' ELSE 'QUEUED' END AS status FROM orders"""
_ra, _dec = position("l_orderkey")
DENSE = f"""SELECT 'dense' AS catalog_name, CAST(((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS {{text}}) AS catalog_source_id,
  ({_ra} + {_shift('l_suppkey', 41, 20)} + CAST(360 AS DOUBLE)) % CAST(360 AS DOUBLE) AS source_ra_deg, {_dec} + {_shift('l_partkey', 41, 20)} AS source_dec_deg FROM lineitem"""
_ra, _dec = position("p_partkey")
SPARSE = f"""SELECT 'sparse' AS catalog_name, CAST(p_partkey AS {{text}}) AS catalog_source_id, {_ra} AS source_ra_deg, {_dec} + {_shift('p_size', 21, 0)} AS source_dec_deg FROM part"""
FAR = """SELECT 'far' AS catalog_name, CAST(s_suppkey AS {text}) AS catalog_source_id, CAST(s_suppkey % 360 AS DOUBLE) AS source_ra_deg,
  CAST(88 AS DOUBLE) + CAST(s_suppkey AS DOUBLE) / CAST(10000 AS DOUBLE) AS source_dec_deg FROM supplier"""
CATALOGS = {"dense": DENSE, "sparse": SPARSE, "far": FAR}
BROKER = "CASE WHEN event_type IN ('click', 'signup') THEN 'antares' WHEN event_type = 'view' THEN 'lasair' ELSE 'pittgoogle' END"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "orders")
    return spark.sql(ALERTS)


def catalog(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, {"dense": "lineitem", "sparse": "part", "far": "supplier"}[name])
    return spark.sql(CATALOGS[name].format(text="STRING"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broker messages as JSON, a row for each event: broker, value, attributes, reliability k/100."""
    register(spark, sf_dir, "events")
    ra, dec = position("user_id")
    return spark.sql(f"""
      SELECT event_id, ts, {BROKER} AS broker, map('diaObject_diaObjectId', CAST(170055002004914000 + user_id AS STRING)) AS attributes,
        CASE {BROKER}
          WHEN 'antares' THEN to_json(named_struct('alerts', array(named_struct('properties', named_struct(
            'lsst_diaObject_diaObjectId', 170055002004914000 + user_id, 'lsst_diaObject_ra', {ra}, 'lsst_diaObject_dec', {dec},
            'lsst_diaSource_diaSourceId', event_id, 'lsst_diaSource_reliability', CAST(get_json_object(props, '$.k') AS DOUBLE) / 100D,
            'ant_time_received', CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 1e6D))), 'locus_id', CAST(event_id AS STRING)))
          WHEN 'lasair' THEN to_json(named_struct('diaObjectId', 170055002004914000 + user_id, 'ra', {ra}, 'decl', {dec},
            'firstDiaSourceMjdTai', CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 86400e6D + 40587D))
          ELSE to_json(named_struct('diaObject', named_struct('diaObjectId', 170055002004914000 + user_id, 'ra', {ra}, 'dec', {dec}),
            'diaSource', named_struct('diaSourceId', event_id, 'reliability', CAST(get_json_object(props, '$.k') AS DOUBLE) / 100D,
            'midpointMjdTai', CAST(unix_micros(CAST(ts AS TIMESTAMP)) AS DOUBLE) / 86400e6D + 40587D))) END AS value
      FROM events""")
