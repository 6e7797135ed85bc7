"""Hand-built rows for the alert operators, and the zone join against brute force."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.functions.sky import coarsen, healpix_nested
from skyweave.functions.times import connection_error, from_mjd, from_unix, send_error
from skyweave.operators import batches, crossmatch, filters, ingest, normalize, notify, payload
from skyweave.schema import CatalogSpec, survey_catalogs
from skyweave.sources import brokers, catalogs

ID = "lsst_diaobject_diaobjectid"
BIG = 170055002004914266


def separation(a, b):
    (r1, d1), (r2, d2) = np.radians(a), np.radians(b)
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h)))) * 3600


def frames(spark, alerts, sources):
    a = spark.createDataFrame([(i, float(r), float(d)) for i, (r, d) in enumerate(alerts)], f"{ID} long, ra_deg double, dec_deg double")
    s = spark.createDataFrame([("c", str(i), float(r), float(d)) for i, (r, d) in enumerate(sources)], "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double")
    return a, s


@pytest.mark.parametrize("radius", [1.0, 25.0])
def test_cone_pairs_are_all_pairs(spark, radius):
    rng = np.random.default_rng(int(radius))
    centres = [(0.0, 0.0), (359.9999, 10.0), (0.00005, -45.0), (120.0, 89.9999), (10.0, -90.0), (45.0, 90.0), (200.0, 60.0)]
    spread = radius / 3600
    alerts, sources = [], []
    for r, d in centres:
        scale = spread / max(math.cos(math.radians(d)), 0.01)
        for out, n in ((alerts, 8), (sources, 30)):
            for _ in range(n):
                out.append(((r + rng.uniform(-1.5, 1.5) * scale) % 360, float(np.clip(d + rng.uniform(-1.5, 1.5) * spread, -90, 90))))
    want = {(i, str(j)) for i, a in enumerate(alerts) for j, s in enumerate(sources) if separation(a, s) <= radius}
    got = [(r[0], r[1]) for r in crossmatch.cone_pairs(*frames(spark, alerts, sources), radius).select(ID, "catalog_source_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nearest_ties_and_missing_positions(spark):
    a, s = frames(spark, [(10, 0), (float("nan"), 1), (20, 0)], [(10, 0.0001), (10, -0.0001), (10, 0.00025)])
    one = crossmatch.crossmatch(a, s).collect()
    assert [(r[ID], r["catalog_source_id"]) for r in one] == [(0, "0")]
    assert crossmatch.crossmatch(a, s, 1.0, 5).count() == 3
    assert crossmatch.crossmatch(a, s.limit(0)).count() == 0
    assert {r[ID] for r in crossmatch.unmatched(a, crossmatch.crossmatch(a, s)).collect()} == {1, 2}


def test_prepared_catalog_is_pruned(spark, tmp_path):
    a, s = frames(spark, [(10, 4.99999), (20, -3)], [(10, 5.0), (20, -3), (30, 50)])
    crossmatch.prepare_catalog(s, str(tmp_path / "c"))
    near = crossmatch.prune_catalog(spark.read.parquet(str(tmp_path / "c")), a)
    assert {r["catalog_source_id"] for r in near.collect()} == {"0", "1"}


def test_reliability(spark):
    values = [("0.7", 1), ("0.6", 1), ("1", 1), ("0.5", 0), ("0.0", 0), ('"0.7"', 0), ('"NaN"', 0), ("NaN", 0), ('"Infinity"', 0), ("true", 0), ("null", 0)]
    rows = [(json.dumps({"a": 1}) if v is None else f'{{"diaObject":{{"diaObjectId":{k}}},"diaSource":{{"reliability":{v}}}}}', k) for k, (v, _) in enumerate(values)]
    rows += [('{"diaObject":{"diaObjectId":90}}', 90), ("not json", 91)]
    df = spark.createDataFrame([(v, {"diaObject_diaObjectId": str(k)}) for v, k in rows], "value string, attributes map<string,string>")
    kept = {r[0] for r in filters.reliable(brokers.read_pittgoogle(df)).select("diaObject.diaObjectId").collect()}
    assert kept == {k for k, (_, ok) in enumerate(values) if ok}
    for bad in (-1, 2, math.inf, math.nan, True, "0.5"):
        with pytest.raises(ValueError):
            filters.check_threshold(bad)


def test_three_shapes(spark):
    antares = {"locus_id": "x", "alerts": [{"properties": {"lsst_diaObject_diaObjectId": BIG, "lsst_diaObject_ra": 1.5, "lsst_diaObject_dec": -2.5, "lsst_diaSource_diaSourceId": 7, "ant_time_received": 1700000000.25}}]}
    lasair = {"diaObjectId": BIG, "ra": 1.0, "decl": 2.0, "firstDiaSourceMjdTai": 60000.5}
    pitt = {"diaObject": {"diaObjectId": BIG, "ra": 1.0, "dec": 2.0}, "diaSource": {"diaSourceId": 9, "midpointMjdTai": 0, "midPointTai": 60000.5}}
    frame = lambda m: spark.createDataFrame([(json.dumps(m), {"diaObject_diaObjectId": "1"})], "value string, attributes map<string,string>")
    now = F.lit("2030-01-01").cast("timestamp")
    rows = normalize.one_stream({
        "antares": normalize.normalize_antares(brokers.read_antares(frame(antares))),
        "lasair": normalize.normalize_lasair(brokers.read_lasair(frame(lasair))),
        "pittgoogle": normalize.normalize_pittgoogle(brokers.read_pittgoogle(frame(pitt)), now),
        "pittgoogle2": normalize.normalize_pittgoogle(brokers.read_pittgoogle(frame({"diaObject": pitt["diaObject"]})), now),
    }).orderBy("broker").collect()
    noon = datetime.datetime(2023, 2, 25, 12)
    assert [r[ID] for r in rows] == [BIG] * 4
    assert [r["event_time"] for r in rows] == [datetime.datetime(2023, 11, 14, 22, 13, 20, 250000), noon, noon, datetime.datetime(2030, 1, 1)]
    assert json.loads(rows[1]["payload"]) == lasair and rows[1]["lsst_diasource_diasourceid"] is None
    assert brokers.read_antares(frame({"alerts": []})).count() == 0


def test_times_and_errors(spark):
    r = spark.range(1).select(from_mjd(F.lit(float("nan"))).alias("a"), from_unix(F.lit(None).cast("double")).alias("b"), F.length(send_error(F.repeat(F.lit("x"), 900))).alias("c"), F.length(connection_error(F.repeat(F.lit("x"), 900))).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (None, None, 500, 498)


def test_first_delivery_wins(spark):
    t = [datetime.datetime(2024, 1, 1, 0, 0, k) for k in range(4)]
    rows = spark.createDataFrame([(1, "lasair", t[1], 5.0), (1, "antares", t[0], 6.0), (1, "antares", t[2], 7.0), (2, "lasair", t[3], 8.0)], f"{ID} long, broker string, ingest_time timestamp, ra_deg double")
    none = rows.limit(0)
    assert {(r[ID], r.ra_deg) for r in ingest.first_deliveries(rows, ["ingest_time"]).collect()} == {(1, 6.0), (2, 8.0)}
    new = ingest.merge_deliveries(none, rows, ["ingest_time"])
    assert new.count() == 3 and ingest.merge_deliveries(new, rows, ["ingest_time"]).count() == 0


def batch_frame(spark, n, age, status="INGESTED"):
    then = datetime.datetime(2024, 1, 1) - datetime.timedelta(seconds=age)
    return spark.createDataFrame([(k, then, status, 0.0, 0.0) for k in range(n)], f"{ID} long, ingest_time timestamp, status string, ra_deg double, dec_deg double")


@pytest.mark.parametrize(("n", "age", "want"), [(9, 10, 0), (10, 10, 10), (11, 10, 10), (3, 899, 0), (3, 900, 3)])
def test_batch_is_due(spark, n, age, want):
    now = F.lit("2024-01-01").cast("timestamp")
    assert batches.select_batch(batch_frame(spark, n, age), now, max_size=10).count() == want


def test_queued_alerts_block_until_stuck(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    waiting = batch_frame(spark, 3, 1000)
    assert batches.select_batch(waiting.union(batch_frame(spark, 1, 7599, "QUEUED")), now).count() == 0
    assert batches.select_batch(waiting.union(batch_frame(spark, 1, 7600, "QUEUED")), now).count() == 4


def test_messages(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    m = spark.createDataFrame([(k // 2, "c", str(k), 0.5, 1.0, 2.0, 1) for k in range(6)], f"{ID} long, catalog_name string, catalog_source_id string, match_distance_arcsec double, source_ra_deg double, source_dec_deg double, match_version int")
    rows = notify.notification_rows(m, now)
    assert list(json.loads(rows.first().payload)) == ["diaObjectId", "ra", "dec", "catalog_name", "catalog_source_id", "separation_arcsec"]
    assert notify.select_pending(rows, 4).count() == 4
    results = rows.select("notification_key", (F.col(ID) < 2).alias("ok"), F.lit("no").alias("error"), F.lit(True).alias("connection"))
    after = notify.apply_send_results(rows, results, now)
    assert {(r[ID], r.state, r.attempts) for r in after.collect()} == {(0, "sent", 1), (1, "sent", 1), (2, "failed", 1)}
    alerts = spark.createDataFrame([(0, "MATCHED"), (1, "QUEUED"), (2, "MATCHED"), (3, "MATCHED")], f"{ID} long, status string")
    assert {(r[ID], r.status) for r in notify.mark_notified(alerts, after).collect()} == {(0, "NOTIFIED"), (1, "QUEUED"), (2, "MATCHED"), (3, "MATCHED")}
    known, unknown = notify.route(rows.withColumn("destination", F.lit("elsewhere")), {"hopskotch": lambda df: df})
    assert known["hopskotch"].count() == 0 and unknown.count() == 6


def test_payload_and_catalog_sources(spark, tmp_path):
    root = tmp_path / "col"
    spark.createDataFrame([(BIG, 1.0, 2.0, 3.5, None)], "source_id long, RA double, Dec double, mag double, z double").write.parquet(str(root / "inner" / "dataset"))
    (root / "collection.properties").write_text("default_catalog=inner\n")
    spec = CatalogSpec("gaia", str(root), "source_id", "ra", "dec", {"brightness": ("mag", "z"), "shape": ("mag", "nowhere")})
    rows = catalogs.read_catalog(spark, spec, ("mag", "z"))
    assert rows.first()["catalog_source_id"] == str(BIG)
    assert payload.core_payload(rows, spec).first()["catalog_payload"] == '{"mag":3.5,"z":null}'
    assert payload.core_payload(rows, spec, keep_nulls=False).first()["catalog_payload"] == '{"mag":3.5}'
    table = catalogs.catalog_columns(spark, [spec, CatalogSpec("gone", str(tmp_path / "gone"), "a", "b", "c")]).collect()
    assert [r.column for r in table if r.catalog == "gaia"] == ["source_id", "RA", "Dec", "mag", "z"]
    assert [bool(r.error) for r in table if r.catalog == "gone"] == [True]


def test_collections_and_the_registry(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "source_id long, ra double, dec double, ruwe double, other double")
    for name in ("b_second", "a_first", "_hidden", ".dot"):
        frame.write.parquet(str(tmp_path / "col" / name))
    (tmp_path / "col" / "collection.properties").write_text("name=x\ndefault_catalog =\n")
    assert catalogs.resolve_catalog_root(spark, str(tmp_path / "col")).endswith("/a_first")
    assert catalogs.resolve_catalog_root(spark, str(tmp_path / "col" / "b_second")).endswith("/b_second")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "collection.properties").write_text("")
    with pytest.raises(FileNotFoundError):
        catalogs.resolve_catalog_root(spark, str(tmp_path / "none"))
    found = {c.name: c for c in survey_catalogs("s3://sky/")}
    assert list(found) == ["gaia_dr3", "des_y6_gold", "delve_dr3_gold", "skymapper_dr4"]
    assert found["des_y6_gold"].payload_columns["brightness"][:5] == tuple(f"MAG_AUTO_{b}" for b in "GRIZY")
    assert len(found["delve_dr3_gold"].payload_columns["psf"]) == 4 and found["gaia_dr3"].root == "s3://sky/gaia_dr3"
    own = {c.name: c.root for c in survey_catalogs(roots={"des_y6_gold": "/mine"})}
    assert own["des_y6_gold"] == "/mine" and own["gaia_dr3"].startswith("s3://stpubdata/") and len(set(own.values())) == 4
    gaia = CatalogSpec("gaia_dr3", str(tmp_path / "col"), "source_id", "ra", "dec", found["gaia_dr3"].payload_columns, ("other",))
    read = catalogs.read_with_payload(spark, gaia, quality_flags=True)
    assert read.first()["catalog_payload"] == '{"ra":2.0,"dec":3.0,"ruwe":4.0,"other":5.0}'
    alerts = spark.createDataFrame([(7, 2.0, 3.0)], f"{ID} long, ra_deg double, dec_deg double")
    assert crossmatch.crossmatch_catalogs(alerts, [read]).first()["catalog_payload"] == '{"ra":2.0,"dec":3.0,"ruwe":4.0,"other":5.0}'


def test_what_arrives_first_wins(spark):
    """By the stream's own time and offset, not by the time of the event."""
    body = lambda mjd: json.dumps({"diaObjectId": 1, "ra": 1.0, "decl": 2.0, "firstDiaSourceMjdTai": mjd})
    t = datetime.datetime(2024, 1, 1)
    frame = spark.createDataFrame([(body(60000.5), t, 8), (body(60002.5), t, 7)], "value string, timestamp timestamp, offset long")
    rows = normalize.normalize_lasair(brokers.read_lasair(frame)).withColumn("broker", F.lit("lasair"))
    none = spark.createDataFrame([], f"{ID} long")
    now = F.lit("2024-01-02").cast("timestamp")
    assert ingest.merge_alerts(none, rows, now, ["arrival", "broker", "event_time"], 2).first()["event_time"].day == 27


def test_small_batches_are_broadcast(spark):
    a, s = frames(spark, [(10, 0)], [(10, 0.0001)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [crossmatch.crossmatch(a, s, n_alerts=n)._jdf.queryExecution().executedPlan().toString() for n in (1, 2_000_000, None)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ["BroadcastHashJoin" in p for p in plans] == [True, False, False]


def test_healpix(spark):
    # known pixels: the centres of the twelve base pixels, and nesting of orders
    centres = [(45, 41.8), (135, 41.8), (225, 41.8), (315, 41.8), (0, 0), (90, 0), (180, 0), (270, 0), (45, -41.8), (135, -41.8), (225, -41.8), (315, -41.8)]
    df = spark.createDataFrame([(k, float(r), float(d)) for k, (r, d) in enumerate(centres)], "k int, ra double, dec double")
    assert all(r.k == r.p for r in df.select("k", healpix_nested(F.col("ra"), F.col("dec"), 0).alias("p")).collect())
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(0, 360, 300), rng.uniform(-90, 90, 300), strict=True)], "ra double, dec double")
    p = pts.select(healpix_nested(F.col("ra"), F.col("dec"), 9).alias("a"), healpix_nested(F.col("ra"), F.col("dec"), 4).alias("b"))
    assert p.where(coarsen(F.col("a"), 4, 9) != F.col("b")).count() == 0


def test_adaptive_tiles_hold_few(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(np.append(rng.uniform(0, 360, 300), rng.normal(80, 2, 500)), np.append(rng.uniform(-90, 90, 300), rng.normal(10, 2, 500)), strict=True)], "ra_deg double, dec_deg double")
    tiles = batches.adaptive_tiles(df, 50, highest=6)
    assert tiles.count() == 800
    assert tiles.groupBy("tile_order", "tile").count().where("count > 50 and tile_order < 6").count() == 0


def test_times_of_julian_dates_are_found_to_the_microsecond(spark):
    """Times around half a second, which would go to another second if they were a microsecond off."""
    micros = F.lit(1_704_067_200_499_998) + F.col("id") % 4 + F.col("id") * 7_000_000
    mjd = micros.cast("double") / F.lit(86400e6) + F.lit(40587.0)
    off = spark.range(100_000).select(micros.alias("at"), F.unix_micros(from_mjd(mjd)).alias("found")).where("at <> found")
    assert off.count() == 0
    known = spark.range(1).select(*(from_mjd(F.lit(x)).cast("string").alias(f"c{k}") for k, x in enumerate((40587.0, 60000.5, 40586.25)))).first()
    assert tuple(known) == ("1970-01-01 00:00:00", "2023-02-25 12:00:00", "1969-12-31 06:00:00")
