"""Prepared catalogs, coverage maps, dense cells and late payloads against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import crossmatch as cross
from skyweave.plans import tables as t
from skyweave.schema import CatalogSpec
from skyweave.streaming import jobs

ID = "lsst_diaobject_diaobjectid"
SOURCE = "catalog_name string, catalog_source_id string, source_ra_deg double, source_dec_deg double"
KEY = [ID, "catalog_source_id", "match_distance_arcsec"]


def pairs(df):
    return sorted(tuple(r) for r in df.select(*KEY).collect())


@pytest.fixture(scope="module")
def sky(spark):
    rng = random.Random(5)
    places = [(rng.uniform(0, 360), rng.uniform(-90, 90)) for _ in range(3000)]
    places += [(rng.gauss(120, 0.2) % 360, rng.gauss(-30, 0.2)) for _ in range(3000)]  # a dense field
    places += [(rng.uniform(0, 360), s * (90 - abs(rng.gauss(0, 0.05)))) for s in (1, -1) for _ in range(50)]
    places += [(rng.gauss(0, 0.001) % 360, rng.gauss(0, 0.001)) for _ in range(100)]
    sources = spark.createDataFrame([("c", str(k), ra, dec) for k, (ra, dec) in enumerate(places)], SOURCE)
    near = [(k, (ra + rng.gauss(0, 0.01)) % 360, max(-90.0, min(90.0, dec + rng.gauss(0, 0.01)))) for k, (ra, dec) in enumerate(rng.sample(places, 400))]
    alerts = spark.createDataFrame([*near, (9001, None, 1.0), (9002, float("nan"), 2.0)], f"{ID} long, ra_deg double, dec_deg double")
    return alerts, sources


@pytest.mark.parametrize("max_rows", [100, 1_000_000])
def test_pruning_loses_nothing(spark, sky, tmp_path, max_rows):
    alerts, sources = sky
    cross.prepare_catalog(sources, str(tmp_path / "c"), max_rows)
    prepared = spark.read.parquet(str(tmp_path / "c"))
    assert prepared.count() == sources.count() and cross.is_prepared(prepared)
    for radius in (1.0, 60.0, 7200.0, 20 * 3600.0):
        some = alerts.where(f"{ID} % 40 = 0 OR {ID} > 9000") if radius > 3600 else alerts
        near = cross.prune_catalog(prepared, some, radius)
        assert pairs(cross.cone_pairs(some, near, radius)) == pairs(cross.cone_pairs(some, sources, radius))


def test_files_read_shrink_with_the_batch(spark, sky, tmp_path):
    _, sources = sky
    cross.prepare_catalog(sources, str(tmp_path / "c"), 100)
    prepared = spark.read.parquet(str(tmp_path / "c"))

    def opened(*places):
        near = cross.prune_catalog(prepared, spark.createDataFrame([(k, *p) for k, p in enumerate(places)], f"{ID} long, ra_deg double, dec_deg double"), 1.0)
        plan = near._jdf.queryExecution().executedPlan()
        return len(near.select(F.input_file_name().alias("f")).distinct().collect()), plan.toString()

    everywhere = len(prepared.inputFiles())
    spot, plan = opened((120.0, -30.0))
    assert 1 <= spot <= 4 < everywhere / 10 and "PushedFilters: [" in plan and "_healpix_29" in plan.split("PushedFilters")[1]
    # a strip of one declination reads less than the sky, and a strip of one right ascension too
    same_dec = opened(*[(float(k), 0.0) for k in range(0, 360, 2)])[0]
    same_ra = opened(*[(120.0, float(k)) for k in range(-89, 90, 2)])[0]
    assert spot < same_dec < everywhere / 2 and spot < same_ra < everywhere / 2
    assert cross.prune_catalog(prepared, spark.createDataFrame([], f"{ID} long, ra_deg double, dec_deg double")).count() == 0


def test_ranges_are_merged_at_the_narrowest_gaps():
    ranges = [(0, 1), (2, 5), (10, 11), (100, 120), (1000, 1000)]
    assert cross.merged_ranges(ranges) == [(0, 5), (10, 11), (100, 120), (1000, 1000)]
    assert cross.merged_ranges(ranges, 2) == [(0, 120), (1000, 1000)]
    assert cross.merged_ranges(ranges, 1) == [(0, 1000)] and cross.merged_ranges([]) == []


def test_dense_fields_get_smaller_cells(spark, sky):
    alerts, sources = sky
    alerts = alerts.union(spark.createDataFrame([(10_000 + k, 120 + k / 3600, -30.0) for k in range(50)], alerts.schema)).union(alerts.limit(3))
    for radius, cell, most in ((1.0, 3600.0, 20), (60.0, 3600.0, 5), (20.0, 20.0, 1)):
        dense = cross.dense_cells(sources, most, radius, cell)
        assert pairs(cross.cone_pairs(alerts, sources, radius, cell, dense=dense)) == pairs(cross.cone_pairs(alerts, sources, radius, cell))
    dense = cross.dense_cells(sources, 20, 1.0, 3600.0)
    assert dense.count() > 0
    _, right = cross._refined(alerts, alerts, cross.zone_cell(sources, "source_ra_deg", "source_dec_deg", 1.0), dense, 1.0, 1.0)
    largest = lambda df, *cell: df.groupBy(*cell).count().agg(F.max("count")).first()[0]
    before = largest(cross.zone_cell(sources, "source_ra_deg", "source_dec_deg", 1.0), "zone_", "bin_")
    assert before > 100 and largest(right, "level_", "zone_", "bin_") < before / 4
    assert right.count() == sources.count()


def test_late_payloads(spark, tmp_path):
    spec = CatalogSpec("dense", "", "catalog_source_id", "source_ra_deg", "source_dec_deg", {"brightness": ("mag", "source_ra_deg"), "shape": ("mag", "gone")}, ("flag",))
    columns = t.catalog(spark, "/root/testdata/sf0.001", "dense").dropDuplicates(["catalog_source_id"])
    rows = columns.withColumn("mag", F.length("catalog_source_id")).withColumn("flag", F.lit(3)).withColumn("unused", F.lit("x"))
    cross.prepare_catalog(rows, str(tmp_path / "c"), 300)
    alerts = t.alerts(spark, "/root/testdata/sf0.001").where(f"{ID} % 50 = 0")
    tables, now = str(tmp_path / "tables"), F.lit("2024-01-01").cast("timestamp")
    catalog = cross.PayloadCatalog(spark.read.parquet(str(tmp_path / "c")), spec, quality_flags=True)
    assert jobs.match_batch(alerts, [catalog], tables, now) == {}
    got = {(r[ID], r.catalog_source_id): r.catalog_payload for r in spark.read.parquet(f"{tables}/catalog_matches").collect()}
    whole = cross.core_payload(rows, spec, quality_flags=True)
    want = {(r[ID], r.catalog_source_id): r.catalog_payload for r in cross.crossmatch_catalogs(alerts, [whole]).collect()}
    assert got == want and got and '"flag":3' in next(iter(got.values()))
    # positions are matched without payload columns, and these are read behind the cut to matched sources
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    first = plan(cross.crossmatch_catalogs(alerts, [catalog.positions]))
    assert "mag" not in first and "flag" not in first
    found = cross.crossmatch_catalogs(alerts, [catalog.positions])
    second = plan(cross.with_payloads(found, catalog, 10))
    assert "unused" not in second and "LeftSemi" in second and "PartitionFilters: [" in second


def test_folders_are_bounded(spark, sky, tmp_path, monkeypatch):
    """Tiles that are asked to be very small don't make a folder for nearly each source."""
    alerts, sources = sky
    monkeypatch.setattr(cross, "MOST_FOLDERS", 8)
    cross.prepare_catalog(sources, str(tmp_path / "c"), 2)
    prepared = spark.read.parquet(str(tmp_path / "c"))
    assert 8 <= prepared.select("tile_order", "tile").distinct().count() <= 4 * 8
    for radius in (1.0, 7200.0):
        assert pairs(cross.cone_pairs(alerts, cross.prune_catalog(prepared, alerts, radius), radius)) == pairs(cross.cone_pairs(alerts, sources, radius))


def test_rows_are_not_compared_with_ranges_that_leave_out_nothing(spark, sky, tmp_path):
    """A batch over the whole sky reads all folders, and no row's pixel is looked at; a spot's is."""
    _, sources = sky
    cross.prepare_catalog(sources, str(tmp_path / "c"), 100)
    prepared = spark.read.parquet(str(tmp_path / "c"))
    pushed = lambda alerts: "_healpix_29" in cross.prune_catalog(prepared, alerts)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    everywhere = spark.range(200_000).select(F.col("id").alias(ID), (F.col("id") * 137.508 % 360).alias("ra_deg"), F.degrees(F.asin(F.col("id") / 100_000 - 1)).alias("dec_deg"))
    assert not pushed(everywhere) and pushed(everywhere.limit(1))


@pytest.mark.parametrize("n", [1, 7, 100])
def test_ranges_by_halves(spark, n):
    ranges = [(10 * k, 10 * k + k % 7) for k in range(n)]
    got = {r[0] for r in spark.range(-5, 10 * n + 5).withColumnRenamed("id", "_healpix_29").where(cross._in_ranges(ranges)).collect()}
    assert got == {x for low, high in ranges for x in range(low, high + 1)}


def test_alerts_near_each_other_are_one_cap(spark, sky, tmp_path):
    """The join with the coverage map gets a row for each quarter of a degree, not for each alert."""
    _, sources = sky
    cross.prepare_catalog(sources, str(tmp_path / "c"), 100)
    cover = spark.read.parquet(str(tmp_path / "c" / "_coverage"))
    many = spark.range(5000).select(F.col("id").alias(ID), (120 + F.col("id") % 71 * 1e-4).alias("ra_deg"), (F.col("id") % 67 * 1e-4 - 30).alias("dec_deg"))
    got = {(r.tile_order, r.tile) for r in cross.covered(cover, many, 1.0).collect()}
    assert got and got < {(r.tile_order, r.tile) for r in cover.collect()}
    boxes = cross._boxes(many.withColumn("pixel", cross.healpix_nested(F.col("ra_deg"), F.col("dec_deg"), cross.ALERT_ORDER)), "ra_deg", "dec_deg").groupBy("pixel").agg(*cross._box())
    caps = cross._cap(boxes).select("pixel", "ra", "dec", "reach")
    assert caps.count() < 10
    out = many.withColumn("pixel", cross.healpix_nested(F.col("ra_deg"), F.col("dec_deg"), cross.ALERT_ORDER)).join(caps, "pixel")
    assert out.where(cross.separation_arcsec(F.col("ra_deg"), F.col("dec_deg"), F.col("ra"), F.col("dec")) > F.col("reach") * 3600).count() == 0


def test_matches_are_made_once_for_late_payloads(spark):
    from skyweave import job_queries

    rows = job_queries.join4_late_payloads(spark, "/root/testdata/sf0.001")
    assert "orders.parquet" not in rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
    assert all("orders.parquet" not in f for f in rows.inputFiles()) and rows.count() > 0
