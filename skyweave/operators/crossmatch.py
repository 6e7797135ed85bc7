"""Cone joins of alerts with sky catalogs by zones: exact, keyed by equality, no cross join.

A source has one cell (a declination zone and a right-ascension bin). An alert
is repeated for each cell that its cone touches, one or two as a rule. The join
is on the cell, so Spark may shuffle or broadcast either side and splits dense
cells by itself. Where a field is so dense that one cell would be too much, its
cells are halved in height and width until they hold few sources (dense_cells).

A prepared catalog lies in folders by HEALPix tiles that hold about as many
rows each, sorted by pixel, with a coverage map beside it: for parts of tiles
their range of pixels and a cap around their sources. Alerts near each other
are put together in caps too. A batch reads the tiles and ranges whose caps come
within the radius of those of alerts; a source within reach of an alert is in one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sky import coarsen, healpix_nested, search_cells, separation_arcsec, zone_cell
from ..schema import CatalogSpec
from .batches import adaptive_tiles
from .filters import valid_coordinates
from .payload import core_payload

ALERT = "lsst_diaobject_diaobjectid"
MATCH_KEY = [ALERT, "catalog_name", "catalog_source_id", "match_version"]


#: A batch of alerts up to so many rows (four numbers each) is broadcast, so a catalog never moves.
BROADCAST_ALERTS = 1_000_000


def _height(radius_arcsec: float, cell_arcsec: float | None) -> float:
    return max(cell_arcsec or 10.0, radius_arcsec) / 3600


def _placed(sources: DataFrame) -> DataFrame:
    return sources.na.drop(subset=["source_ra_deg", "source_dec_deg"])


def dense_cells(sources: DataFrame, max_rows: int, radius_arcsec: float = 1.0, cell_arcsec: float | None = None) -> DataFrame:
    """(zone_, bin_, level_) of cells with more than max_rows sources, at most one for each max_rows rows: how often to halve them, for cone_pairs. They get no smaller than the radius."""
    height = _height(radius_arcsec, cell_arcsec)
    most = int(math.log2(height * 3600 / radius_arcsec))
    counts = zone_cell(_placed(sources), "source_ra_deg", "source_dec_deg", height).groupBy("zone_", "bin_").agg(F.count("*").alias("n_"))
    level = F.least(F.lit(most), F.ceil(F.log(4.0, F.col("n_") / max_rows))).cast("int")
    return counts.where(F.col("n_") > max_rows).select("zone_", "bin_", level.alias("level_")).where("level_ > 0")


def cone_pairs(alerts: DataFrame, sources: DataFrame, radius_arcsec: float = 1.0, cell_arcsec: float | None = None, n_alerts: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """All (alert, source) pairs within the radius, with match_distance_arcsec (6 decimals); columns of both sides.

    n_alerts: how many alerts there are, where the caller knows: up to
    BROADCAST_ALERTS they are broadcast. Else Spark joins as it sees fit.
    dense: of dense_cells, for the same radius and cell: a source there lies in
    a smaller cell, and alerts whose cones touch it look in the smaller cells too.
    """
    height = _height(radius_arcsec, cell_arcsec)
    left = search_cells(valid_coordinates(alerts), "ra_deg", "dec_deg", radius_arcsec, height)
    right = zone_cell(_placed(sources), "source_ra_deg", "source_dec_deg", height)
    cell = ["zone_", "bin_"]
    if dense is not None:
        left, right = _refined(alerts, left, right, dense, radius_arcsec, height)
        cell.append("level_")
    if n_alerts is not None and n_alerts <= BROADCAST_ALERTS:
        left = F.broadcast(left)
    pairs = left.join(right, cell).drop(*cell)
    distance = separation_arcsec(F.col("ra_deg"), F.col("dec_deg"), F.col("source_ra_deg"), F.col("source_dec_deg"))
    return pairs.withColumn("distance_", distance).where(F.col("distance_") <= radius_arcsec).withColumn("match_distance_arcsec", F.round("distance_", 6)).drop("distance_")


def _refined(alerts: DataFrame, left: DataFrame, right: DataFrame, dense: DataFrame, radius_arcsec: float, height: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join with level_, and smaller cells where cells are dense. A source still has one cell, so no pair comes twice."""
    levels = range(1, int(math.log2(height * 3600 / radius_arcsec)) + 1)
    right = right.join(dense, ["zone_", "bin_"], "left").withColumn("level_", F.coalesce("level_", F.lit(0)))
    by_level: dict[str, Column] = {c: F.col(c) for c in ("zone_", "bin_")}
    for k in levels:
        right = right.withColumnsRenamed({"zone_": "zone0_", "bin_": "bin0_"})
        right = zone_cell(right, "source_ra_deg", "source_dec_deg", height / 2**k).withColumnsRenamed({"zone_": f"zone{k}_", "bin_": f"bin{k}_", "zone0_": "zone_", "bin0_": "bin_"})
        by_level = {c: F.when(F.col("level_") == k, F.col(f"{c[:-1]}{k}_")).otherwise(old) for c, old in by_level.items()}
    right = right.withColumns(by_level).drop(*(f"{c}{k}_" for k in levels for c in ("zone", "bin")))
    numbered = valid_coordinates(alerts).withColumn("row_", F.monotonically_increasing_id())
    found = search_cells(numbered, "ra_deg", "dec_deg", radius_arcsec, height).join(dense, ["zone_", "bin_"], "left").withColumn("level_", F.coalesce("level_", F.lit(0)))
    parts = [found.where("level_ = 0")]
    for k in levels:
        near = found.where(F.col("level_") == k).drop("zone_", "bin_").dropDuplicates(["row_"])
        parts.append(search_cells(near, "ra_deg", "dec_deg", radius_arcsec, height / 2**k))
    return reduce(DataFrame.unionByName, parts).drop("row_"), right


def _rank() -> list[Column]:
    """Nearest first; equal separations by source id, shorter ids first so that numbers sort as numbers."""
    return [F.col("match_distance_arcsec"), F.length("catalog_source_id"), F.col("catalog_source_id")]


def nearest(pairs: DataFrame, *key: str) -> DataFrame:
    """The best pair of each alert (and catalog, if that is in the key) as an aggregate: minima are taken before the shuffle."""
    first = F.min(F.struct(*(c.alias(f"r{k}") for k, c in enumerate(_rank())), F.struct("*").alias("row")))
    return pairs.groupBy(*(F.col(c).alias(f"key{k}_") for k, c in enumerate(key or (ALERT,)))).agg(first.alias("best")).select("best.row.*")


def crossmatch(alerts: DataFrame, sources: DataFrame, radius_arcsec: float = 1.0, n_neighbors: int = 1, alert_id: str = ALERT, cell_arcsec: float | None = None, n_alerts: int | None = None, dense: DataFrame | None = None) -> DataFrame:
    """The n nearest sources of each alert within the radius; no overlap gives no rows."""
    pairs = cone_pairs(alerts, sources, radius_arcsec, cell_arcsec, n_alerts, dense)
    if n_neighbors == 1:
        return nearest(pairs, alert_id)
    rank = F.row_number().over(Window.partitionBy(alert_id).orderBy(*_rank()))
    return pairs.withColumn("rank_", rank).where(F.col("rank_") <= n_neighbors).drop("rank_")


def match_rows(result: DataFrame, match_version: int = 1) -> DataFrame:
    """Crossmatch result to the shape of stored matches; the catalog's payload goes along where it has one."""
    payload = F.col("catalog_payload") if "catalog_payload" in result.columns else F.lit(None)
    return result.select(ALERT, "catalog_name", F.col("catalog_source_id").cast("string").alias("catalog_source_id"), "match_distance_arcsec", F.lit(None).cast("double").alias("match_score"), "source_ra_deg", "source_dec_deg", payload.cast("string").alias("catalog_payload"), F.lit(match_version).alias("match_version"))


def crossmatch_catalogs(alerts: DataFrame, catalogs: list[DataFrame], radius_arcsec: float = 1.0, match_version: int = 1, n_alerts: int | None = None) -> DataFrame:
    """Every catalog (with its catalog_name), one tall table of matches. Catalogs of equal columns are read side by side and joined at once: the alerts' cells are made once."""
    narrow = alerts.select(ALERT, "ra_deg", "dec_deg")
    whole = [c if "catalog_payload" in c.columns else c.withColumn("catalog_payload", F.lit(None).cast("string")) for c in catalogs]
    sources = reduce(DataFrame.unionByName, (c.select("catalog_name", "catalog_source_id", "source_ra_deg", "source_dec_deg", "catalog_payload") for c in whole))
    pairs = cone_pairs(narrow, sources, radius_arcsec, None, n_alerts)
    return match_rows(nearest(pairs, ALERT, "catalog_name"), match_version)


def unmatched(alerts: DataFrame, matches: DataFrame) -> DataFrame:
    return alerts.join(matches.select(ALERT), ALERT, "left_anti")


def matched(alerts: DataFrame, matches: DataFrame) -> DataFrame:
    return alerts.join(matches.select(ALERT), ALERT, "left_semi")


def annotated_alerts(alerts: DataFrame, matches: DataFrame) -> DataFrame:
    """Each alert with its matches of all catalogs; alerts without one stay."""
    return alerts.join(matches, ALERT, "left")


def link_matches(notifications: DataFrame, matches: DataFrame) -> DataFrame:
    """The match behind each notification, by its natural key."""
    return notifications.join(matches, MATCH_KEY, "left")


# -- payloads ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class PayloadCatalog:
    """A catalog (with the columns of read_catalog and its payload columns) whose payloads are fetched for matches alone."""

    rows: DataFrame
    spec: CatalogSpec
    quality_flags: bool = False

    @property
    def positions(self) -> DataFrame:
        kept = [c for c in ("tile_order", "tile", "_healpix_29") if c in self.rows.columns]
        return self.rows.select("catalog_name", "catalog_source_id", "source_ra_deg", "source_dec_deg", *kept)


def with_payloads(matches: DataFrame, catalog: PayloadCatalog, n_matches: int | None = None) -> DataFrame:
    """Matches of the catalog with its payload, as the second phase of a match: of a prepared catalog only tiles and pixel ranges around matched sources are read, and only matched sources are made into JSON.

    n_matches: how many matches there are, where the caller knows; up to
    BROADCAST_ALERTS their source ids are broadcast.
    """
    found = matches.select("catalog_source_id", "source_ra_deg", "source_dec_deg")
    rows = catalog.rows
    if is_prepared(rows):
        at = found.select(F.col("source_ra_deg").alias("ra_deg"), F.col("source_dec_deg").alias("dec_deg"))
        rows = prune_catalog(rows, at, 0.001)
    ids = found.select("catalog_source_id").distinct()
    if n_matches is not None and n_matches <= BROADCAST_ALERTS:
        ids = F.broadcast(ids)
    rows = core_payload(rows.join(ids, "catalog_source_id", "left_semi"), catalog.spec, quality_flags=catalog.quality_flags)
    rows = rows.groupBy("catalog_source_id").agg(F.min("catalog_payload").alias("catalog_payload"))  # an id that a catalog repeats has one
    return matches.drop("catalog_payload").join(rows, "catalog_source_id", "left").select(*matches.columns)


# -- layout and coverage ------------------------------------------------------------------------------

#: The finest tiles, and how many orders the parts of a tile in a coverage map are finer than it.
TILE_ORDER, FINER = 7, 3
#: Ranges of pixels that are pushed to the scan at most; nearer ones become one.
MAX_RANGES = 100
#: Alerts in one HEALPix pixel of this order (a quarter of a degree), or of that of a tile's parts where these are larger, are one cap.
ALERT_ORDER = 8
#: Folders of a prepared catalog are not many more than four times this, however small they are asked to be: each is a file to write, list and open.
MOST_FOLDERS = 512


def prepare_catalog(catalog: DataFrame, path: str, max_rows: int = 1_000_000) -> None:
    """A copy of a catalog in folders by tile, each with about max_rows rows at the most (or a MOST_FOLDERS-th of all), sorted by pixel; its coverage map lies in _coverage. Sources without a position go."""
    spark = catalog.sparkSession
    with _compiled(spark):
        rows = _placed(catalog)
        if "_healpix_29" not in rows.columns:
            rows = rows.withColumn("_healpix_29", healpix_nested(F.col("source_ra_deg"), F.col("source_dec_deg"), 29))
        tiled = adaptive_tiles(rows, max_rows, highest=TILE_ORDER, pixel=coarsen(F.col("_healpix_29"), TILE_ORDER), most_tiles=MOST_FOLDERS)
        order = ["tile_order", "tile", "_healpix_29"]
        tiled.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("tile_order", "tile").parquet(path)
        coverage(spark.read.schema(tiled.schema).parquet(path)).write.parquet(f"{path}/_coverage")


@contextmanager
def _compiled(spark: SparkSession) -> Iterator[None]:
    """Meanwhile stages whose code would be one method that the JVM doesn't compile (8000 bytes) run as several: pixels of derived positions make such."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def coverage(prepared: DataFrame) -> DataFrame:
    """(tile_order, tile, low, high, ra, dec, reach): for parts of tiles their range of pixels and a cap that holds their sources, reach in degrees."""
    part = F.expr(f"shiftright(_healpix_29, 2 * greatest(0, {29 - FINER} - tile_order))")
    kept = [F.min("_healpix_29").alias("low"), F.max("_healpix_29").alias("high")]
    boxed = _boxes(prepared, "source_ra_deg", "source_dec_deg").groupBy("tile_order", "tile", part.alias("part")).agg(*kept, *_box())
    return _cap(boxed).select("tile_order", "tile", "low", "high", "ra", "dec", "reach")


_AXES = ("x", "y", "z")


def _box() -> list[Column]:
    """The box around boxes."""
    return [f(f"{f.__name__}_{c}").alias(f"{f.__name__}_{c}") for c in _AXES for f in (F.min, F.max)]


def _boxes(rows: DataFrame, ra: str, dec: str) -> DataFrame:
    """rows with the box of their unit vector, to be put together by _box."""
    at = {"x": F.cos(F.radians(dec)) * F.cos(F.radians(ra)), "y": F.cos(F.radians(dec)) * F.sin(F.radians(ra)), "z": F.sin(F.radians(dec))}
    return rows.withColumns(at).withColumns({f"{end}_{c}": F.col(c) for c in _AXES for end in ("min", "max")}).drop(*_AXES)


def _cap(boxed: DataFrame) -> DataFrame:
    """boxed with ra, dec and reach (degrees) of a cap that holds what is in the box."""
    # the middle of a box around the unit vectors, moved to the sphere; no vector is further than half the box's diagonal and that move
    middle = boxed.withColumns({c: (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in _AXES})
    length = F.sqrt(sum(F.col(c) * F.col(c) for c in _AXES))
    diagonal = F.sqrt(sum((F.col(f"max_{c}") - F.col(f"min_{c}")) * (F.col(f"max_{c}") - F.col(f"min_{c}")) for c in _AXES))
    chord = diagonal / 2 + F.abs(1 - length)
    reach = F.when((chord >= 2) | (length < 1e-6), 180.0).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / 2))) + 1e-7)
    ra = F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0))
    return middle.withColumns({"ra": ra, "dec": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / length)))), "reach": reach})


def is_prepared(catalog: DataFrame) -> bool:
    return {"tile_order", "tile", "_healpix_29"} <= set(catalog.columns)


def covered(cover: DataFrame, alerts: DataFrame, radius_arcsec: float) -> DataFrame:
    """(tile_order, tile, low, high): tiles with a part that a cone around an alert may reach, and the pixels of these parts."""
    widest = {r["tile_order"]: r["reach"] for r in cover.groupBy("tile_order").agg(F.max("reach").alias("reach")).collect()}  # a row for each order
    if not widest:
        return cover.select("tile_order", "tile", "low", "high")
    places = valid_coordinates(alerts).select("ra_deg", "dec_deg")
    pixel = healpix_nested(F.col("ra_deg"), F.col("dec_deg"), ALERT_ORDER)
    boxed = _boxes(places.withColumn("pixel", pixel), "ra_deg", "dec_deg").groupBy("pixel").agg(*_box())  # at most a row for each pixel
    found = []
    for order, reach in sorted(widest.items()):
        coarse = min(ALERT_ORDER, order + FINER)
        near_each_other = _cap(boxed.groupBy(coarsen(F.col("pixel"), coarse, ALERT_ORDER)).agg(*_box())).select("ra", "dec", F.col("reach").alias("own"))
        wide = radius_arcsec + reach * 3600
        height = min(wide / 3600 + 60 / 2**coarse, 30.0)
        centres = zone_cell(cover.where(F.col("tile_order") == order), "ra", "dec", height)
        cones = search_cells(near_each_other, "ra", "dec", f"least({180 * 3600.0}D, {wide}D + own * 3600D)", height).alias("a")
        near = separation_arcsec(F.col("a.ra"), F.col("a.dec"), F.col("c.ra"), F.col("c.dec")) <= radius_arcsec + (F.col("reach") + F.col("a.own")) * 3600
        same = (F.col("a.zone_") == F.col("c.zone_")) & (F.col("a.bin_") == F.col("c.bin_"))
        found.append(centres.alias("c").join(cones, same & near, "left_semi"))
    return reduce(DataFrame.unionByName, found).groupBy("tile_order", "tile").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def merged_ranges(ranges: list[tuple[int, int]], most: int = MAX_RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that cover the given ones: the widest gaps stay."""
    joined: list[list[int]] = []
    for low, high in sorted(ranges):
        if joined and low <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], high)
        else:
            joined.append([low, high])
    gaps = sorted((b[0] - a[1] for a, b in zip(joined, joined[1:], strict=False)), reverse=True)
    least = gaps[most - 1] if len(gaps) >= most else 0
    out: list[tuple[int, int]] = []
    for low, high in joined:
        if out and low - out[-1][1] <= least:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def prune_catalog(catalog: DataFrame, alerts: DataFrame, radius_arcsec: float = 1.0) -> DataFrame:
    """A prepared catalog cut to the folders and pixel ranges that its coverage map shows near an alert; nothing within the radius is lost.

    The driver gets a row for each folder that is read, as it does when it lists them.
    """
    spark = catalog.sparkSession
    names = catalog.inputFiles()
    if not names:
        return catalog
    root = names[0].split("/tile_order=")[0]
    needed = covered(spark.read.parquet(f"{root}/_coverage"), alerts, radius_arcsec).collect()
    if not needed:
        return catalog.where(F.lit(False))
    tiles: dict[int, list[int]] = {}
    for r in needed:
        tiles.setdefault(r["tile_order"], []).append(r["tile"])
    folders = reduce(Column.__or__, ((F.col("tile_order") == order) & F.expr(f"tile IN ({', '.join(map(str, own))})") for order, own in tiles.items()))
    ranges = merged_ranges([(r["low"], r["high"]) for r in needed])
    # where the ranges leave out little of these folders, looking at each row's pixel costs more than it saves
    if 10 * sum(high - low + 1 for low, high in ranges) >= 9 * sum(len(own) << 2 * (29 - order) for order, own in tiles.items()):
        return catalog.where(folders)
    return catalog.where(folders & _in_ranges(ranges))


def _in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Whether a pixel is in one of some ranges, in order: by halves, so that a row is compared with few of them."""
    whole = F.col("_healpix_29").between(ranges[0][0], ranges[-1][1])
    if len(ranges) == 1:
        return whole
    half = len(ranges) // 2
    return whole & (_in_ranges(ranges[:half]) | _in_ranges(ranges[half:]))
