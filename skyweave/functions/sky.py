"""Positions on the sky as column expressions: separations, zones and HEALPix pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to the half width of a search, in degrees, against rounding at cell edges.
SLACK = 1e-9


def separation_arcsec(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation of two positions in degrees, by haversines."""
    half_dec = F.sin(F.radians(dec2 - dec1) / 2)
    half_ra = F.sin(F.radians(ra2 - ra1) / 2)
    h = half_dec * half_dec + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * half_ra * half_ra
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))) * 3600


def bins_of_zone(zone: str, height: float) -> str:
    """SQL: how many right-ascension bins a zone of declination has; none is narrower than the zone's height."""
    edge = f"greatest(abs(({zone}) * {height}D - 90D), abs((({zone}) + 1) * {height}D - 90D))"
    return f"greatest(1L, bigint(floor(360D * cos(radians(least(90D, {edge}))) / {height}D)))"


def zone_cell(df: DataFrame, ra: str, dec: str, height: float) -> DataFrame:
    """df with zone_ and bin_: the one cell of a position."""
    df = df.withColumn("zone_", F.expr(f"bigint(floor(({dec} + 90D) / {height}D))"))
    return df.withColumn("bin_", F.expr(f"pmod(bigint(floor(pmod({ra}, 360D) / 360D * {bins_of_zone('zone_', height)})), {bins_of_zone('zone_', height)})"))


def search_cells(df: DataFrame, ra: str, dec: str, radius_arcsec: float | str, height: float) -> DataFrame:
    """df with a row for each cell (zone_, bin_) that a cone around its position touches; RA wrap and poles included. radius_arcsec: a number, or SQL where it differs by row."""
    r = f"(({radius_arcsec}) / 3600D)" if isinstance(radius_arcsec, str) else f"{radius_arcsec / 3600}D"
    rows = df.withColumn(
        "half_",
        F.expr(f"if(abs({dec}) + {r} >= 90D, 180D, degrees(asin(least(1D, sin(radians({r})) / cos(radians({dec}))))) + {SLACK}D)"),
    )
    top = int(180 / height) + 1
    zones = f"sequence(greatest(0L, bigint(floor(({dec} - ({r} + {SLACK}D) + 90D) / {height}D))), least({top}L, bigint(floor(({dec} + ({r} + {SLACK}D) + 90D) / {height}D))))"
    cells = f"""flatten(transform({zones}, z -> transform(
        if(half_ >= 180D, sequence(0L, {bins_of_zone('z', height)} - 1),
           sequence(bigint(floor((pmod({ra}, 360D) - half_) / 360D * {bins_of_zone('z', height)})), bigint(floor((pmod({ra}, 360D) + half_) / 360D * {bins_of_zone('z', height)})))),
        b -> named_struct('zone_', z, 'bin_', pmod(b, {bins_of_zone('z', height)})))))"""
    return rows.withColumn("cell_", F.explode(F.array_distinct(F.expr(cells)))).select("*", "cell_.zone_", "cell_.bin_").drop("half_", "cell_")


def spread_bits(v: Column) -> Column:
    """A number with its bits moved to the even places: its binary digits, read as digits of base 4. v is there once, so compiled code stays small."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def healpix_nested(ra: Column, dec: Column, order: int) -> Column:
    """Nested HEALPix pixel of a position in degrees (the published closed form), for orders up to 29."""
    nside = 1 << order
    z, t = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90
    up, down = nside * (0.5 + t) - nside * z * 0.75, nside * (0.5 + t) + nside * z * 0.75
    jp, jm = F.floor(up).cast("long"), F.floor(down).cast("long")
    ip, im = F.shiftright(jp, order), F.shiftright(jm, order)
    face = F.when(ip == im, ip.bitwiseOR(F.lit(4).cast("long"))).when(ip < im, ip).otherwise(im + 8)
    quarter = F.least(F.lit(3), F.floor(t)).cast("long")
    width = nside * F.sqrt(3 * (1 - F.abs(z)))
    kp = F.least(F.lit(nside - 1), F.floor((t - quarter) * width)).cast("long")
    km = F.least(F.lit(nside - 1), F.floor((1 - (t - quarter)) * width)).cast("long")
    belt, north = F.abs(z) <= 2 / 3, z >= 0
    mask = F.lit(nside - 1).cast("long")
    x = F.when(belt, jm.bitwiseAND(mask)).when(north, nside - km - 1).otherwise(kp)
    y = F.when(belt, nside - jp.bitwiseAND(mask) - 1).when(north, nside - kp - 1).otherwise(km)
    f = F.when(belt, face).when(north, quarter).otherwise(quarter + 8)

    return F.shiftleft(f.cast("long"), 2 * order) + spread_bits(x) + F.shiftleft(spread_bits(y), 1)


def coarsen(pixel: Column, order: int, from_order: int = 29) -> Column:
    """The pixel of a lower order that holds a nested pixel."""
    return F.shiftright(pixel, 2 * (from_order - order))
