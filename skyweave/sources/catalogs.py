"""Sky catalogs in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.payload import core_payload
from ..schema import CatalogSpec
from .files import listing


def _noted_default(spark: SparkSession, note: str) -> str | None:
    """The value of default_catalog in a file of name=value lines."""
    parts = F.split("value", "=", 2)
    found = spark.read.text(note).where(F.trim(parts[0]) == "default_catalog").select(F.trim(F.get(parts, F.lit(1))).alias("v")).where("v <> ''").first()
    return found["v"] if found else None


def resolve_catalog_root(spark: SparkSession, path: str) -> str:
    """Where a catalog is: the path itself, or of a collection (a folder with collection.properties) the member that it names, else its first member.

    A collection without members is an error.
    """
    root = path.rstrip("/")
    there = listing(spark, root)
    if "collection.properties" not in there:
        return path
    members = sorted(name for name, folder in there.items() if folder and name[0] not in "_.")
    chosen = _noted_default(spark, f"{root}/collection.properties") or next(iter(members), None)
    if chosen is None:
        raise FileNotFoundError(f"the collection {path} names no catalog and holds none")
    return f"{root}/{chosen}"


def _data(spark: SparkSession, spec: CatalogSpec) -> DataFrame:
    root = resolve_catalog_root(spark, spec.root).rstrip("/")
    return spark.read.parquet(f"{root}/dataset" if "dataset" in listing(spark, root) else root)


def read_catalog(spark: SparkSession, spec: CatalogSpec, columns: tuple[str, ...] = ()) -> DataFrame:
    """Id, position and the asked columns only; names are the same for all catalogs from here on."""
    rows = _data(spark, spec)
    return rows.select(F.lit(spec.name).alias("catalog_name"), F.col(spec.source_id_column).cast("string").alias("catalog_source_id"), F.col(spec.ra_column).cast("double").alias("source_ra_deg"), F.col(spec.dec_column).cast("double").alias("source_dec_deg"), *columns)


def read_with_payload(spark: SparkSession, spec: CatalogSpec, keep_nulls: bool = True, quality_flags: bool = False) -> DataFrame:
    """A catalog with catalog_payload: the core columns that it has, as JSON. No other column is read."""
    there = {c.lower() for c in _data(spark, spec).columns}
    wanted = [c for group in spec.payload_columns.values() for c in group] + list(spec.flag_columns if quality_flags else ())
    extra = tuple(c for c in dict.fromkeys(wanted) if c.lower() in there)
    rows = read_catalog(spark, spec, extra)
    return core_payload(rows, spec, keep_nulls, quality_flags).select("catalog_name", "catalog_source_id", "source_ra_deg", "source_dec_deg", "catalog_payload")


def catalog_columns(spark: SparkSession, specs: list[CatalogSpec]) -> DataFrame:
    """(catalog, position, column, dtype, n_columns, error) of each catalog; one that can't be read gives a row with its error."""
    rows = []
    for spec in specs:
        try:
            fields = _data(spark, spec).schema.fields
            rows += [(spec.name, k, f.name, f.dataType.simpleString(), len(fields), None) for k, f in enumerate(fields)]
        except Exception as error:  # noqa: BLE001  the others go on
            rows.append((spec.name, None, None, None, None, str(error)[:500]))
    return spark.createDataFrame(rows, "catalog string, position int, column string, dtype string, n_columns int, error string")
