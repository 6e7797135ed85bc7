"""Catalog columns that travel with a match, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CatalogSpec


def core_payload(rows: DataFrame, spec: CatalogSpec, keep_nulls: bool = True, quality_flags: bool = False) -> DataFrame:
    """rows with catalog_payload. A column of two keywords is written once; columns that the catalog lacks are left out."""
    wanted = [c for columns in spec.payload_columns.values() for c in columns] + list(spec.flag_columns if quality_flags else ())
    there = {c.lower(): c for c in rows.columns}
    columns = [there[c.lower()] for c in dict.fromkeys(wanted) if c.lower() in there]
    value = F.to_json(F.struct(*columns), {"ignoreNullFields": str(not keep_nulls).lower()}) if columns else F.lit("{}")
    return rows.withColumn("catalog_payload", value)
