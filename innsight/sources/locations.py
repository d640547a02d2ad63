"""Property positions: alias mapping and checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innsight import config
from innsight.functions.frames import CLUSTER
from innsight.sources.reviews import SchemaError, read_frame

LOCATION_COLUMNS = ["property_id", "lat", "lon", "zone"]


def map_locations(df: DataFrame) -> DataFrame:
    """Columns under their canonical names and types; the first matching alias wins."""
    by_name = {re.sub(r"[ -]", "_", c.strip().lower()): c for c in df.columns}
    source = {field: next((by_name[a] for a in aliases if a in by_name), None)
              for field, aliases in config.LOCATION_ALIASES.items()}
    missing = [f for f in ("property_id", "lat", "lon") if source[f] is None]
    if missing:
        raise SchemaError(f"Locations need columns {missing} (or an alias such as 'latitude').")
    zone = F.col(f"`{source['zone']}`") if source["zone"] else F.lit(None)
    cluster = [CLUSTER] if CLUSTER in df.columns else []
    return df.select(
        *cluster,
        F.trim(F.col(f"`{source['property_id']}`").cast("string")).alias("property_id"),
        F.col(f"`{source['lat']}`").try_cast("double").alias("lat"),
        F.col(f"`{source['lon']}`").try_cast("double").alias("lon"),
        zone.cast("string").alias("zone"))


def location_problems(mapped: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """(property_id, problem) rows: bad coordinates, repeats, unknown properties."""
    keys = [c for c in (CLUSTER, "property_id") if c in mapped.columns]
    bad = mapped.where(
        F.col("lat").isNull() | F.col("lon").isNull() | F.isnan("lat") | F.isnan("lon")
        | ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)
    ).select(*keys, F.lit("invalid coordinates").alias("problem"))
    repeats = mapped.groupBy(*keys).count().where("count > 1").select(
        *keys, F.lit("more than one position").alias("problem"))
    found = bad.unionByName(repeats)
    if properties is not None:
        known = properties.select(*keys[:-1], F.col("property_id").cast("string"))
        unknown = mapped.join(known, keys, "left_anti").select(
            *keys, F.lit("not in the reviews").alias("problem"))
        found = found.unionByName(unknown)
    return found


def validate_locations(df: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    mapped = map_locations(df)
    first = location_problems(mapped, properties).first()
    if first is not None:
        raise SchemaError(f"Position of {first['property_id']!r}: {first['problem']}.")
    return mapped


def load_locations(spark: SparkSession, path: str,
                   properties: DataFrame | None = None) -> DataFrame:
    return validate_locations(read_frame(spark, path), properties)
