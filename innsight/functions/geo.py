"""Geography as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight import config
from innsight.functions.frames import attach, scope


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = (F.pow(F.sin(half_lat), 2)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chord))
    return 2 * config.EARTH_RADIUS_KM * F.asin(F.sqrt(bounded))


def coarsen(locations: DataFrame, grid_km: float = config.PUBLIC_GRID_KM) -> DataFrame:
    """Snap positions to the centres of a grid, for publishing."""
    if not grid_km > 0:
        raise ValueError(f"grid_km must be positive, got {grid_km!r}")
    keys = scope(locations)
    centre = locations.groupBy(*keys).agg(F.avg("lat").alias("_lat0"))
    d_lat = F.lit(grid_km / config.KM_PER_DEGREE)
    d_lon = grid_km / (config.KM_PER_DEGREE
                       * F.greatest(F.cos(F.radians(F.col("_lat0"))), F.lit(1e-6)))
    return (
        attach(locations, centre, keys)
        .withColumn("lat", F.bround((F.floor(F.col("lat") / d_lat) + 0.5) * d_lat, 5))
        .withColumn("lon", F.bround((F.floor(F.col("lon") / d_lon) + 0.5) * d_lon, 5))
        .select(*locations.columns)
    )
