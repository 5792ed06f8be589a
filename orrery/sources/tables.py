"""Readers of the project's tables: one place for paths, rows in force and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MERCATOR_RADIUS = 6378137.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_number(c: Column) -> Column:
    """The number that a text spells (blanks, leading zeros, a point with zeros allowed), else null."""
    return F.trim(c.cast("string")).try_cast("decimal(38,6)").try_cast("bigint")


def in_force(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """One row of each key: the one with the latest `order` (null counts as earliest). Rows without a key go.

    Aggregates with a partial step on the map side, so a key with very many rows costs no more than any other.
    """
    rest = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*rest), F.coalesce(F.col(order).cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def place_columns(lon: Column, lat: Column, x: Column, y: Column, srid: Column) -> Column:
    """struct(lon, lat) in degrees of a point record, or null where it has no place.

    lon/lat count when both are finite, within +-180/+-90 and not both 0; else the geometry by its srid (4326 degrees,
    3857 spherical mercator metres). A geometry with x = y = 0, not finite, outside the world or of another srid is no place.
    """
    def usable(a: Column, b: Column) -> Column:
        return (F.abs(a) <= 180) & (F.abs(b) <= 90) & ~F.isnan(a) & ~F.isnan(b) & ~((a == 0) & (b == 0))

    deg = F.degrees
    mx, my = deg(x / MERCATOR_RADIUS), deg(2 * F.atan(F.exp(y / MERCATOR_RADIUS)) - F.lit(3.141592653589793 / 2))
    gx = F.when(srid == 3857, mx).when(srid == 4326, x)
    gy = F.when(srid == 3857, my).when(srid == 4326, y)
    some = ~((x == 0) & (y == 0))
    return F.when(usable(lon, lat), F.struct(lon.alias("lon"), lat.alias("lat"))).when(some & usable(gx, gy), F.struct(gx.alias("lon"), gy.alias("lat")))


def places(x_shp: DataFrame) -> DataFrame:
    """(id BIGINT, lon DOUBLE, lat DOUBLE) of the point records in force that have a place."""
    d = x_shp.select(whole_number(F.col("id")).alias("id"), "lon", "lat", "geometry", "srid", "loaded_at")
    d = in_force(d, "id")
    p = place_columns(F.col("lon"), F.col("lat"), F.col("geometry.x"), F.col("geometry.y"), F.col("srid"))
    return d.select("id", p.alias("p")).where(F.col("p").isNotNull()).select("id", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
