"""Capacitated sweep (C-11) and per-group centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, polar_angle
from .windows import ranked

CENTROID_DIGITS = 9  # centroid rounded so the sweep order is reproducible across engines


def group_centroid(df: DataFrame, group: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.groupBy(*group).agg(F.round(F.avg(lat), CENTROID_DIGITS).alias("_lat_ref"),
                                  F.round(F.avg(lon), CENTROID_DIGITS).alias("_lon_ref"))


def capacitated_sweep(points: DataFrame, cap: int, group: list[str], pid: str = "pdv_id",
                      lat: str = "lat", lon: str = "lon", out: str = "setor") -> DataFrame:
    """Order points of each group by bearing, then distance, around the group centroid
    and cut every `cap` points into a new sector (0-based)."""
    c = group_centroid(points, group, lat, lon)
    p = points.join(c, group)
    p = (p.withColumn("_ang", polar_angle(F.col(lat), F.col(lon), F.col("_lat_ref"), F.col("_lon_ref")))
         .withColumn("_dist", haversine_km(F.col("_lat_ref"), F.col("_lon_ref"), F.col(lat), F.col(lon))))
    r = ranked(p, group, ["_ang", "_dist", pid], out="_rk")
    return (r.withColumn(out, F.floor((F.col("_rk") - 1) / F.lit(float(cap))).cast("int"))
            .drop("_rk", "_ang", "_dist", "_lat_ref", "_lon_ref"))
