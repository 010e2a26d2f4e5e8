"""Vendor assignment (R-09..R-11): sweep routes into vendors, link points, vendor bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import squared_degree_distance
from .windows import ranked


def routes_per_vendor(dias: int, freq: float) -> int:
    """max(1, round(dias / freq)) with Python's half-even rounding."""
    return max(1, round(dias / freq))


def assign_vendors(routes: DataFrame, route_key: list[str], dias: int, freq: float,
                   group: list[str] | None = None) -> DataFrame:
    """R-09: order routes west->east then south->north by centre and give each
    vendor the next `round(dias/freq)` routes (W-06 with a distributed rank)."""
    cap = routes_per_vendor(dias, freq)
    r = ranked(routes, group or [], ["centro_lon", "centro_lat", *route_key], out="_rk")
    return r.withColumn("vendedor_id", (F.floor((F.col("_rk") - 1) / F.lit(float(cap))) + 1).cast("int")).drop("_rk")


def vendor_points(assigned_routes: DataFrame, stops: DataFrame, route_key: list[str]) -> DataFrame:
    """R-10: point -> vendor through route membership (joined on the full route key, Q15)."""
    return stops.join(assigned_routes.select(*route_key, "vendedor_id"), route_key)


def vendor_base(assigned_routes: DataFrame, points_with_vendor: DataFrame,
                place_cols: tuple[str, ...] = ("cidade",)) -> DataFrame:
    """R-11: point-weighted centroid of the vendor's route centres (plain mean if no
    points) and the place of the vendor's own point nearest to it (J-12 as one
    grouped `min_by`, not one query per vendor)."""
    b = (assigned_routes.groupBy("vendedor_id")
         .agg(F.sum("n_pdvs").alias("_n"), F.sum(F.col("centro_lat") * F.col("n_pdvs")).alias("_sl"),
              F.sum(F.col("centro_lon") * F.col("n_pdvs")).alias("_so"),
              F.avg("centro_lat").alias("_al"), F.avg("centro_lon").alias("_ao"),
              F.count(F.lit(1)).alias("total_rotas")))
    b = b.select("vendedor_id", "total_rotas", F.col("_n").cast("long").alias("total_pdvs"),
                 F.round(F.when(F.col("_n") > 0, F.col("_sl") / F.col("_n")).otherwise(F.col("_al")), 6).alias("base_lat"),
                 F.round(F.when(F.col("_n") > 0, F.col("_so") / F.col("_n")).otherwise(F.col("_ao")), 6).alias("base_lon"))
    p = points_with_vendor.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(
        b.select("vendedor_id", "base_lat", "base_lon"), "vendedor_id")
    near = p.groupBy("vendedor_id").agg(F.min_by(
        F.struct(*place_cols), F.struct(squared_degree_distance("lat", "lon", "base_lat", "base_lon"), F.col("pdv_id"))
    ).alias("_pl"))
    return b.join(near, "vendedor_id", "left").select(
        "vendedor_id", "total_rotas", "total_pdvs", "base_lat", "base_lon",
        *[F.col("_pl." + c).alias("base_" + c) for c in place_cols])
