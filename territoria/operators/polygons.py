"""Point-in-polygon (G-10) and boundary status (C-03) without a geometry library.

Polygons arrive as vertex rows (key, ring, seq, lon, lat).  Edges are built
with `lead` over each ring.  Each edge is copied into the latitude bands of its
polygon that it spans, so a point meets only the edges that can cross its
horizontal ray (a few per band), not every edge of its city.  Parity of the
crossings (all rings together, so holes work) decides inside/outside; points on
the boundary count as outside, as `contains` does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import valid_coord
from ..functions.text import city_key

BANDS = 64


def polygon_edges(vertices: DataFrame, keys: list[str], ring: str | None = None) -> DataFrame:
    """Closed-ring edges (x1, y1, x2, y2) from ordered vertex rows."""
    part = keys + ([ring] if ring else [])
    w = Window.partitionBy(*part).orderBy("seq")
    first = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = vertices.select(*part, "seq", F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    return (v.withColumn("x2", F.coalesce(F.lead("x1").over(w), F.first("x1").over(first)))
            .withColumn("y2", F.coalesce(F.lead("y1").over(w), F.first("y1").over(first))))


def point_in_polygon(points: DataFrame, vertices: DataFrame, pid: str, keys: list[str],
                     lat: str = "lat", lon: str = "lon", ring: str | None = None) -> DataFrame:
    """Append `dentro` (true / false / null when the key has no polygon) to every point."""
    edges = polygon_edges(vertices, keys, ring)
    boxes = (edges.groupBy(*keys).agg(F.min(F.least("y1", "y2")).alias("_ymin"),
                                       F.max(F.greatest("y1", "y2")).alias("_ymax"),
                                       F.min(F.least("x1", "x2")).alias("_xmin"),
                                       F.max(F.greatest("x1", "x2")).alias("_xmax"))
             .withColumn("_h", F.greatest((F.col("_ymax") - F.col("_ymin")) / BANDS, F.lit(1e-12))))
    band = lambda y: F.least(F.floor((y - F.col("_ymin")) / F.col("_h")), F.lit(BANDS - 1)).cast("int")
    e = (edges.join(boxes, keys)
         .withColumn("_band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
         .select(*keys, "_band", "x1", "y1", "x2", "y2"))
    p = points.join(boxes, keys, "left")
    inbox = (F.col(lat) >= F.col("_ymin")) & (F.col(lat) <= F.col("_ymax")) \
        & (F.col(lon) >= F.col("_xmin")) & (F.col(lon) <= F.col("_xmax"))
    p = p.withColumn("_has", F.col("_ymin").isNotNull()).withColumn("_inbox", F.coalesce(inbox, F.lit(False)))
    cand = p.filter("_inbox").withColumn("_band", band(F.col(lat))).select(pid, *keys, "_band", lat, lon)
    x, y = F.col(lon), F.col(lat)
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & \
        (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = (cand.join(e, keys + ["_band"])
            .groupBy(pid).agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("_cross")))
    out = p.join(hits, pid, "left")
    dentro = (F.when(~F.col("_has"), F.lit(None).cast("boolean"))
              .when(~F.col("_inbox"), F.lit(False))
              .otherwise(F.coalesce(F.col("_cross"), F.lit(0)) % 2 == 1))
    return out.withColumn("dentro", dentro).drop("_ymin", "_ymax", "_xmin", "_xmax", "_h", "_has", "_inbox", "_cross")


def validate_geo(points: DataFrame, vertices: DataFrame, pid: str = "pdv_id", city: str = "cidade",
                 lat: str = "lat", lon: str = "lon") -> DataFrame:
    """C-03: coordenada_invalida / municipio_nao_encontrado / ok (0.0 km) / fora_cidade."""
    pts = points.withColumn("_ck", city_key(F.col(city)))
    verts = vertices.withColumn("_ck", city_key(F.col(city))).drop(city)
    good = pts.filter(valid_coord(F.col(lat), F.col(lon)))
    bad = pts.filter(~valid_coord(F.col(lat), F.col(lon)))
    tested = point_in_polygon(good, verts, pid, ["_ck"], lat, lon)
    status = (F.when(F.col("dentro").isNull(), F.lit("municipio_nao_encontrado"))
              .when(F.col("dentro"), F.lit("ok")).otherwise(F.lit("fora_cidade")))
    a = tested.select(*points.columns, status.alias("geo_validacao_status"),
                      F.when(F.col("dentro") == True, F.lit(0.0)).alias("geo_validacao_dist_km"))  # noqa: E712
    b = bad.select(*points.columns, F.lit("coordenada_invalida").alias("geo_validacao_status"),
                   F.lit(None).cast("double").alias("geo_validacao_dist_km"))
    return a.unionByName(b)
