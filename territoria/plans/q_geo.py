"""Registered geography queries: boundary status, state boxes, CEP ranges, coordinate checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators.polygons import validate_geo
from ..operators.quality import cep_to_state, state_bbox_status
from ..sources import dims
from ..sources import fixtures as fx
from .registry import register

EDGES_SQL = """
edges as (
  select cidade, lon as x1, lat as y1,
         coalesce(lead(lon) over (partition by cidade order by seq), first_value(lon) over (partition by cidade order by seq)) as x2,
         coalesce(lead(lat) over (partition by cidade order by seq), first_value(lat) over (partition by cidade order by seq)) as y2
  from polygon_vertices),
cross_n as (
  select p.pdv_id,
         sum(case when ((e.y1 > p.lat) <> (e.y2 > p.lat))
                   and p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 then 1 else 0 end) as n
  from points p join edges e on e.cidade = p.cidade
  group by p.pdv_id),
has_poly as (select distinct cidade from polygon_vertices),
status as (
  select p.pdv_id, p.cidade,
         case when h.cidade is null then 'municipio_nao_encontrado'
              when c.n % 2 = 1 then 'ok' else 'fora_cidade' end as geo_validacao_status,
         case when h.cidade is not null and c.n % 2 = 1 then cast(0.0 as double) end as geo_validacao_dist_km
  from points p left join has_poly h on h.cidade = p.cidade left join cross_n c on c.pdv_id = p.pdv_id)
"""


@register("geo_validate", sql=fx.with_fixtures("points", "polygon_vertices").rstrip() + "," + EDGES_SQL
          + "select pdv_id, cidade, geo_validacao_status, geo_validacao_dist_km from status")
def q_geo_validate(spark, sf_dir):
    """C-03 / G-10: each point against its city's polygon (edge crossings, banded)."""
    pts = fx.points(spark, sf_dir)
    res = validate_geo(pts, fx.polygon_vertices(spark, sf_dir))
    return res.select("pdv_id", "cidade", "geo_validacao_status", "geo_validacao_dist_km")


@register("geo_status_counts", sql=fx.with_fixtures("points", "polygon_vertices").rstrip() + "," + EDGES_SQL
          + "select geo_validacao_status, cast(count(*) as bigint) as n from status group by geo_validacao_status")
def q_geo_status_counts(spark, sf_dir):
    """A-07: count of points per boundary status."""
    res = validate_geo(fx.points(spark, sf_dir), fx.polygon_vertices(spark, sf_dir))
    return res.groupBy("geo_validacao_status").agg(F.count(F.lit(1)).alias("n"))


@register("state_bbox_check", sql=fx.with_fixtures("points") + f"""
select p.pdv_id, p.uf,
       case when p.lat is null or p.lon is null or isnan(p.lat) or isnan(p.lon) then 'falha_geolocalizacao'
            when b.uf is null then 'uf_invalida'
            when not (p.lat between b.lat_min and b.lat_max and p.lon between b.lon_min and b.lon_max)
              then 'coordenadas_fora_limites'
            else 'ok' end as motivo_geo
from points p left join {dims.STATE_BOUNDS_SQL} b on b.uf = p.uf
""")
def q_state_bbox_check(spark, sf_dir):
    """G-09: point against its state's bounding box (27-row broadcast dimension)."""
    pts = fx.points(spark, sf_dir).select("pdv_id", "uf", F.col("lat").alias("pdv_lat"), F.col("lon").alias("pdv_lon"))
    return state_bbox_status(pts, dims.state_bounds(spark)).select("pdv_id", "uf", "motivo_geo")


@register("cep_state_range", sql=fx.with_fixtures("marketplace_cep") + f"""
select m.cep, m.zona,
       (select r.uf from {dims.CEP_RANGES_SQL} r where m.cep between r.lo and r.hi
        order by cast(r.hi as bigint) - cast(r.lo as bigint), r.uf limit 1) as uf_cep
from marketplace_cep m
""")
def q_cep_state_range(spark, sf_dir):
    """J-06: CEP -> state by range, narrowest range first."""
    m = fx.marketplace_cep(spark, sf_dir).select("cep", "zona")
    return cep_to_state(m, dims.cep_ranges(spark)).select("cep", "zona", "uf_cep")


def _coord_sql() -> str:
    h1 = geo.haversine_sql("lat", "lon", "cast(-22.563 as double)", "cast(-47.401 as double)")
    h2 = geo.haversine_sql("lat", "lon", "cast(-14.235004 as double)", "cast(-51.92528 as double)")
    caps = " or ".join(f"(abs(lat - ({a})) < 0.0005 and abs(lon - ({b})) < 0.0005)"
                       for a, b in geo.CAPITAL_DEFAULT_POINTS)
    return fx.with_fixtures("points") + f"""
select pdv_id,
       (lat is not null and lon is not null and not isnan(lat) and not isnan(lon)
        and lat between -90.0 and 90.0 and lon between -180.0 and 180.0) as coord_ok,
       coalesce(lat is null or lon is null or (abs(lat) < 0.0001 and abs(lon) < 0.0001)
                or not (lat between -90.0 and 90.0 and lon between -180.0 and 180.0)
                or {h1} < 5.0 or {h2} < 10.0, true) as coord_generica,
       ({caps}) as ponto_padrao_capital,
       case when abs(lat) > abs(lon) then lon else lat end as lat_fix,
       round(power(lat - (-15.0), 2) + power(lon - (-50.0), 2), 6) as dist2_graus,
       round(case when abs(lat * 1000000.0) > 90 then lat * 1000000.0 / 1e6 else lat * 1000000.0 end, 6) as lat_escala
from points
"""


@register("coord_checks", sql=_coord_sql())
def q_coord_checks(spark, sf_dir):
    """G-05, G-06, G-07, G-11, G-12, G-14 over every point."""
    p = fx.points(spark, sf_dir)
    lat_fix, _ = geo.fix_swapped("lat", "lon")
    scaled = p.withColumn("_micro", F.col("lat") * F.lit(1000000.0))
    return scaled.select(
        "pdv_id",
        geo.valid_coord("lat", "lon").alias("coord_ok"),
        geo.generic_coord("lat", "lon").alias("coord_generica"),
        geo.capital_default_point("lat", "lon").alias("ponto_padrao_capital"),
        lat_fix.alias("lat_fix"),
        F.round(geo.squared_degree_distance("lat", "lon", F.lit(-15.0), F.lit(-50.0)), 6).alias("dist2_graus"),
        geo.fix_scaled(F.col("_micro")).alias("lat_escala"))
