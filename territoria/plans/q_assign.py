"""Registered vendor-assignment and vendor-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fmt import number_ptbr
from ..operators import assign as A
from ..sources import fixtures as fx
from .q_routing import ROUTE, _cost_sql, _routes
from .registry import register

DIAS, FREQ = 21, 4  # round(21 / 4) = 5 routes per vendor
CAP = A.routes_per_vendor(DIAS, FREQ)


def _assigned(spark, sf_dir):
    stops = fx.route_stops(fx.points(spark, sf_dir))
    cen = stops.groupBy(*ROUTE).agg(F.round(F.avg("lat"), 6).alias("centro_lat"),
                                    F.round(F.avg("lon"), 6).alias("centro_lon"))
    routes = _routes(spark, sf_dir).join(cen, ROUTE)
    return A.assign_vendors(routes, ROUTE, DIAS, FREQ), stops


ASSIGN_SQL = _cost_sql() + f""",
cen as (select cluster_id, subcluster_seq, round(avg(lat), 6) as centro_lat, round(avg(lon), 6) as centro_lon
        from route_stops group by cluster_id, subcluster_seq),
assigned as (
  select r.*, c.centro_lat, c.centro_lon,
         cast(floor((row_number() over (order by c.centro_lon, c.centro_lat, r.cluster_id, r.subcluster_seq) - 1)
                    / cast({CAP} as double)) + 1 as int) as vendedor_id
  from routes r join cen c on c.cluster_id = r.cluster_id and c.subcluster_seq = r.subcluster_seq)
"""


@register("assign_vendors", sql=ASSIGN_SQL + """
select cluster_id, subcluster_seq, vendedor_id, n_pdvs, dist_total_km, tempo_total_min, centro_lat, centro_lon
from assigned
""")
def q_assign_vendors(spark, sf_dir):
    """R-09: routes swept west->east into vendors of round(dias/freq) routes each."""
    a, _ = _assigned(spark, sf_dir)
    return a.select(*ROUTE, "vendedor_id", "n_pdvs", "dist_total_km", "tempo_total_min", "centro_lat", "centro_lon")


@register("vendor_points", sql=ASSIGN_SQL + """
select s.pdv_id, a.vendedor_id, s.cluster_id, s.subcluster_seq
from route_stops s join assigned a on a.cluster_id = s.cluster_id and a.subcluster_seq = s.subcluster_seq
""")
def q_vendor_points(spark, sf_dir):
    """R-10: point -> vendor through its route."""
    a, stops = _assigned(spark, sf_dir)
    return A.vendor_points(a, stops, ROUTE).select("pdv_id", "vendedor_id", *ROUTE)


@register("vendor_base", sql=ASSIGN_SQL + """,
vb as (
  select vendedor_id, count(*) as total_rotas, cast(sum(n_pdvs) as bigint) as total_pdvs,
         round(case when sum(n_pdvs) > 0 then sum(centro_lat * n_pdvs) / sum(n_pdvs) else avg(centro_lat) end, 6) as base_lat,
         round(case when sum(n_pdvs) > 0 then sum(centro_lon * n_pdvs) / sum(n_pdvs) else avg(centro_lon) end, 6) as base_lon
  from assigned group by vendedor_id),
pv as (
  select a.vendedor_id, s.pdv_id, s.lat, s.lon, p.cidade
  from route_stops s join assigned a on a.cluster_id = s.cluster_id and a.subcluster_seq = s.subcluster_seq
  join points p on p.pdv_id = s.pdv_id),
near as (
  select vendedor_id, cidade from (
    select pv.vendedor_id, pv.cidade,
           row_number() over (partition by pv.vendedor_id
                              order by power(pv.lat - vb.base_lat, 2) + power(pv.lon - vb.base_lon, 2), pv.pdv_id) as rn
    from pv join vb on vb.vendedor_id = pv.vendedor_id) t where rn = 1)
select vb.*, near.cidade as base_cidade from vb left join near on near.vendedor_id = vb.vendedor_id
""")
def q_vendor_base(spark, sf_dir):
    """R-11 / A-04 / J-12: weighted base per vendor and the city of its nearest own point."""
    a, stops = _assigned(spark, sf_dir)
    pts = fx.points(spark, sf_dir).select("pdv_id", "cidade")
    pv = A.vendor_points(a, stops, ROUTE).join(pts, "pdv_id")
    return A.vendor_base(a, pv)


VENDOR_SUMMARY_SQL = ASSIGN_SQL + f""",
sales as (
  select a.vendedor_id, sum(cast(round(p.pdv_vendas * 100, 0) as bigint)) as cents, count(p.pdv_vendas) as nv
  from route_stops s join assigned a on a.cluster_id = s.cluster_id and a.subcluster_seq = s.subcluster_seq
  join points p on p.pdv_id = s.pdv_id group by a.vendedor_id),
tot as (
  select vendedor_id, count(*) as total_rotas, cast(sum(n_pdvs) as bigint) as total_pdvs,
         sum(cast(round(dist_total_km * 100, 0) as bigint)) / 100.0 as km_total,
         sum(cast(round(tempo_total_min * 10, 0) as bigint)) / 10.0 as tempo_total_min
  from assigned group by vendedor_id)
select t.vendedor_id, t.total_rotas, t.total_pdvs, t.km_total, t.tempo_total_min,
       round(t.km_total / nullif(t.total_rotas, 0), 2) as km_medio_por_rota,
       round(t.km_total / {float(DIAS)}, 2) as km_medio_diario,
       round(t.tempo_total_min / nullif(t.total_rotas, 0), 1) as tempo_medio_por_rota,
       coalesce(s.cents, 0) / 100.0 as vendas_total,
       coalesce(floor((2 * s.cents + s.nv) / cast(2 * s.nv as double)) / 100.0, 0.0) as vendas_media
from tot t left join sales s on s.vendedor_id = t.vendedor_id
"""


@register("vendor_summary", sql=VENDOR_SUMMARY_SQL)
def q_vendor_summary(spark, sf_dir):
    """X-03 / A-12 / A-13 / P-35: per vendor routes, km, minutes, sales and means."""
    a, stops = _assigned(spark, sf_dir)
    pts = fx.points(spark, sf_dir).select("pdv_id", "pdv_vendas")
    sales = (A.vendor_points(a, stops, ROUTE).join(pts, "pdv_id").groupBy("vendedor_id")
             .agg(F.sum(F.round(F.col("pdv_vendas") * 100, 0).cast("long")).alias("_c"),
                  F.count("pdv_vendas").alias("_nv")))
    # money in integer cents: order-free sums, half-up mean
    sales = sales.select("vendedor_id", (F.col("_c") / F.lit(100.0)).alias("_vt"),
                         (F.floor((2 * F.col("_c") + F.col("_nv")) / (2 * F.col("_nv")).cast("double"))
                          / F.lit(100.0)).alias("_vm"))
    # per-route facts are summed once per route id (not SUM(DISTINCT km), Q8)
    tot = a.groupBy("vendedor_id").agg(
        F.count(F.lit(1)).alias("total_rotas"), F.sum("n_pdvs").cast("long").alias("total_pdvs"),
        (F.sum(F.round(F.col("dist_total_km") * 100, 0).cast("long")) / F.lit(100.0)).alias("km_total"),
        (F.sum(F.round(F.col("tempo_total_min") * 10, 0).cast("long")) / F.lit(10.0)).alias("tempo_total_min"))
    j = tot.join(sales, "vendedor_id", "left")
    return j.select("vendedor_id", "total_rotas", "total_pdvs", "km_total", "tempo_total_min",
                    F.round(F.col("km_total") / F.nullif(F.col("total_rotas"), F.lit(0)), 2).alias("km_medio_por_rota"),
                    F.round(F.col("km_total") / F.lit(float(DIAS)), 2).alias("km_medio_diario"),
                    F.round(F.col("tempo_total_min") / F.nullif(F.col("total_rotas"), F.lit(0)), 1)
                    .alias("tempo_medio_por_rota"),
                    F.coalesce("_vt", F.lit(0.0)).alias("vendas_total"),
                    F.coalesce("_vm", F.lit(0.0)).alias("vendas_media"))


PTBR_DECIMALS = ("km_total", "km_medio_por_rota", "km_medio_diario", "tempo_total_min", "tempo_medio_por_rota", "vendas_total", "vendas_media")


@register("vendor_summary_ptbr", sql="select vendedor_id, total_rotas, total_pdvs, " + ", ".join(
    f"translate(format('{{:,.1f}}', cast({c} as double)), ',.', '.,') as {c}" for c in PTBR_DECIMALS) + " from (" + VENDOR_SUMMARY_SQL + ") t")
def q_vendor_summary_ptbr(spark, sf_dir):
    """P-32: the vendor summary with `1.234,5` number text for the export."""
    s = q_vendor_summary(spark, sf_dir)
    cols = ["km_total", "km_medio_por_rota", "km_medio_diario", "tempo_total_min", "tempo_medio_por_rota",
            "vendas_total", "vendas_media"]
    return s.select("vendedor_id", "total_rotas", "total_pdvs", *[number_ptbr(c).alias(c) for c in cols])
