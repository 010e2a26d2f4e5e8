"""Registered report queries (X-01, X-02, X-04, X-05, X-08, X-10, X-12, A-18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..functions.ids import format_cnpj
from ..operators import assign as A
from ..operators.aggregates import cluster_metrics
from ..operators.layers import density_layer
from ..operators.spatial import nearest
from ..sources import fixtures as fx
from .q_assign import ASSIGN_SQL, _assigned
from .q_clustering import KMH, NEAREST_CTE
from .q_routing import ROUTE
from .registry import register


def _route_city(spark, sf_dir):
    stops = fx.route_stops(fx.points(spark, sf_dir))
    pts = fx.points(spark, sf_dir).select("pdv_id", "cidade")
    c = stops.join(pts, "pdv_id").groupBy(*ROUTE, "cidade").agg(F.count(F.lit(1)).alias("_n"))
    # A-18: most frequent city of the route, ties by name (max_by over (n, -name) order)
    return c.groupBy(*ROUTE).agg(F.min_by("cidade", F.struct(-F.col("_n"), F.col("cidade"))).alias("cidade"))


ROUTE_CITY_SQL = """,
rc as (select s.cluster_id, s.subcluster_seq, p.cidade, count(*) as n
       from route_stops s join points p on p.pdv_id = s.pdv_id group by 1, 2, 3),
route_city as (select cluster_id, subcluster_seq, cidade from (
  select *, row_number() over (partition by cluster_id, subcluster_seq order by n desc, cidade) as rn from rc) t where rn = 1)
"""


@register("routes_with_vendor", sql=ASSIGN_SQL + ROUTE_CITY_SQL + """
select a.cluster_id, a.subcluster_seq, a.vendedor_id, rc.cidade, a.centro_lat, a.centro_lon,
       a.n_pdvs, a.dist_total_km, a.tempo_total_min
from assigned a join route_city rc on rc.cluster_id = a.cluster_id and rc.subcluster_seq = a.subcluster_seq
""")
def q_routes_with_vendor(spark, sf_dir):
    """X-01 / A-18 / J-04: operational routes with vendor, representative city and centre."""
    a, _ = _assigned(spark, sf_dir)
    return a.join(_route_city(spark, sf_dir), ROUTE).select(
        *ROUTE, "vendedor_id", "cidade", "centro_lat", "centro_lon", "n_pdvs", "dist_total_km", "tempo_total_min")


def _half_up_sql(units: str, den: str, scale: int) -> str:
    return f"(floor((2 * ({units}) + ({den})) / cast(2 * ({den}) as double)) / {10 ** scale}.0)"


def _half_up(units, den, scale: int):
    """Half-up rounding of units/den (both integers) to `scale` decimals, exact in any engine."""
    return F.floor((2 * units + den) / (2 * den).cast("double")) / F.lit(float(10 ** scale))


@register("route_point_summary", sql=ASSIGN_SQL + f"""
select cluster_id, subcluster_seq, n_pdvs,
       case when n_pdvs > 0 then {_half_up_sql('cast(round(dist_total_km * 100, 0) as bigint) * 10', 'n_pdvs', 3)} end as km_por_pdv,
       case when n_pdvs > 0 then {_half_up_sql('cast(round(tempo_total_min * 10, 0) as bigint) * 100', 'n_pdvs', 3)} end as min_por_pdv,
       {_half_up_sql('cast(round(dist_total_km * 100, 0) as bigint) * 10', '20', 3)} as km_por_dia
from assigned
""")
def q_route_point_summary(spark, sf_dir):
    """X-02 / P-35: per route points and per-point / per-day ratios (null-safe, half-up)."""
    a, _ = _assigned(spark, sf_dir)
    ckm = F.round(F.col("dist_total_km") * 100, 0).cast("long") * 10
    dmin = F.round(F.col("tempo_total_min") * 10, 0).cast("long") * 100
    n = F.col("n_pdvs")
    return a.select(*ROUTE, "n_pdvs",
                    F.when(n > 0, _half_up(ckm, n, 3)).alias("km_por_pdv"),
                    F.when(n > 0, _half_up(dmin, n, 3)).alias("min_por_pdv"),
                    _half_up(ckm, F.lit(20), 3).alias("km_por_dia"))


@register("point_vendor_listing", sql=ASSIGN_SQL + """,
vb as (
  select vendedor_id,
         round(case when sum(n_pdvs) > 0 then sum(centro_lat * n_pdvs) / sum(n_pdvs) else avg(centro_lat) end, 6) as base_lat,
         round(case when sum(n_pdvs) > 0 then sum(centro_lon * n_pdvs) / sum(n_pdvs) else avg(centro_lon) end, 6) as base_lon
  from assigned group by vendedor_id)
select s.pdv_id, a.vendedor_id,
       regexp_replace(lpad(p.cnpj, 14, '0'), '^(\\d{2})(\\d{3})(\\d{3})(\\d{4})(\\d{2})$', '\\1.\\2.\\3/\\4-\\5') as cnpj_fmt,
       p.cidade, vb.base_lat, vb.base_lon
from route_stops s join assigned a on a.cluster_id = s.cluster_id and a.subcluster_seq = s.subcluster_seq
join points p on p.pdv_id = s.pdv_id left join vb on vb.vendedor_id = a.vendedor_id
""")
def q_point_vendor_listing(spark, sf_dir):
    """X-04 / J-05 / P-23: every point with its vendor, vendor base and formatted CNPJ."""
    a, stops = _assigned(spark, sf_dir)
    pts = fx.points(spark, sf_dir).select("pdv_id", "cnpj", "cidade")
    pv = A.vendor_points(a, stops, ROUTE)
    base = A.vendor_base(a, pv.join(pts, "pdv_id")).select("vendedor_id", "base_lat", "base_lon")
    return (pv.join(pts, "pdv_id").join(base, "vendedor_id", "left")
            .select("pdv_id", "vendedor_id", format_cnpj("cnpj").alias("cnpj_fmt"), "cidade", "base_lat", "base_lon"))


@register("cluster_summary_sales", sql=fx.with_fixtures("points", "centers").rstrip() + "," + NEAREST_CTE + f"""
select b.centro_id, c.nome as centro_nome,
       cast(count(*) as bigint) as n_pdvs,
       round(avg(b.d), 3) as distancia_media_km, round(max(b.d), 3) as dist_max_km,
       round(max(b.d) / {KMH} * 60.0, 3) as tempo_max_min,
       sum(cast(round(coalesce(p.pdv_vendas, 0) * 100, 0) as bigint)) / 100.0 as vendas_total
from best b join points p on p.pdv_id = b.pdv_id join centers c on c.centro_id = b.centro_id
group by b.centro_id, c.nome
""")
def q_cluster_summary_sales(spark, sf_dir):
    """X-05 / A-01 / A-13: per-sector recomputed metrics, sales total (null = 0) and centre name."""
    pts = fx.points(spark, sf_dir)
    cen = fx.centers(spark, sf_dir)
    a = nearest(pts, cen, "centro_id")
    m = cluster_metrics(a, ["centro_id"], KMH).select("centro_id", "n_pdvs", "distancia_media_km",
                                                      "dist_max_km", "tempo_max_min")
    s = a.groupBy("centro_id").agg(
        (F.sum(F.round(F.coalesce("pdv_vendas", F.lit(0.0)) * 100, 0).cast("long")) / F.lit(100.0)).alias("vendas_total"))
    return m.join(s, "centro_id").join(cen.select("centro_id", F.col("nome").alias("centro_nome")), "centro_id")


@register("points_by_route_order", sql=fx.with_fixtures("route_stops") + """
select s.cluster_id, s.subcluster_seq, s.pdv_id,
       cast(row_number() over (partition by s.cluster_id, s.subcluster_seq order by s.lon, s.lat, s.pdv_id) as int) as sequencia_ordem,
       p.cidade, p.cnpj
from route_stops s join points p on p.pdv_id = s.pdv_id
""")
def q_points_by_route_order(spark, sf_dir):
    """X-08 / W-08 / J-04: point x cluster x route listing with its stop number."""
    from pyspark.sql.window import Window
    pts = fx.points(spark, sf_dir)
    stops = fx.route_stops(pts)
    w = Window.partitionBy(*ROUTE).orderBy("lon", "lat", "pdv_id")
    seq = stops.withColumn("sequencia_ordem", F.row_number().over(w).cast("int"))
    return seq.join(pts.select("pdv_id", "cidade", "cnpj"), "pdv_id").select(
        *ROUTE, "pdv_id", "sequencia_ordem", "cidade", "cnpj")


GRID = 0.25


@register("density_grid", sql=fx.with_fixtures("points") + f"""
select cast(floor(lat / {GRID}) as bigint) as gy, cast(floor(lon / {GRID}) as bigint) as gx,
       count(*) as n,
       (floor(lat / {GRID}) + 0.5) * {GRID} as cell_lat, (floor(lon / {GRID}) + 0.5) * {GRID} as cell_lon,
       greatest(cast(3.0 as double), least(cast(12.0 as double), cast(3.0 as double) + cast(0.6 as double) * count(*))) as tamanho
from points group by 1, 2, 4, 5
""")
def q_density_grid(spark, sf_dir):
    """X-10: map layer as data: point density per 0.25-degree cell with bubble size."""
    return density_layer(fx.points(spark, sf_dir), GRID)


@register("point_search", sql=fx.with_fixtures("points") + """
select pdv_id, cnpj, cidade, uf from points
where tenant_id = 2 and (cnpj like '%12%' or lower(cidade) like '%nation_2%')
order by cidade, pdv_id limit 50
""")
def q_point_search(spark, sf_dir):
    """X-12 / F-03 / F-08 / L-01: tenant-scoped search by CNPJ fragment or place, first page."""
    p = fx.points(spark, sf_dir).filter(F.col("tenant_id") == 2)
    p = p.filter(F.col("cnpj").contains("12") | F.lower(F.col("cidade")).contains("nation_2"))
    return p.orderBy("cidade", "pdv_id").limit(50).select("pdv_id", "cnpj", "cidade", "uf")


@register("route_snapshots", sql=ASSIGN_SQL + ROUTE_CITY_SQL + """
select 'snap-' || cast(a.cluster_id % 5 as varchar) as snapshot_id, 'mensal' as nome, a.cluster_id, a.subcluster_seq,
       a.vendedor_id, rc.cidade
from assigned a join route_city rc on rc.cluster_id = a.cluster_id and rc.subcluster_seq = a.subcluster_seq
where rc.cidade ilike '%1%'
""")
def q_route_snapshots(spark, sf_dir):
    """K-14 / F-03: routes frozen under a snapshot id per group of clusters, listed by city filter."""
    from ..operators.tables import snapshot
    a, _ = _assigned(spark, sf_dir)
    r = a.join(_route_city(spark, sf_dir), ROUTE).select(*ROUTE, "vendedor_id", "cidade")
    snaps = snapshot(r, F.concat(F.lit("snap-"), (F.col("cluster_id") % 5).cast("string")), "mensal", ["auto"])
    return snaps.filter(F.col("cidade").ilike("%1%")).select("snapshot_id", "nome", *ROUTE, "vendedor_id", "cidade")


@register("latest_run_detail", sql=fx.with_fixtures("points", "job_log") + """,
runs as (select distinct on (input_id) input_id, id as run_id, tenant_id from job_log
         where status = 'done' order by input_id, criado_em desc, id desc)
select r.input_id, r.run_id, p.pdv_id, p.cidade
from runs r join points p on p.tenant_id = r.tenant_id and p.zona = cast(substring(r.input_id, 7) as int) % 25
""")
def q_latest_run_detail(spark, sf_dir):
    """X-06 / W-01 / J-04: newest finished run per clustering and the points of its zone."""
    from ..operators.windows import latest_per_key
    j = fx.job_log(spark, sf_dir).filter(F.col("status") == "done")
    runs = latest_per_key(j.select("input_id", "id", "tenant_id", "criado_em"), ["input_id"], "criado_em", "id")
    runs = runs.select("input_id", F.col("id").alias("run_id"), "tenant_id",
                       (F.substring("input_id", 7, 10).cast("int") % 25).alias("zona"))
    p = fx.points(spark, sf_dir).select("pdv_id", "cidade", "tenant_id", "zona")
    return runs.join(p, ["tenant_id", "zona"]).select("input_id", "run_id", "pdv_id", "cidade")
