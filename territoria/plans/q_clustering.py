"""Registered clustering queries (nearest centre, metrics, outliers, sweep, Lloyd)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql
from ..operators.aggregates import cluster_metrics
from ..operators.spatial import nearest
from ..sources import fixtures as fx
from .registry import register

KMH = 35.0  # speed used by the reference's own run notes


def _hav(a: str, b: str) -> str:
    return haversine_sql(f"{a}.lat", f"{a}.lon", f"{b}.lat", f"{b}.lon")


NEAREST_CTE = f"""
cand as (
  select p.pdv_id, c.centro_id, {_hav('p', 'c')} as d
  from points p, centers c),
best as (
  select pdv_id, centro_id, d from (
    select *, row_number() over (partition by pdv_id order by d, centro_id) as rn from cand) t
  where rn = 1)
"""


@register("cluster_metrics", sql=fx.with_fixtures("points", "centers").rstrip() + "," + NEAREST_CTE + f"""
select centro_id,
       cast(count(*) as bigint) as n_pdvs,
       round(avg(d), 3) as distancia_media_km,
       round(max(d), 3) as dist_max_km,
       round(avg(d) / {KMH} * 60.0, 3) as tempo_medio_min,
       round(max(d) / {KMH} * 60.0, 3) as tempo_max_min,
       round(quantile_cont(d, 0.95), 3) as raio_p95_km
from best group by centro_id
""")
def q_cluster_metrics(spark, sf_dir):
    """J-07 + A-01: every point to its nearest centre, then per-centre metrics."""
    pts = fx.points(spark, sf_dir)
    cen = fx.centers(spark, sf_dir)
    assigned = nearest(pts, cen, "centro_id")
    return cluster_metrics(assigned, ["centro_id"], KMH)


KNN_SQL = fx.with_fixtures("points") + f""",
pairs as (
  select a.pdv_id, a.tenant_id, {_hav('a', 'b')} as d, b.pdv_id as other
  from points a join points b on b.tenant_id = a.tenant_id and b.pdv_id <> a.pdv_id),
ranked as (
  select *, row_number() over (partition by pdv_id order by d, other) as rn from pairs),
nn as (
  select pdv_id, tenant_id, min(d) as d1, avg(d) as dk from ranked where rn <= 5 group by pdv_id, tenant_id),
st as (
  select tenant_id, count(*) as n, avg(d1) + 1.5 * stddev_pop(d1) as lim from nn group by tenant_id)
select nn.pdv_id, nn.tenant_id, round(nn.d1, 6) as dist_vizinho_km, round(nn.dk, 6) as distancia_media_km,
       (st.n >= 5 and nn.d1 > st.lim) as is_outlier
from nn join st on st.tenant_id = nn.tenant_id
"""


@register("outliers_knn", sql=KNN_SQL)
def q_outliers_knn(spark, sf_dir):
    """C-04 / J-09 / A-14: nearest-neighbour distance vs mean + 1.5 std per tenant; mean km to 5 neighbours."""
    from ..operators.quality import flag_outliers
    pts = fx.points(spark, sf_dir)
    o = flag_outliers(pts, z=1.5, by=("tenant_id",))
    return o.select("pdv_id", "tenant_id", F.round("dist_vizinho_km", 6).alias("dist_vizinho_km"),
                    F.round("distancia_media_km", 6).alias("distancia_media_km"), "is_outlier")


SWEEP_CAP = 25


def _sweep_sql() -> str:
    ang = ("atan2(sin(radians(p.lon - c.lon_ref)) * cos(radians(p.lat)), "
           "cos(radians(c.lat_ref)) * sin(radians(p.lat)) - sin(radians(c.lat_ref)) * cos(radians(p.lat)) "
           "* cos(radians(p.lon - c.lon_ref)))")
    dist = haversine_sql("c.lat_ref", "c.lon_ref", "p.lat", "p.lon")
    return fx.with_fixtures("points") + f""",
cen as (select cidade, round(avg(lat), 9) as lat_ref, round(avg(lon), 9) as lon_ref from points group by cidade),
o as (
  select p.pdv_id, p.cidade,
         case when {ang} >= 0 then {ang} else {ang} + 2 * pi() end as ang, {dist} as dist
  from points p join cen c on c.cidade = p.cidade)
select pdv_id, cidade,
       cast(floor((row_number() over (partition by cidade order by ang, dist, pdv_id) - 1) / cast({SWEEP_CAP} as double)) as int) as setor
from o
"""


@register("capacitated_sweep", sql=_sweep_sql())
def q_capacitated_sweep(spark, sf_dir):
    """C-11 / G-04 / W-06: per city, sweep by bearing round the centroid, cut every 25 points."""
    from ..operators.sweep import capacitated_sweep
    pts = fx.points(spark, sf_dir).select("pdv_id", "cidade", "lat", "lon")
    return capacitated_sweep(pts, SWEEP_CAP, ["cidade"]).select("pdv_id", "cidade", "setor")


LLOYD_CAP = 20
LLOYD_ITERS = 3


def _lloyd_sql(iters: int) -> str:
    parts = [f"""
g as (select zona, pdv_id, lat, lon from points),
n as (select zona, count(*) as n, cast(greatest(1, ceil(count(*) / cast({LLOYD_CAP} as double))) as int) as k
      from g group by zona),
r as (select g.*, row_number() over (partition by zona order by lon, lat, pdv_id) as rk from g),
c0 as (select zona, c, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from (
         select r.*, cast(floor((r.rk - 1) * n.k / cast(n.n as double)) as int) as c
         from r join n on n.zona = r.zona) t group by zona, c)"""]

    def assign(i: int) -> str:
        return f"""
a{i} as (select zona, pdv_id, lat, lon, c from (
  select g.zona, g.pdv_id, g.lat, g.lon, c.c,
         row_number() over (partition by g.pdv_id order by power(g.lat - c.lat, 2) + power(g.lon - c.lon, 2), c.c) as rn
  from g join c{i} c on c.zona = g.zona) t where rn = 1)"""

    for i in range(iters):
        parts.append(assign(i))
        parts.append(f"""
c{i + 1} as (select o.zona, o.c, coalesce(m.lat, o.lat) as lat, coalesce(m.lon, o.lon) as lon
  from c{i} o left join (select zona, c, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon
                          from a{i} group by zona, c) m on m.zona = o.zona and m.c = o.c)""")
    parts.append(assign(iters))
    return (fx.with_fixtures("points").rstrip() + "," + ",".join(parts)
            + f"\nselect pdv_id, zona, c as cluster_id from a{iters}")


@register("kmeans_grouped", sql=_lloyd_sql(LLOYD_ITERS))
def q_kmeans_grouped(spark, sf_dir):
    """C-05 + C-06: k = ceil(n / 20) per zone, grouped Lloyd (3 fixed rounds) for all zones in one job."""
    from ..operators.lloyd import k_for_capacity, kmeans
    pts = fx.points(spark, sf_dir)
    k = k_for_capacity(pts, ["zona"], LLOYD_CAP)
    res, _ = kmeans(pts, k, ["zona"], max_iter=LLOYD_ITERS, fixed_iter=True)
    return res.select("pdv_id", "zona", F.col("c").alias("cluster_id"))


CAP_PURE, TEMPO_PURE = 20, 30.0


@register("kmeans_capacity")
def q_kmeans_capacity(spark, sf_dir):
    """C-07: per zone, smallest k (from ceil(n/20)) whose clusters hold <= 20 points
    within 30 minutes of their centre; candidate k values evaluated in batches."""
    from ..operators.clustering import kmeans_capacity
    pts = fx.points(spark, sf_dir).select("pdv_id", "zona", "lat", "lon")
    return kmeans_capacity(pts, ["zona"], CAP_PURE, TEMPO_PURE, KMH, batch=4)


BAL_MIN, BAL_MAX, BAL_TEMPO, BAL_MERGE = 5, 25, 60.0, 50.0


@register("balance_fixed_centres")
def q_balance_fixed_centres(spark, sf_dir):
    """C-16 / C-18: points start at their nearest fixed centre; oversize clusters shed
    border points to neighbours, undersize centres are dropped when all points fit elsewhere."""
    from ..operators.clustering import balance_points
    pts = fx.points(spark, sf_dir)
    cen = fx.centers(spark, sf_dir).select(F.col("centro_id").alias("label"), "lat", "lon")
    start = nearest(pts, cen, "label", out_id="label").select("pdv_id", "lat", "lon", "label")
    a, kept = balance_points(start, cen, BAL_MIN, BAL_MAX, BAL_TEMPO, KMH, BAL_MERGE)
    return a.select("pdv_id", F.col("label").alias("centro_id"))


DB_EPS_KM, DB_MIN_SAMPLES = 15.0, 6


def _density_sql(group: str, params: str) -> str:
    """Density sectors by definition: neighbours by all pairs of a group, components by recursion.
    `params` defines par (grp, eps, ms)."""
    return fx.with_fixtures("points").replace("with ", "with recursive ", 1) + f""",
g as (select pdv_id, {group} as grp, lat, lon from points),
{params},
nb as (select a.grp, a.pdv_id as a, b.pdv_id as b, power(a.lat - b.lat, 2) + power(a.lon - b.lon, 2) as d2
       from g a join g b on b.grp = a.grp join par on par.grp = a.grp
       where power(a.lat - b.lat, 2) + power(a.lon - b.lon, 2) <= par.eps * par.eps),
core as (select nb.a from nb join par on par.grp = nb.grp group by nb.a, par.ms having count(*) >= par.ms),
edge as (select nb.a, nb.b from nb join core x on x.a = nb.a join core y on y.a = nb.b),
reach(a, b) as (select a, a from core union select r.a, e.b from reach r join edge e on e.a = r.b),
comp as (select a, min(b) as comp from reach group by a),
border as (select nb.a, arg_min(c.comp, nb.d2) as comp from nb join comp c on c.a = nb.b
           where nb.a not in (select a from core) group by nb.a),
placed as (select g.*, t.comp from g join (select * from comp union all select * from border) t on t.a = g.pdv_id),
means as (select grp, comp, avg(lat) as lat, avg(lon) as lon from placed group by grp, comp),
noise as (select g.pdv_id, g.grp, m.comp, row_number() over (partition by g.pdv_id order by {_hav('g', 'm')}, m.comp) as rn
          from g join means m on m.grp = g.grp where g.pdv_id not in (select pdv_id from placed)),
everything as (select pdv_id, grp, comp from placed union all select pdv_id, grp, comp from noise where rn = 1),
labels as (select grp, comp, row_number() over (partition by grp order by min(pdv_id)) - 1 as cluster_id
           from everything group by grp, comp)
select g.pdv_id, g.grp as {group}, g.lat, g.lon, cast(coalesce(l.cluster_id, 0) as int) as cluster_id
from g left join everything e on e.pdv_id = g.pdv_id left join labels l on l.grp = e.grp and l.comp = e.comp
"""


@register("dbscan_sectors", sql=_density_sql("tenant_id", f"""
par as (select distinct grp, cast({DB_EPS_KM} as double) / 111.0 as eps, {DB_MIN_SAMPLES} as ms from g)"""))
def q_dbscan_sectors(spark, sf_dir):
    """C-13 / J-10: density sectors per tenant (eps 15 km, min 6 points); noise joins the nearest cluster."""
    from ..operators.clustering import dbscan
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "lat", "lon")
    return dbscan(pts, DB_EPS_KM, DB_MIN_SAMPLES, by=("tenant_id",))


ADAPTIVE = {"eps_min_km": 2.0, "eps_max_km": 12.0, "ms_min": 2, "ms_max": 6}
ADAPTIVE_CTE = f"""
place as (select grp, lat, lon, min(pdv_id) as pdv_id from g group by grp, lat, lon),
near as (select a.grp, a.pdv_id, min({_hav('a', 'b')}) as d
         from place a join place b on b.grp = a.grp and b.pdv_id <> a.pdv_id group by a.grp, a.pdv_id),
med as (select grp, quantile_cont(d, 0.5) as med from near group by grp),
par0 as (
  select n.grp, least(greatest(coalesce(med, 0.0) * 20.0, 2.0), 12.0) as eps_km,
         case when n < 60 then least(greatest(n // 2, 3), 30)
              else floor(2 + least(greatest((1.0 / (coalesce(med, 0.0) + 1e-6) - 0.05) / 0.1, 0.0), 1.0) * 4) end as ms
  from (select grp, count(*) as n from g group by grp) n left join med on med.grp = n.grp),
par as (select grp, eps_km / 111.0 as eps, ms from par0)"""


@register("density_params", sql=fx.with_fixtures("points") + f""",
g as (select pdv_id, zona as grp, lat, lon from points),
{ADAPTIVE_CTE}
select grp as zona, round(eps_km, 6) as eps_km, cast(ms as int) as min_samples from par0
""")
def q_density_params(spark, sf_dir):
    """C-05 / C-13: eps and min_samples of every zone from the exact median distance between its places."""
    from ..operators.clustering import adaptive_dbscan_params
    p = adaptive_dbscan_params(fx.points(spark, sf_dir).select("pdv_id", "zona", "lat", "lon"), by=("zona",), **ADAPTIVE)
    return p.select("zona", F.round("eps_km", 6).alias("eps_km"), "min_samples")


@register("dbscan_adaptive", sql=_density_sql("zona", ADAPTIVE_CTE))
def q_dbscan_adaptive(spark, sf_dir):
    """C-13: density sectors per zone, each zone with its own eps and min_samples."""
    from ..operators.clustering import adaptive_dbscan_params, dbscan
    pts = fx.points(spark, sf_dir).select("pdv_id", "zona", "lat", "lon")
    return dbscan(pts, by=("zona",), params=adaptive_dbscan_params(pts, by=("zona",), **ADAPTIVE))


DENSE_CAP = 25


@register("dense_subset_city", sql=fx.with_fixtures("points") + f""",
s as (select a.cidade, a.pdv_id, sum({_hav('a', 'b')}) as tot
      from points a join points b on b.cidade = a.cidade group by a.cidade, a.pdv_id),
m as (select cidade, pdv_id as medoid_id from (
        select *, row_number() over (partition by cidade order by tot, pdv_id) as rn from s) t where rn = 1),
d as (select p.pdv_id, p.cidade, m.medoid_id, {haversine_sql('p.lat', 'p.lon', 'q.lat', 'q.lon')} as dm
      from points p join m on m.cidade = p.cidade join points q on q.pdv_id = m.medoid_id)
select pdv_id, cidade, medoid_id, round(dm, 6) as dist_medoide_km from (
  select *, row_number() over (partition by cidade order by dm, pdv_id) as rk from d) t where rk <= {DENSE_CAP}
""")
def q_dense_subset_city(spark, sf_dir):
    """C-12 / L-03: per city, the 25 points nearest the exact medoid (bounded candidate search)."""
    from ..operators.clustering import dense_subset
    pts = fx.points(spark, sf_dir).select("pdv_id", "cidade", "lat", "lon")
    out = dense_subset(pts, DENSE_CAP, ["cidade"])
    return out.select("pdv_id", "cidade", "medoid_id", F.round("dist_medoide_km", 6).alias("dist_medoide_km"))


@register("cep_clusters_by_time")
def q_cep_clusters_by_time(spark, sf_dir):
    """C-15: client-weighted CEP clusters per tenant within 40 minutes at 35 km/h; outlier flags."""
    from ..operators.clustering import cluster_ceps_by_time
    m = fx.marketplace_cep(spark, sf_dir)
    p = fx.points(spark, sf_dir).select(
        F.lpad(((F.col("pdv_id") * 6553) % 100000000).cast("string"), 8, "0").alias("cep"), "lat", "lon")
    ceps = m.join(p, "cep").select("tenant_id", "cep", "lat", "lon", "clientes_total", "clientes_target")
    out = cluster_ceps_by_time(ceps, ["tenant_id"], 40.0, KMH)
    return out.select("tenant_id", "cep", "cluster_id", "k_final", F.round("cluster_lat", 6).alias("cluster_lat"),
                      F.round("cluster_lon", 6).alias("cluster_lon"), F.round("distancia_km", 3).alias("distancia_km"),
                      F.round("tempo_min", 3).alias("tempo_min"), "is_outlier")


@register("kmeans_balanced")
def q_kmeans_balanced(spark, sf_dir):
    """C-08: k = ceil(n/40) per zone, clusters above 25 points split once, route estimate status."""
    from ..operators.clustering import kmeans_balanced
    from ..operators.lloyd import k_for_capacity
    pts = fx.points(spark, sf_dir).select("pdv_id", "zona", "lat", "lon")
    pts_, status = kmeans_balanced(pts, ["zona"], k_for_capacity(pts, ["zona"], 40), 25, KMH, 10.0, 480.0)
    return status


@register("recluster_recursive")
def q_recluster_recursive(spark, sf_dir):
    """C-10: zones split in two, level by level, until every cluster holds <= 20 points within 30 minutes."""
    from ..operators.clustering import recluster_recursive
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "zona", "lat", "lon")
    return recluster_recursive(pts, ["tenant_id"], "zona", 20, 30.0, KMH)


@register("refine_by_workload")
def q_refine_by_workload(spark, sf_dir):
    """C-09: per zone start from int(21/4) routes and grow until every route fits 8 h and 200 km."""
    from ..operators import routing as R
    p = fx.points(spark, sf_dir).select("pdv_id", F.col("zona").alias("cluster_id"), "lat", "lon")
    dep = p.groupBy("cluster_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    totals, _ = R.split_until_feasible(p, dep, ["cluster_id"], 480.0, 200.0, KMH, 10.0, 1.3,
                                       k_start=21 // 4)
    return totals


@register("run_clustering")
def q_run_clustering(spark, sf_dir):
    """C-19: dedupe, outlier flags, capacity k-search per tenant, sectors with centres and metrics."""
    from ..operators.clustering import run_clustering
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "cnpj", "lat", "lon")
    sectors, _ = run_clustering(pts, ["tenant_id"], 60, 90.0, KMH)
    return sectors


@register("balance_ceps")
def q_balance_ceps(spark, sf_dir):
    """C-17: CEPs at their nearest centre, oversize centres shed CEPs to neighbours within 50 km,
    centres under 8 CEPs merged into the nearest kept centre."""
    from ..operators.clustering import balance_points
    m = fx.marketplace_cep(spark, sf_dir).select("cep")
    p = fx.points(spark, sf_dir).select(
        F.lpad(((F.col("pdv_id") * 6553) % 100000000).cast("string"), 8, "0").alias("cep"), "pdv_id", "lat", "lon")
    ceps = m.join(p, "cep")
    cen = fx.centers(spark, sf_dir).select(F.col("centro_id").alias("label"), "lat", "lon")
    start = nearest(ceps, cen, "label", out_id="label").select("pdv_id", "cep", "lat", "lon", "label")
    a, kept = balance_points(start.drop("cep"), cen, 8, 30, 60.0, KMH, 50.0, undersize="merge_nearest")
    return a.join(start.select("pdv_id", "cep"), "pdv_id").select("cep", F.col("label").alias("centro_id"))


@register("active_balanced")
def q_active_balanced(spark, sf_dir):
    """C-18: fixed centres, nearest assignment, balancing 5..25 points within 60 minutes,
    dense labels and sector metrics."""
    from ..operators.clustering import active_balanced
    sectors, _ = active_balanced(fx.points(spark, sf_dir), fx.centers(spark, sf_dir), BAL_MIN, BAL_MAX,
                                 BAL_TEMPO, KMH, BAL_MERGE)
    return sectors


REFINE = {"max_min": 480.0, "max_km": 200.0, "kmh": KMH, "service_min": 10.0}


@register("refine_macro_clusters")
def q_refine_macro_clusters(spark, sf_dir):
    """C-09: per tenant the smallest number of macro clusters, from ceil(n / 250) on, whose int(21/4)
    sub-clusters each fit a tour of 8 h and 200 km."""
    from ..operators.clustering import refine_macro
    from ..operators.lloyd import k_for_capacity
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "lat", "lon")
    subs, _ = refine_macro(pts, ["tenant_id"], k_for_capacity(pts, ["tenant_id"], 250), 21 // 4, **REFINE)
    return subs


@register("recluster_by_route")
def q_recluster_by_route(spark, sf_dir):
    """C-10: zones whose tour exceeds 8 h or 200 km split in 2, 3, ... parts, labels by level."""
    from ..operators.clustering import recluster_by_route
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "zona", "lat", "lon")
    members, _ = recluster_by_route(pts, ["tenant_id"], "zona", 5, **REFINE)
    return members


@register("recluster_by_route_clusters")
def q_recluster_by_route_clusters(spark, sf_dir):
    """C-10: the clusters of `recluster_by_route` with centre, tour km, minutes and status."""
    from ..operators.clustering import recluster_by_route
    pts = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "zona", "lat", "lon")
    _, clusters = recluster_by_route(pts, ["tenant_id"], "zona", 5, **REFINE)
    return clusters
