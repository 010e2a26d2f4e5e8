"""Registered queries of map layers, histories, sheets and snapshots (X-07, X-09, X-10, X-11, A-09, K-14, R-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign as A
from ..operators import layers as L
from ..operators import routing as R
from ..operators import tables as T
from ..operators.quality import clean_points_raw
from ..operators.routing import routing_summary
from ..operators.windows import ranked
from ..sources import fixtures as fx
from . import reports
from .q_assign import ASSIGN_SQL, _assigned
from .q_misc import CEP_ASSIGN_SQL, _cep_assign
from .q_routing import ALPHA, KMH, ROUTE, _cost_sql, _depots, _routes
from .q_text import _clean_sql
from .registry import register

NOISE_CELL = 0.5
TENANT = 2

# ------------------------------------------------------------------ X-10 layers
ADDRESS_SQL = fx.with_fixtures("points", "points_raw").rstrip() + "," + _clean_sql().rstrip() + """,
addressed as (
  select p.pdv_id, p.tenant_id, p.zona, p.cnpj, p.cidade, p.uf, case when p.pdv_id % 13 <> 0 then p.lat end as lat,
         case when p.pdv_id % 13 <> 0 then p.lon end as lon,
         coalesce(nullif(case when starts_with(c.bairro, 'Centro') then c.pdv_endereco_completo else '' end, ''),
                  coalesce(c.logradouro, '')
                  || case when c.numero is not null and c.numero <> '' then ', ' || c.numero else '' end
                  || case when c.bairro is not null and c.bairro <> '' then ' - ' || c.bairro else '' end
                  || case when p.cidade is not null and p.cidade <> '' then ', ' || p.cidade else '' end
                  || case when p.uf is not null and p.uf <> '' then '/' || p.uf else '' end) as endereco
  from points p join clean c on c.row_id = p.pdv_id)
"""


def _addressed(spark, sf_dir):
    """Points with the address cells of their sheet row; every thirteenth lacks a coordinate."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir)).select(
        F.col("row_id").alias("pdv_id"), "logradouro", "numero", "bairro",
        F.when(F.col("bairro").startswith("Centro"), F.col("pdv_endereco_completo")).otherwise(F.lit("")).alias("endereco_completo"))
    there = F.col("pdv_id") % 13 != 0
    p = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "input_id", "zona", "cnpj", "cidade", "uf",
                                        F.when(there, F.col("lat")).alias("lat"), F.when(there, F.col("lon")).alias("lon"))
    return p.join(c, "pdv_id")


@register("layer_points", sql=ADDRESS_SQL + f"""
select pdv_id, cnpj, coalesce(lat, 0.0) as lat, coalesce(lon, 0.0) as lon, cidade, uf, endereco
from addressed where tenant_id = {TENANT} and lower(uf) = 'mt'
""")
def q_layer_points(spark, sf_dir):
    """X-10 / P-29: points of a tenant and state with their address."""
    return L.point_layer(_addressed(spark, sf_dir), TENANT, uf="mt")


@register("layer_clusters", sql=ADDRESS_SQL + """,
sectors as (select tenant_id, zona, round(avg(lat), 6) as centro_lat, round(avg(lon), 6) as centro_lon from points group by tenant_id, zona)
select a.pdv_id, 'S' || a.zona as cluster_label, s.centro_lat, s.centro_lon,
       case when a.pdv_id % 4 = 0 then 1.5 else a.lat end as lat, case when a.pdv_id % 4 = 0 then 2.5 else a.lon end as lon,
       case when a.pdv_id % 4 = 1 then 'Membro' else a.cidade end as cidade, a.uf, a.cnpj,
       case when a.pdv_id % 5 = 0 then 'Rua do membro' else a.endereco end as endereco
from addressed a join sectors s on s.tenant_id = a.tenant_id and s.zona = a.zona where a.pdv_id % 7 <> 0
""")
def q_layer_clusters(spark, sf_dir):
    """X-10 / J-05: points with their sector and its centre; what the membership stored wins."""
    p = _addressed(spark, sf_dir)
    i = F.col("pdv_id")
    m = p.filter(i % 7 != 0).select(
        "tenant_id", "zona", "pdv_id", F.when(i % 4 == 0, F.lit(1.5)).alias("lat"), F.when(i % 4 == 0, F.lit(2.5)).alias("lon"),
        F.when(i % 4 == 1, F.lit("Membro")).alias("cidade"), F.lit(None).cast("string").alias("uf"), F.lit(None).cast("string").alias("cnpj"),
        F.when(i % 5 == 0, F.lit("Rua do membro")).otherwise(F.lit("")).alias("endereco_completo"))
    s = fx.points(spark, sf_dir).groupBy("tenant_id", "zona").agg(
        F.round(F.avg("lat"), 6).alias("centro_lat"), F.round(F.avg("lon"), 6).alias("centro_lon"))
    s = s.withColumn("cluster_label", F.concat(F.lit("S"), F.col("zona").cast("string")))
    return L.cluster_layer(m, s, p.drop("tenant_id", "zona", "input_id"), ["tenant_id", "zona"])


@register("layer_noise", sql=fx.with_fixtures("points") + f"""
select cast(floor(lat / {NOISE_CELL}) as bigint) as gy, cast(floor(lon / {NOISE_CELL}) as bigint) as gx, count(*) as n,
       (floor(lat / {NOISE_CELL}) + 0.5) * {NOISE_CELL} as cell_lat, (floor(lon / {NOISE_CELL}) + 0.5) * {NOISE_CELL} as cell_lon,
       greatest(cast(3.0 as double), least(cast(12.0 as double), cast(3.0 as double) + cast(0.6 as double) * count(*))) as tamanho
from points where pdv_id % 7 = 0 and lat <> 0 and lon <> 0 group by 1, 2, 4, 5
""")
def q_layer_noise(spark, sf_dir):
    """X-10: density of the points that no sector took."""
    m = fx.points(spark, sf_dir).select("lat", "lon", F.when(F.col("pdv_id") % 7 != 0, F.col("zona")).alias("cluster_id"))
    return L.noise_layer(m, NOISE_CELL)


# Every third cached leg has a stored way over a point beside its middle; every fourteenth of them an empty one.
PATH_SQL = _cost_sql().rstrip() + """,
ways as (
  select *, c_fonte = 'cache' and n % 3 = 0 and n % 14 <> 0 as stored from (
    select l.*, case when abs(a_lat - b_lat) < 1e-5 and abs(a_lon - b_lon) < 1e-5 then 'mesmo' when c.ckm is not null then 'cache' else 'reta' end as c_fonte,
           cast(c.ckm as bigint) as n, d.lat as d_lat, d.lon as d_lon
    from legs l join dep d on d.cluster_id = l.cluster_id left join cache c
      on c.k1 = round(l.a_lat, 6) and c.k2 = round(l.a_lon, 6) and c.k3 = round(l.b_lat, 6) and c.k4 = round(l.b_lon, 6)) x),
counted as (select *, sum(case when c_fonte <> 'mesmo' then 1 else 0 end) over (partition by cluster_id, subcluster_seq) as moved,
                   max(leg) over (partition by cluster_id, subcluster_seq) as last_leg from ways),
vertices as (
  select cluster_id, subcluster_seq, leg, 0 as i, case when stored then a_lat + 0.25 else a_lat end as lat, a_lon as lon, d_lat, d_lon, last_leg, moved
  from counted where c_fonte <> 'mesmo' or moved = 0
  union all
  select cluster_id, subcluster_seq, leg, 1, case when stored then (a_lat + b_lat) / 2.0 else b_lat end, case when stored then a_lon else b_lon end, d_lat, d_lon, last_leg, moved
  from counted where c_fonte <> 'mesmo'
  union all
  select cluster_id, subcluster_seq, leg, 2, b_lat, b_lon, d_lat, d_lon, last_leg, moved from counted where stored),
edges as (
  select *, row_number() over (partition by cluster_id, subcluster_seq order by leg, i) as rf,
         row_number() over (partition by cluster_id, subcluster_seq order by leg desc, i desc) as rl from vertices),
closed as (
  select cluster_id, subcluster_seq, leg, i, lat, lon from vertices
  union all
  select cluster_id, subcluster_seq, 0, 0, d_lat, d_lon from edges
  where rf = 1 and moved > 0 and (abs(lat - d_lat) > 1e-4 or abs(lon - d_lon) > 1e-4)
  union all
  select cluster_id, subcluster_seq, last_leg + 1, 0, d_lat, d_lon from edges
  where rl = 1 and (moved = 0 or abs(lat - d_lat) > 1e-4 or abs(lon - d_lon) > 1e-4)),
paths as (select cluster_id, subcluster_seq, row_number() over (partition by cluster_id, subcluster_seq order by leg, i) as ponto, lat, lon from closed)
"""


def _ordered(stops):
    return ranked(stops, ROUTE, ["lon", "lat", "pdv_id"], out="sequencia_ordem")


def _paths(spark, sf_dir):
    pts = fx.points(spark, sf_dir)
    seq = _ordered(fx.route_stops(pts))
    n = F.col("distancia_km").cast("long")
    alat, alon, blat, blon = (F.col(c) for c in ("origem_lat", "origem_lon", "destino_lat", "destino_lon"))

    def at(lat, lon):
        return F.struct(lat.alias("lat"), lon.alias("lon"))
    way = F.array(at(alat + 0.25, alon), at((alat + blat) / 2.0, alon), at(blat, blon))
    cache = fx.route_cache(pts).withColumn("rota_coord", F.when(n % 3 == 0, F.when(n % 14 == 0, F.slice(way, 1, 0)).otherwise(way)))
    dep = _depots(seq)
    costed = R.leg_costs(R.route_legs(seq, dep, ROUTE, ["cluster_id"]), cache, KMH, ALPHA)
    return R.route_paths(costed, dep, ROUTE, ["cluster_id"]), seq


@register("route_paths", sql=PATH_SQL + "select * from paths")
def q_route_paths(spark, sf_dir):
    """R-04: way of every route, begun and ended at the centre, stored ways where the cache has them."""
    return _paths(spark, sf_dir)[0]


@register("layer_routes", sql=PATH_SQL + """,
cen as (select cluster_id, subcluster_seq, round(avg(lat), 6) as centro_lat, round(avg(lon), 6) as centro_lon from route_stops group by 1, 2),
both_kinds as (
  select cluster_id, subcluster_seq, 'caminho' as camada, ponto as ordem, cast(null as bigint) as pdv_id, lat, lon from paths
  union all
  select cluster_id, subcluster_seq, 'parada', so, cast(pdv_id as bigint), lat, lon from seq)
select b.*, c.centro_lat, c.centro_lon from both_kinds b join cen c on c.cluster_id = b.cluster_id and c.subcluster_seq = b.subcluster_seq
""")
def q_layer_routes(spark, sf_dir):
    """X-10: vertices and stops of every route with the route's centre."""
    paths, seq = _paths(spark, sf_dir)
    cen = seq.groupBy(*ROUTE).agg(F.round(F.avg("lat"), 6).alias("centro_lat"), F.round(F.avg("lon"), 6).alias("centro_lon"))
    return L.route_layer(paths, seq, cen, ROUTE)


@register("layer_vendors", sql=ASSIGN_SQL + """,
vb as (
  select vendedor_id, count(*) as total_rotas, cast(sum(n_pdvs) as bigint) as total_pdvs,
         round(case when sum(n_pdvs) > 0 then sum(centro_lat * n_pdvs) / sum(n_pdvs) else avg(centro_lat) end, 6) as base_lat,
         round(case when sum(n_pdvs) > 0 then sum(centro_lon * n_pdvs) / sum(n_pdvs) else avg(centro_lon) end, 6) as base_lon
  from assigned group by vendedor_id)
select s.pdv_id, a.vendedor_id, p.lat, p.lon, p.cidade, p.uf, vb.base_lat, vb.base_lon, vb.total_rotas, vb.total_pdvs
from route_stops s join assigned a on a.cluster_id = s.cluster_id and a.subcluster_seq = s.subcluster_seq
join points p on p.pdv_id = s.pdv_id join vb on vb.vendedor_id = a.vendedor_id where p.pdv_id % 13 <> 0
""")
def q_layer_vendors(spark, sf_dir):
    """X-10: points of every vendor beside the vendor's base; points without a coordinate are left out."""
    a, stops = _assigned(spark, sf_dir)
    p = fx.points(spark, sf_dir)
    pv = A.vendor_points(a, stops, ROUTE)
    base = A.vendor_base(a, pv.join(p.select("pdv_id", "cidade"), "pdv_id"))
    p = p.withColumn("lat", F.when(F.col("pdv_id") % 13 != 0, F.col("lat")))
    return L.vendor_layer(pv, p, base)


BAIRRO_SQL = "case when centro_id % 3 = 0 then '' else 'Bairro ' || centro_id end"


def _kept_ceps(spark, sf_dir):
    a = _cep_assign(spark, sf_dir).filter("mantido")
    c = F.col("centro_id")
    return a.select(c.alias("cluster_id"), "cep", "clientes_total", "clientes_target", "cluster_lat", "cluster_lon", "dist_km", "tempo_min", "centro_nome",
                    (c * 1000003).cast("string").alias("centro_cnpj"),
                    F.when(c % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Bairro "), c.cast("string"))).alias("cluster_bairro"))


@register("layer_ceps", sql=CEP_ASSIGN_SQL + f"""
select centro_id as cluster_id, cep, clientes_total, clientes_target, cluster_lat as lat, cluster_lon as lon,
       coalesce(nullif({BAIRRO_SQL}, ''), 'N/D') as bairro, round(dist_km, 6) as dist_km, round(tempo_min, 6) as tempo_min,
       greatest(cast(3.0 as double), least(cast(12.0 as double), cast(3.0 as double) + cast(0.6 as double)
         * case when clientes_target > 0 then clientes_target else clientes_total end)) as tamanho,
       cast(sum(clientes_total) over (partition by centro_id) as bigint) as cluster_total,
       cast(sum(clientes_target) over (partition by centro_id) as bigint) as cluster_target
from assigned where mantido
""")
def q_layer_ceps(spark, sf_dir):
    """X-10: a bubble a CEP, sized by its clients, with the totals of its cluster."""
    return (L.cep_bubble_layer(_kept_ceps(spark, sf_dir))
            .withColumn("dist_km", F.round("dist_km", 6)).withColumn("tempo_min", F.round("tempo_min", 6)))


# ------------------------------------------------------------------ X-07, X-09 sheets
@register("cluster_route_report", sql=_cost_sql() + f""",
agg as (
  select cluster_id, cast(sum(n_pdvs) as bigint) as qtd_pdvs,
         floor((2 * sum(cast(round(tempo_total_min * 10, 0) as bigint)) * 100 + count(*)) / cast(2 * count(*) as double)) / 1000.0 as tempo_medio_min,
         max(tempo_total_min) as tempo_max_min, sum(cast(round(tempo_total_min * 10, 0) as bigint)) / 10.0 as tempo_total_min,
         floor((2 * sum(cast(round(dist_total_km * 100, 0) as bigint)) * 10 + count(*)) / cast(2 * count(*) as double)) / 1000.0 as dist_media_km,
         max(dist_total_km) as dist_max_km, sum(cast(round(dist_total_km * 100, 0) as bigint)) / 100.0 as dist_total_km
  from routes group by cluster_id),
sales as (select zona as cluster_id, sum(cast(round(coalesce(pdv_vendas, 0) * 100, 0) as bigint)) / 100.0 as valor_total_vendas from points group by zona)
select a.*, s.valor_total_vendas, d.lat as centro_lat, d.lon as centro_lon
from agg a join sales s on s.cluster_id = a.cluster_id join dep d on d.cluster_id = a.cluster_id
""")
def q_cluster_route_report(spark, sf_dir):
    """X-07: per cluster mean, largest and total minutes and km, sales and centre."""
    stops = fx.route_stops(fx.points(spark, sf_dir))
    return reports.cluster_route_report(_routes(spark, sf_dir), stops, fx.points(spark, sf_dir), _depots(stops), ["cluster_id"])


@register("cep_cluster_report", sql=CEP_ASSIGN_SQL + rf"""
select centro_id as cluster_id, min(centro_nome) as centro_nome,
       regexp_replace(lpad(cast(centro_id * 1000003 as varchar), 14, '0'), '^(\d{{2}})(\d{{3}})(\d{{3}})(\d{{4}})(\d{{2}})$', '\1.\2.\3/\4-\5') as centro_cnpj,
       coalesce(min(nullif({BAIRRO_SQL}, '')), 'Não identificado') as cluster_bairro,
       replace(printf('%.6f', round(avg(cluster_lat), 6)), '.', ',') as cluster_lat, replace(printf('%.6f', round(avg(cluster_lon), 6)), '.', ',') as cluster_lon,
       count(distinct cep) as qtd_ceps, cast(sum(clientes_total) as bigint) as clientes_total, cast(sum(clientes_target) as bigint) as clientes_target,
       round(avg(dist_km), 2) as distancia_media_km, round(avg(tempo_min), 2) as tempo_medio_min,
       round(max(dist_km), 2) as distancia_max_km, round(max(tempo_min), 2) as tempo_max_min
from assigned where mantido group by centro_id
""")
def q_cep_cluster_report(spark, sf_dir):
    """X-09 / P-23: the sheet of CEP clusters with written CNPJ and decimal commas."""
    return reports.cep_cluster_report(_kept_ceps(spark, sf_dir))


# ------------------------------------------------------------------ X-11, A-09 histories
FROM, TO, TEXT = "2024-01-01", "2024-12-31", "CARGA JOB-1"
PERIOD_SQL = f"criado_em >= timestamp '{FROM}' and criado_em < timestamp '{TO}' + interval 1 day"

JOBS_SQL = fx.with_fixtures("points", "job_log").rstrip() + """,
jobs as (select *, 'Carga ' || job_id as descricao, input_id as clusterization_id from job_log),
uploads as (select 'input-' || (tenant_id + 5 * (pdv_id % 8)) as input_id, tenant_id, pdv_id, uf, cidade from points),
zones as (select tenant_id, zona, count(*) as n_pdvs from points group by 1, 2),
sectors as (select j.id as run_id, z.n_pdvs from jobs j join zones z on z.tenant_id = j.tenant_id where z.zona % 3 < j.id % 4)
"""


def _jobs(spark, sf_dir):
    return (fx.job_log(spark, sf_dir).withColumn("descricao", F.concat(F.lit("Carga "), F.col("job_id")))
            .withColumn("clusterization_id", F.col("input_id")))


def _runs_sectors(spark, sf_dir):
    """Every job is a run; its sectors are some of the zones of its tenant."""
    runs = _jobs(spark, sf_dir).select(F.col("id").alias("run_id"), "tenant_id", "clusterization_id", "status", "criado_em")
    zones = fx.points(spark, sf_dir).groupBy("tenant_id", "zona").agg(F.count(F.lit(1)).alias("n_pdvs"))
    sectors = runs.select("run_id", "tenant_id").join(zones, "tenant_id").filter(F.col("zona") % 3 < F.col("run_id") % 4)
    return runs, sectors.select("run_id", "n_pdvs")


@register("clustering_inputs", sql=JOBS_SQL + f""",
done as (select * from jobs where tenant_id = {TENANT} and status = 'done' and {PERIOD_SQL} and lower(descricao) like '%{TEXT.lower()}%')
select d.input_id, d.criado_em, d.descricao, min(u.uf) as uf, min(u.cidade) as cidade, count(u.pdv_id) as total_pdvs,
       (select count(distinct input_id) from done) as total
from done d left join uploads u on u.tenant_id = d.tenant_id and u.input_id = d.input_id
group by d.input_id, d.criado_em, d.descricao order by d.criado_em desc, d.input_id, d.descricao limit 25 offset 5
""")
def q_clustering_inputs(spark, sf_dir):
    """X-11: uploads ready for clustering, filtered, one page with the number of inputs."""
    p = fx.points(spark, sf_dir)
    uploads = p.select("tenant_id", "uf", "cidade", F.concat(F.lit("input-"), (F.col("tenant_id") + 5 * (F.col("pdv_id") % 8)).cast("string")).alias("input_id"))
    return reports.clustering_inputs(_jobs(spark, sf_dir), uploads, TENANT, FROM, TO, TEXT, limit=25, offset=5)


SUMMARY_SQL = """,
last_run as (select * from (select *, row_number() over (partition by clusterization_id order by criado_em desc, id desc) as rn
                            from jobs where tenant_id = {tenant} {cond}) t where rn = 1),
resumo as (select r.id as run_id, r.clusterization_id, r.criado_em, r.status, count(s.run_id) as qtd_clusters, cast(coalesce(sum(s.n_pdvs), 0) as bigint) as pdvs_total
           from last_run r left join sectors s on s.run_id = r.id group by 1, 2, 3, 4)
"""


@register("clustering_history", sql=JOBS_SQL.rstrip() + SUMMARY_SQL.format(tenant=TENANT, cond="") + f""",
f as (select * from jobs where tenant_id = {TENANT} and {PERIOD_SQL} and lower(descricao) like '%{TEXT.lower()}%')
select f.id, f.criado_em, f.clusterization_id, f.descricao, f.status, coalesce(r.qtd_clusters, 0) as qtd_clusters,
       coalesce(r.pdvs_total, 0) as pdvs_total, (select count(*) from f) as total
from f left join resumo r on r.clusterization_id = f.clusterization_id order by f.criado_em desc, f.id desc limit 25 offset 5
""")
def q_clustering_history(spark, sf_dir):
    """X-11 / W-01: clustering jobs with the sectors and points of the newest run."""
    return reports.clustering_history(_jobs(spark, sf_dir), *_runs_sectors(spark, sf_dir), TENANT, FROM, TO, TEXT, limit=25, offset=5)


@register("finished_clusterings", sql=JOBS_SQL.rstrip() + SUMMARY_SQL.format(tenant=TENANT, cond="and status = 'done'") + """
select clusterization_id, run_id, criado_em, status, qtd_clusters, pdvs_total from resumo order by criado_em desc, run_id desc limit 50
""")
def q_finished_clusterings(spark, sf_dir):
    """X-11 / W-01: newest finished run of each clustering with its sectors and points."""
    return reports.finished_clusterings(*_runs_sectors(spark, sf_dir), TENANT)


@register("routing_runs", sql=_cost_sql() + f""",
per_cluster as (
  select 'rot-' || (cluster_id % 10) as routing_id, cluster_id % 5 as tenant_id, cluster_id, count(*) as q, sum(n_pdvs) as p,
         sum(cast(round(dist_total_km * 100, 0) as bigint)) as ckm, sum(cast(round(tempo_total_min * 10, 0) as bigint)) as dmin,
         date '2024-01-01' + cast(cluster_id as int) as criado_em
  from routes group by cluster_id)
select routing_id, max(criado_em) as criado_em, count(distinct cluster_id) as clusters_processados, cast(sum(q) as bigint) as total_rotas,
       cast(sum(p) as bigint) as total_pdvs, sum(ckm) / 100.0 as total_km, sum(dmin) / 10.0 as total_min,
       case when routing_id = 'rot-2' then 'Ciclo rot-2' else '' end as descricao
from per_cluster where tenant_id = {TENANT} group by routing_id order by 2 desc, 1 desc limit 200
""")
def q_routing_runs(spark, sf_dir):
    """A-09 / X-11: routings of a tenant with last date, clusters and sums."""
    c = F.col("cluster_id")
    s = routing_summary(_routes(spark, sf_dir), ["cluster_id"]).select(
        F.concat(F.lit("rot-"), (c % 10).cast("string")).alias("routing_id"), (c % 5).alias("tenant_id"), "cluster_id", "qtd_subclusters", "qtd_pdvs",
        "dist_total_km", "tempo_total_min", F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int")).alias("criado_em"))
    jobs = (s.filter(F.col("routing_id") == "rot-2").select("tenant_id", "routing_id").distinct()
            .withColumn("descricao", F.concat(F.lit("Ciclo "), F.col("routing_id"))))
    return reports.routing_runs(s, jobs, TENANT)


# ------------------------------------------------------------------ K-14 snapshots
@register("snapshot_list", sql=fx.with_fixtures("job_log") + f"""
select 'snap-' || id as snapshot_id, job_id as nome, 'Ciclo ' || input_id as descricao, criado_em, 'auto,' || status as tags,
       case id % 3 when 0 then 'SP' when 1 then 'GO' else 'MT' end as uf, 'CIDADE ' || (id % 4) as cidade
from job_log where tenant_id = {TENANT} and id % 3 = 1 and id % 4 = 2
""")
def q_snapshot_list(spark, sf_dir):
    """K-14 / F-01: snapshots of a tenant in one state and city, newest first."""
    i = F.col("id")
    h = fx.job_log(spark, sf_dir).select(
        "tenant_id", F.concat(F.lit("snap-"), i.cast("string")).alias("snapshot_id"), F.col("job_id").alias("nome"),
        F.concat(F.lit("Ciclo "), F.col("input_id")).alias("descricao"), "criado_em", F.array(F.lit("auto"), F.col("status")).alias("tags"),
        F.when(i % 3 == 0, "SP").when(i % 3 == 1, "GO").otherwise("MT").alias("uf"), F.concat(F.lit("CIDADE "), (i % 4).cast("string")).alias("cidade"))
    return T.list_snapshots(h, TENANT, "GO", "CIDADE 2").withColumn("tags", F.array_join("tags", ","))


@register("snapshot_restore", sql=ASSIGN_SQL + f"""
select cluster_id % 5 as tenant_id, cluster_id, subcluster_seq, n_pdvs, dist_total_km,
       case when cluster_id % 5 = {TENANT} then vendedor_id else vendedor_id + 100 end as vendedor_id
from assigned where cluster_id % 5 <> {TENANT} or subcluster_seq % 2 = 1
""")
def q_snapshot_restore(spark, sf_dir):
    """K-14: the newest snapshot of a name copied back over the tenant's live routes; the rest stays."""
    a, _ = _assigned(spark, sf_dir)
    a = a.select((F.col("cluster_id") % 5).alias("tenant_id"), *ROUTE, "n_pdvs", "dist_total_km", "vendedor_id")
    old = T.snapshot(a, F.concat(F.lit("snap-a-"), F.col("tenant_id").cast("string")), "mensal", ["auto"])
    new = T.snapshot(a.filter(F.col("subcluster_seq") % 2 == 1), F.concat(F.lit("snap-b-"), F.col("tenant_id").cast("string")), "mensal", ["auto"])
    frozen = old.withColumn("criado_em", F.lit("2024-01-01").cast("date")).unionByName(new.withColumn("criado_em", F.lit("2024-02-01").cast("date")))
    heads = frozen.select("tenant_id", "snapshot_id", "nome", "criado_em").distinct()
    live = a.withColumn("vendedor_id", F.col("vendedor_id") + 100)
    return T.restore_snapshot(live, frozen, heads, TENANT, "mensal")
