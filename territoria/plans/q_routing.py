"""Registered routing queries: route counts, stop order, leg costs, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_sql
from ..operators import routing as R
from ..sources import fixtures as fx
from .registry import register

DIAS, FREQ = 21, 2
KMH, ALPHA, SERVICE = 35.0, 1.3, 10.0
ROUTE = ["cluster_id", "subcluster_seq"]


@register("route_counts", sql=fx.with_fixtures("points") + f"""
select zona, cast(count(*) as bigint) as n,
       cast(least(greatest(1, ceil(count(*) * {float(FREQ)} / {float(DIAS)})), count(*)) as int) as k_proporcional,
       cast(least({max(1, int(DIAS * FREQ))}, count(*)) as int) as k_fixo,
       cast(least({max(1, DIAS // FREQ)}, count(*)) as int) as k_capacidade
from points group by zona
""")
def q_route_counts(spark, sf_dir):
    """R-01: daily routes per cluster in the three modes."""
    g = fx.points(spark, sf_dir).groupBy("zona").agg(F.count(F.lit(1)).alias("n"))
    return g.select("zona", "n", R.route_count("n", DIAS, FREQ).alias("k_proporcional"),
                    R.route_count("n", DIAS, FREQ, "fixo").alias("k_fixo"),
                    R.route_count("n", DIAS, FREQ, "capacidade").alias("k_capacidade"))


def _depots(stops):
    return stops.groupBy("cluster_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


DEP_SQL = "dep as (select cluster_id, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from route_stops group by cluster_id)"


def _nn_sql() -> str:
    d = haversine_sql("t.cur_lat", "t.cur_lon", "s.lat", "s.lon")
    return fx.with_fixtures("route_stops").replace("with ", "with recursive ", 1).rstrip() + f""",
{DEP_SQL},
tour as (
  select r.cluster_id, r.subcluster_seq, 0 as step, cast(null as bigint) as pdv_id,
         d.lat as cur_lat, d.lon as cur_lon, cast([] as bigint[]) as visited
  from (select distinct cluster_id, subcluster_seq from route_stops) r join dep d on d.cluster_id = r.cluster_id
  union all
  select cluster_id, subcluster_seq, step, pdv_id, cur_lat, cur_lon, visited from (
    select t.cluster_id, t.subcluster_seq, t.step + 1 as step, s.pdv_id, s.lat as cur_lat, s.lon as cur_lon,
           list_append(t.visited, s.pdv_id) as visited,
           row_number() over (partition by t.cluster_id, t.subcluster_seq order by round({d}, 9), s.pdv_id) as rn
    from tour t join route_stops s on s.cluster_id = t.cluster_id and s.subcluster_seq = t.subcluster_seq
    where not list_contains(t.visited, s.pdv_id)) x
  where rn = 1)
select cluster_id, subcluster_seq, pdv_id, cast(step as int) as sequencia_ordem from tour where step > 0
"""


@register("route_sequence", sql=_nn_sql())
def q_route_sequence(spark, sf_dir):
    """R-02: nearest-neighbour stop order of every route from its cluster depot (all routes in parallel)."""
    stops = fx.route_stops(fx.points(spark, sf_dir))
    return R.sequence_stops(stops, _depots(stops), ROUTE, ["cluster_id"])


def _cost_sql() -> str:
    hv = haversine_sql("a_lat", "a_lon", "b_lat", "b_lon")
    return fx.with_fixtures("route_stops", "route_cache").rstrip() + f""",
{DEP_SQL},
seq as (select *, row_number() over (partition by cluster_id, subcluster_seq order by lon, lat, pdv_id) as so,
               count(*) over (partition by cluster_id, subcluster_seq) as n_r
        from route_stops),
legs as (
  select s.cluster_id, s.subcluster_seq, s.so as leg,
         coalesce(lag(s.lat) over w, d.lat) as a_lat, coalesce(lag(s.lon) over w, d.lon) as a_lon,
         s.lat as b_lat, s.lon as b_lon
  from seq s join dep d on d.cluster_id = s.cluster_id
  window w as (partition by s.cluster_id, s.subcluster_seq order by s.so)
  union all
  select s.cluster_id, s.subcluster_seq, s.so + 1, s.lat, s.lon, d.lat, d.lon
  from seq s join dep d on d.cluster_id = s.cluster_id where s.so = s.n_r),
cache as (
  select round(origem_lat, 6) as k1, round(origem_lon, 6) as k2, round(destino_lat, 6) as k3, round(destino_lon, 6) as k4,
         min(struct_pack(a := distancia_km, b := tempo_min)).a as ckm,
         min(struct_pack(a := distancia_km, b := tempo_min)).b as cmin
  from route_cache group by 1, 2, 3, 4),
costed as (
  select l.*,
         round(case when abs(a_lat - b_lat) < 1e-5 and abs(a_lon - b_lon) < 1e-5 then 0.0
                    when c.ckm is not null then c.ckm else {hv} * {ALPHA} end, 3) as km,
         round(case when abs(a_lat - b_lat) < 1e-5 and abs(a_lon - b_lon) < 1e-5 then 0.0
                    when c.cmin is not null then c.cmin
                    else {hv} * {ALPHA} / {KMH} * 60.0 end, 1) as min
  from legs l left join cache c
    on c.k1 = round(l.a_lat, 6) and c.k2 = round(l.a_lon, 6) and c.k3 = round(l.b_lat, 6) and c.k4 = round(l.b_lon, 6)),
totals as (
  select cluster_id, subcluster_seq, count(*) - 1 as n_pdvs,
         sum(cast(round(km * 1000, 0) as bigint)) as mkm, sum(cast(round(min * 10, 0) as bigint)) as dmin
  from costed group by cluster_id, subcluster_seq),
routes as (
  select cluster_id, subcluster_seq, n_pdvs,
         floor((mkm + 5) / 10.0) / 100.0 as dist_total_km,
         (dmin + n_pdvs * {int(SERVICE * 10)}) / 10.0 as tempo_total_min
  from totals)
"""


def _routes(spark, sf_dir):
    stops = fx.route_stops(fx.points(spark, sf_dir))
    w = Window.partitionBy(*ROUTE).orderBy("lon", "lat", "pdv_id")
    seq = stops.withColumn("sequencia_ordem", F.row_number().over(w))
    legs = R.route_legs(seq, _depots(stops), ROUTE, ["cluster_id"])
    costed = R.leg_costs(legs, fx.route_cache(fx.points(spark, sf_dir)), KMH, ALPHA)
    return R.route_totals(costed, ROUTE, SERVICE)


@register("route_cost", sql=_cost_sql() + "select * from routes")
def q_route_cost(spark, sf_dir):
    """R-04 / J-13 / W-08: legs depot -> stops -> depot, cached leg cost else haversine x alpha, route totals."""
    return _routes(spark, sf_dir)


@register("routing_summary", sql=_cost_sql() + """
select cluster_id, count(*) as qtd_subclusters, cast(sum(n_pdvs) as bigint) as qtd_pdvs,
       sum(cast(round(dist_total_km * 100, 0) as bigint)) / 100.0 as dist_total_km,
       sum(cast(round(tempo_total_min * 10, 0) as bigint)) / 10.0 as tempo_total_min,
       floor((2 * sum(cast(round(dist_total_km * 100, 0) as bigint)) * 10 + count(*)) / cast(2 * count(*) as double)) / 1000.0 as dist_media_km,
       floor((2 * sum(cast(round(tempo_total_min * 10, 0) as bigint)) * 100 + count(*)) / cast(2 * count(*) as double)) / 1000.0 as tempo_medio_min,
       sum(cast(round(dist_total_km * 100, 0) as bigint)) / 100.0 as dist_total_mes_km,
       sum(cast(round(tempo_total_min * 10, 0) as bigint)) / 10.0 as tempo_total_mes_min
from routes group by cluster_id
""")
def q_routing_summary(spark, sf_dir):
    """A-06 / X-07: per cluster totals and per-route means."""
    return R.routing_summary(_routes(spark, sf_dir), ["cluster_id"])


def _zone_points(spark, sf_dir):
    p = fx.points(spark, sf_dir).select("pdv_id", F.col("zona").alias("cluster_id"), "lat", "lon")
    dep = p.groupBy("cluster_id").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))
    return p, dep


@register("plan_routing")
def q_plan_routing(spark, sf_dir):
    """R-06 / R-08 / R-03: each zone cut into ceil(n*freq/dias) daily routes, stops ordered
    (nearest neighbour + 2-opt) from the zone depot, legs costed through the leg cache."""
    p, dep = _zone_points(spark, sf_dir)
    totals, _ = R.plan_routes(p, dep, ["cluster_id"], DIAS, FREQ, KMH, SERVICE, ALPHA,
                              cache=fx.route_cache(fx.points(spark, sf_dir)), improve=True)
    return totals


@register("routes_until_feasible")
def q_routes_until_feasible(spark, sf_dir):
    """R-07: per zone, the smallest number of routes whose every route fits 8 hours and 250 km."""
    p, dep = _zone_points(spark, sf_dir)
    totals, _ = R.split_until_feasible(p, dep, ["cluster_id"], 480.0, 250.0, KMH, SERVICE, ALPHA)
    return totals


@register("multi_stop_cost", sql=fx.with_fixtures("route_stops") + f""",
seq as (select *, row_number() over (partition by cluster_id, subcluster_seq order by lon, lat, pdv_id) as so from route_stops),
legs as (select cluster_id, subcluster_seq, lag(lat) over w as a_lat, lag(lon) over w as a_lon, lat as b_lat, lon as b_lon
         from seq window w as (partition by cluster_id, subcluster_seq order by so)),
c as (select cluster_id, subcluster_seq,
             sum(round(case when abs(a_lat - b_lat) < 1e-5 and abs(a_lon - b_lon) < 1e-5 then 0.0
                            else {haversine_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} * {ALPHA} end, 3)) as km,
             sum(round(case when abs(a_lat - b_lat) < 1e-5 and abs(a_lon - b_lon) < 1e-5 then 0.0
                            else {haversine_sql('a_lat', 'a_lon', 'b_lat', 'b_lon')} * {ALPHA} / {KMH} * 60.0 end, 1)) as min
      from legs where a_lat is not null group by 1, 2),
n as (select cluster_id, subcluster_seq, count(*) as n from route_stops group by 1, 2)
select n.cluster_id, n.subcluster_seq, case when n.n < 2 then 0.0 else round(c.km, 3) end as distancia_km,
       case when n.n < 2 then 10.0 else round(c.min, 1) end as tempo_min
from n left join c on c.cluster_id = n.cluster_id and c.subcluster_seq = n.subcluster_seq
""")
def q_multi_stop_cost(spark, sf_dir):
    """R-05: route cost over the stops alone (no depot); short lists cost 0 km and 10 minutes."""
    stops = fx.route_stops(fx.points(spark, sf_dir))
    w = Window.partitionBy(*ROUTE).orderBy("lon", "lat", "pdv_id")
    seq = stops.withColumn("so", F.row_number().over(w))
    return R.multi_stop_cost(seq, ROUTE, "so", None, KMH, ALPHA).select(*ROUTE, "distancia_km", "tempo_min")


@register("sector_metric_rollup", sql=_cost_sql() + """,
sub as (select cluster_id, count(*) as n,
               floor((2 * sum(cast(round(tempo_total_min * 10, 0) as bigint)) * 100 + count(*)) / (2.0 * count(*))) / 1000.0 as tm,
               max(tempo_total_min) as tx,
               floor((2 * sum(cast(round(dist_total_km * 100, 0) as bigint)) * 10 + count(*)) / (2.0 * count(*))) / 1000.0 as dm,
               max(dist_total_km) as dx
        from routes where cluster_id % 3 <> 0 group by cluster_id),
stored as (select cluster_id, count(*) * 1.5 as tm0, count(*) * 2.5 as tx0, count(*) * 0.5 as dm0,
                  count(*) * 0.75 as dx0 from route_stops group by cluster_id)
select s.cluster_id,
       round(coalesce(sub.tm, s.tm0), 3) as tempo_medio_min, round(coalesce(sub.tx, s.tx0), 3) as tempo_max_min,
       round(coalesce(sub.dm, s.dm0), 3) as distancia_media_km, round(coalesce(sub.dx, s.dx0), 3) as dist_max_km,
       5 as n_metricas
from stored s left join sub on sub.cluster_id = s.cluster_id
""")
def q_sector_metric_rollup(spark, sf_dir):
    """A-19: sector metrics rolled up from its routes when it has any (zones divisible by 3
    keep only their stored metrics), stored metric map merged with the new values."""
    from ..operators.aggregates import rollup_sector_metrics
    routes = _routes(spark, sf_dir)
    subs = (routes.filter(F.col("cluster_id") % 3 != 0)
            .groupBy("cluster_id").agg(F.collect_list(F.struct("tempo_total_min", "dist_total_km")).alias("subclusters")))
    stops = fx.route_stops(fx.points(spark, sf_dir))
    stored = stops.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "cluster_id", F.create_map(
            F.lit("tempo_medio_min"), F.col("_n") * 1.5, F.lit("tempo_max_min"), F.col("_n") * 2.5,
            F.lit("distancia_media_km"), F.col("_n") * 0.5, F.lit("dist_max_km"), F.col("_n") * 0.75,
            F.lit("vazio"), F.lit(None).cast("double"), F.lit("raio_p95_km"), F.lit(1.0)).alias("metrics"))
    sec = stored.join(subs, "cluster_id", "left")
    out = rollup_sector_metrics(sec)
    return out.select("cluster_id", "tempo_medio_min", "tempo_max_min", "distancia_media_km", "dist_max_km",
                      "n_metricas")
