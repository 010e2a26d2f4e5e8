"""Registered geocoding and ingest queries (J-01..J-03, A-17, C-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.geo import haversine_sql
from ..operators.geocode import cache_write_back, geocode_cascade, ingest_points
from ..operators.quality import clean_points_raw
from ..session import cut_lineage
from ..sources import dims
from ..sources import fixtures as fx
from . import duck as D
from .q_text import CLEAN_SQL
from .registry import register


def _tiers(spark, sf_dir):
    clean = cut_lineage(clean_points_raw(fx.points_raw(spark, sf_dir)))
    pts = fx.points(spark, sf_dir).select(F.col("pdv_id").alias("row_id"), "lat", "lon")
    j = clean.join(pts, "row_id")
    cache = j.filter(F.col("bairro").startswith("Centro")).select(
        F.col("endereco_cache_key").alias("endereco"), "lat", "lon",
        F.lit("nominatim").alias("origem"))
    rua = text.normalize_full_address(F.col("logradouro")).alias("rua_key")
    gnum = j.filter(F.col("numero") != "").select(rua, "numero", "cidade", "uf",
                                                  (F.col("lat") + F.lit(0.001)).alias("lat"),
                                                  (F.col("lon") + F.lit(0.001)).alias("lon"))
    gst = (j.filter(F.col("cep") != "").select(rua, "cidade", "uf", "lat", "lon")
           .groupBy("rua_key", "cidade", "uf").agg(F.round(F.avg("lat"), 6).alias("lat"),
                                                   F.round(F.avg("lon"), 6).alias("lon")))
    return clean, cache, gnum, gst


def _generic(la: str, lo: str) -> str:
    h1 = haversine_sql(la, lo, "cast(-22.563 as double)", "cast(-47.401 as double)")
    h2 = haversine_sql(la, lo, "cast(-14.235004 as double)", "cast(-51.92528 as double)")
    return (f"coalesce({la} is null or {lo} is null or (abs({la}) < 0.0001 and abs({lo}) < 0.0001) "
            f"or not ({la} between -90.0 and 90.0 and {lo} between -180.0 and 180.0) "
            f"or {h1} < 5.0 or {h2} < 10.0, true)")


TIERS_SQL = CLEAN_SQL.replace("with points_raw as", "with points as (" + fx.POINTS_SQL.strip() + "),\npoints_raw as", 1) + f""",
j as (select c.*, p.lat, p.lon, {D.normalize_full_address('c.logradouro')} as rua_key
      from clean c join points p on p.pdv_id = c.row_id),
cache as (select endereco_cache_key as endereco, lat, lon, 'nominatim' as origem from j where starts_with(bairro, 'Centro')),
gnum as (select rua_key, numero, cidade, uf, lat + 0.001 as lat, lon + 0.001 as lon from j where numero <> ''),
gst as (select rua_key, cidade, uf, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon from j where cep <> ''
        group by rua_key, cidade, uf),
t1 as (select endereco, lat, lon from (select *, row_number() over (partition by endereco order by lat, lon) rn from cache) x where rn = 1),
t2 as (select * from (select *, row_number() over (partition by rua_key, numero, cidade, uf order by lat, lon) rn from gnum) x where rn = 1),
t3 as (select * from (select *, row_number() over (partition by rua_key, cidade, uf order by lat, lon) rn from gst) x where rn = 1),
geo0 as (
  select c.*, t1.lat as l1, t1.lon as o1, t2.lat as l2, t2.lon as o2, t3.lat as l3, t3.lon as o3
  from (select *, {D.normalize_full_address('logradouro')} as rua_key from clean) c
  left join t1 on t1.endereco = c.endereco_cache_key
  left join t2 on t2.rua_key = c.rua_key and t2.numero = c.numero and t2.cidade = c.cidade and t2.uf = c.uf
  left join t3 on t3.rua_key = c.rua_key and t3.cidade = c.cidade and t3.uf = c.uf),
geo as (
  select *,
    case when l1 is not null and not {_generic('l1', 'o1')} then l1
         when l2 is not null and not {_generic('l2', 'o2')} then l2
         when l3 is not null and not {_generic('l3', 'o3')} then l3 end as pdv_lat,
    case when l1 is not null and not {_generic('l1', 'o1')} then o1
         when l2 is not null and not {_generic('l2', 'o2')} then o2
         when l3 is not null and not {_generic('l3', 'o3')} then o3 end as pdv_lon,
    case when l1 is not null and not {_generic('l1', 'o1')} then 'cache'
         when l2 is not null and not {_generic('l2', 'o2')} then 'gazetteer_numero'
         when l3 is not null and not {_generic('l3', 'o3')} then 'gazetteer_rua' else 'falha' end as status_geolocalizacao
  from geo0)
"""


@register("geocode_cascade", sql=TIERS_SQL + """
select row_id, round(pdv_lat, 6) as pdv_lat, round(pdv_lon, 6) as pdv_lon, status_geolocalizacao from geo
""")
def q_geocode_cascade(spark, sf_dir):
    """J-01 / J-02: cache by address key, then street+number gazetteer, then street gazetteer; first hit wins."""
    clean, cache, gnum, gst = _tiers(spark, sf_dir)
    g = geocode_cascade(clean, cache, gnum, gst)
    return g.select("row_id", F.round("pdv_lat", 6).alias("pdv_lat"), F.round("pdv_lon", 6).alias("pdv_lon"),
                    "status_geolocalizacao")


@register("geocode_source_stats", sql=TIERS_SQL + """
select status_geolocalizacao, count(*) as n,
       round(100.0 * count(*) / (select count(*) from geo), 2) as pct,
       round(100.0 * (select count(*) from geo where status_geolocalizacao <> 'falha') / (select count(*) from geo), 2) as taxa_sucesso
from geo group by status_geolocalizacao
""")
def q_geocode_source_stats(spark, sf_dir):
    """A-17: rows per geocode source, share and overall success rate."""
    clean, cache, gnum, gst = _tiers(spark, sf_dir)
    g = geocode_cascade(clean, cache, gnum, gst)
    tot = g.agg(F.count(F.lit(1)).alias("t"), F.sum(F.when(F.col("status_geolocalizacao") != "falha", 1).otherwise(0))
                .alias("ok")).first()
    total, ok = int(tot["t"]), int(tot["ok"] or 0)
    return (g.groupBy("status_geolocalizacao").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.lit(total), 2))
            .withColumn("taxa_sucesso", F.round(F.lit(100.0 * ok) / F.lit(total), 2)))


@register("cache_write_back", sql=TIERS_SQL + """,
fresh0 as (select endereco_cache_key as endereco, pdv_lat as lat, pdv_lon as lon, status_geolocalizacao as origem, row_id
           from geo where status_geolocalizacao not in ('cache', 'falha')),
fresh as (select * from (select *, row_number() over (partition by endereco order by row_id) rn from fresh0) x where rn = 1)
select coalesce(c.endereco, f.endereco) as endereco,
       round(case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.lat else c.lat end, 6) as lat,
       round(case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.lon else c.lon end, 6) as lon,
       case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.origem else c.origem end as origem
from cache c full outer join fresh f on f.endereco = c.endereco
""")
def q_cache_write_back(spark, sf_dir):
    """J-03 / K-02: new geocodes written back into the address cache."""
    clean, cache, gnum, gst = _tiers(spark, sf_dir)
    g = geocode_cascade(clean, cache, gnum, gst)
    out = cache_write_back(cache, g)
    return out.select("endereco", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "origem")


INGEST_SQL = TIERS_SQL + f""",
staged as (
  select *, case
      when concat_ws(', ', case when cnpj is null or cnpj = '' then 'cnpj' end,
                           case when logradouro is null or logradouro = '' then 'logradouro' end,
                           case when cidade is null or cidade = '' then 'cidade' end,
                           case when uf is null or uf = '' then 'uf' end) <> ''
        then concat_ws(', ', case when cnpj is null or cnpj = '' then 'cnpj' end,
                           case when logradouro is null or logradouro = '' then 'logradouro' end,
                           case when cidade is null or cidade = '' then 'cidade' end,
                           case when uf is null or uf = '' then 'uf' end)
      when (numero is null or numero = '') and (cep is null or cep = '') then 'numero' end as m1
  from clean),
cnt as (select cnpj, count(*) as n from staged where m1 is null group by cnpj),
ex as (select distinct cnpj from points where tenant_id = 3),
val as (
  select s.row_id, s.cnpj,
         coalesce(s.m1, case when c.n > 1 then 'CNPJ duplicado no arquivo' end,
                  case when e.cnpj is not null then 'CNPJ duplicado neste input_id' end) as motivo_invalidade
  from staged s left join cnt c on c.cnpj = s.cnpj left join ex e on e.cnpj = s.cnpj),
decisions as (
  select v.row_id, v.cnpj,
         coalesce(v.motivo_invalidade,
           case when g.pdv_lat is null or g.pdv_lon is null or isnan(g.pdv_lat) or isnan(g.pdv_lon) then 'falha_geolocalizacao'
                when b.uf is null then 'uf_invalida'
                when not (g.pdv_lat between b.lat_min and b.lat_max and g.pdv_lon between b.lon_min and b.lon_max)
                  then 'coordenadas_fora_limites'
                else 'ok' end) as motivo
  from val v join geo g on g.row_id = v.row_id left join {dims.STATE_BOUNDS_SQL} b on b.uf = g.uf)
"""


def _ingest(spark, sf_dir):
    clean, cache, gnum, gst = _tiers(spark, sf_dir)
    stored = fx.points(spark, sf_dir).filter(F.col("tenant_id") == 3).select(
        "cnpj", "cidade", "uf", F.col("lat").alias("pdv_lat"), F.col("lon").alias("pdv_lon"))
    return ingest_points(None, stored, cache, gnum, gst, spark, clean=clean)


@register("ingest_decisions", sql=INGEST_SQL + "select row_id, cnpj, motivo from decisions")
def q_ingest_decisions(spark, sf_dir):
    """C-02: clean -> validate -> geocode -> state box: the decision for every sheet row."""
    decision, _ = _ingest(spark, sf_dir)
    return decision


@register("ingest_summary", sql=INGEST_SQL + """
select count(*) as total_processados,
       cast(sum(case when motivo = 'ok' then 1 else 0 end) as bigint) as validos,
       cast(sum(case when motivo <> 'ok' then 1 else 0 end) as bigint) as invalidos,
       (select count(*) from points where tenant_id = 3)
         + cast(sum(case when motivo = 'ok' then 1 else 0 end) as bigint) as total_armazenado
from decisions
""")
def q_ingest_summary(spark, sf_dir):
    """C-02 / K-01 / K-15: the job's history row: processed, valid, invalid and stored-after counts."""
    decision, stored_after = _ingest(spark, sf_dir)
    d = decision.agg(F.count(F.lit(1)).alias("total_processados"),
                     F.sum(F.when(F.col("motivo") == "ok", 1).otherwise(0)).cast("long").alias("validos"),
                     F.sum(F.when(F.col("motivo") != "ok", 1).otherwise(0)).cast("long").alias("invalidos"))
    n = stored_after.count()
    return d.withColumn("total_armazenado", F.lit(n).cast("long"))
