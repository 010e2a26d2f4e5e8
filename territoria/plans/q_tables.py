"""Registered table-maintenance and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import generic_coord
from ..operators import tables as T
from ..operators.quality import clean_points_raw, validate_points
from ..operators.windows import latest_per_key
from ..sources import fixtures as fx
from .q_text import CLEAN_SQL
from .registry import register

PT_COLS = ["pdv_id", "cnpj", "cidade", "pdv_vendas"]


def _target(spark, sf_dir):
    return fx.points(spark, sf_dir).select(*PT_COLS)


def _batch(spark, sf_dir):
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    return c.select(F.col("row_id").alias("pdv_id"), "cnpj", "cidade", "pdv_vendas")


BASE = (CLEAN_SQL.replace("with points_raw as", "with points as (" + fx.POINTS_SQL.strip() + "),\npoints_raw as", 1)
        + """,
target as (select pdv_id, cnpj, cidade, pdv_vendas from points),
batch as (select row_id as pdv_id, cnpj, cidade, pdv_vendas from clean),
first_new as (
  select * from (select *, row_number() over (partition by cnpj order by pdv_id) as rn from batch) t where rn = 1)
""")


@register("insert_ignore_points", sql=BASE + """
select pdv_id, cnpj, cidade, pdv_vendas from target
union all
select f.pdv_id, f.cnpj, f.cidade, f.pdv_vendas from first_new f
where not exists (select 1 from target t where t.cnpj = f.cnpj)
""")
def q_insert_ignore_points(spark, sf_dir):
    """K-01: stored rows win on CNPJ conflict; within the batch the first row wins."""
    return T.insert_ignore(_target(spark, sf_dir), _batch(spark, sf_dir), ["cnpj"], order="pdv_id")


@register("upsert_points_sales", sql=BASE + """
select coalesce(t.pdv_id, f.pdv_id) as pdv_id, coalesce(t.cnpj, f.cnpj) as cnpj,
       case when t.cnpj is null then f.cidade else t.cidade end as cidade,
       case when f.cnpj is not null then f.pdv_vendas else t.pdv_vendas end as pdv_vendas
from target t full outer join first_new f on f.cnpj = t.cnpj
""")
def q_upsert_points_sales(spark, sf_dir):
    """K-03: new CNPJs inserted; existing ones get the batch's sales value."""
    t = _target(spark, sf_dir)
    b = _batch(spark, sf_dir)
    up = T.upsert(t, b, ["cnpj"], ["pdv_vendas"], order="pdv_id")
    # rows only in the batch keep their own id and city
    extra = b.select("cnpj", F.col("pdv_id").alias("_bid"), F.col("cidade").alias("_bcid"))
    first = T._first_per_key(extra.withColumnRenamed("_bid", "pdv_id"), ["cnpj"], "pdv_id")
    first = first.select("cnpj", F.col("pdv_id").alias("_bid"), "_bcid")
    j = up.join(first, "cnpj", "left")
    return j.select(F.coalesce("pdv_id", "_bid").alias("pdv_id"), "cnpj",
                    F.when(F.col("pdv_id").isNull(), F.col("_bcid")).otherwise(F.col("cidade")).alias("cidade"),
                    "pdv_vendas")


CACHE_SQL = BASE + """,
cache as (
  select upper(cidade) || ' ' || cnpj as endereco, lat, lon,
         case when pdv_id % 10 = 0 then 'manual_edit' else 'nominatim' end as origem
  from points),
fresh0 as (
  select upper(cidade) || ' ' || cnpj as endereco,
         cast(-20.0 as double) - pdv_id / cast(100000 as double) as lat, cast(-45.0 as double) as lon,
         'google' as origem, pdv_id
  from batch),
fresh as (
  select * from (select *, row_number() over (partition by endereco order by pdv_id) as rn from fresh0) t
  where rn = 1)
"""


def _cache(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return p.select(F.concat(F.upper("cidade"), F.lit(" "), F.col("cnpj")).alias("endereco"), "lat", "lon",
                    F.when(F.col("pdv_id") % 10 == 0, "manual_edit").otherwise("nominatim").alias("origem"))


def _fresh(spark, sf_dir):
    b = _batch(spark, sf_dir)
    return b.select(F.concat(F.upper("cidade"), F.lit(" "), F.col("cnpj")).alias("endereco"),
                    (F.lit(-20.0) - F.col("pdv_id") / F.lit(100000.0)).alias("lat"), F.lit(-45.0).alias("lon"),
                    F.lit("google").alias("origem"), "pdv_id")


@register("upsert_cache_guarded", sql=CACHE_SQL + """
select coalesce(c.endereco, f.endereco) as endereco,
       case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.lat else c.lat end as lat,
       case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.lon else c.lon end as lon,
       case when f.endereco is not null and coalesce(c.origem, '') <> 'manual_edit' then f.origem else c.origem end as origem
from cache c full outer join fresh f on f.endereco = c.endereco
""")
def q_upsert_cache_guarded(spark, sf_dir):
    """K-02: geocode write-back; rows stamped `manual_edit` are never overwritten."""
    fresh = _fresh(spark, sf_dir)
    out = T.upsert_guarded(_cache(spark, sf_dir), fresh, ["endereco"], ["lat", "lon", "origem"],
                           guard=F.col("origem") == "manual_edit", reject=generic_coord("lat", "lon"),
                           order="pdv_id")
    return out


@register("delete_cascade_cache", sql=CACHE_SQL + """,
flagged as (select pdv_id from points where lat > -20.0),
gone_keys as (select distinct upper(p.cidade) || ' ' || p.cnpj as k from points p join flagged f on f.pdv_id = p.pdv_id)
select c.endereco, c.lat, c.lon, c.origem from cache c where c.endereco not in (select k from gone_keys)
""")
def q_delete_cascade_cache(spark, sf_dir):
    """K-08: delete flagged points and the cache rows of their keys."""
    p = fx.points(spark, sf_dir).withColumn("_key", F.concat(F.upper("cidade"), F.lit(" "), F.col("cnpj")))
    flagged = p.filter(F.col("lat") > -20.0).select("pdv_id")
    _, cache = T.delete_cascade(p, _cache(spark, sf_dir), flagged, "pdv_id", "endereco", "_key")
    return cache


@register("update_from_sales", sql=BASE + """
select t.pdv_id, t.cnpj, t.cidade,
       case when s.cnpj is not null and t.pdv_vendas < 0 then s.pdv_vendas else t.pdv_vendas end as pdv_vendas
from target t left join (select distinct on (cnpj) cnpj, pdv_vendas from first_new order by cnpj) s on s.cnpj = t.cnpj
""")
def q_update_from_sales(spark, sf_dir):
    """K-07: fill sales from the batch only where the stored value is negative."""
    t = _target(spark, sf_dir).withColumn("_neg", F.when(F.col("pdv_vendas") < 0, F.lit(None)).otherwise(F.lit(1)))
    src = T._first_per_key(_batch(spark, sf_dir), ["cnpj"], "pdv_id").select("cnpj", "pdv_vendas")
    return T.update_from(t, src, ["cnpj"], ["pdv_vendas"], only_where_null="_neg").drop("_neg")


# ---------------------------------------------------------------- histories
@register("job_latest_per_input", sql=fx.with_fixtures("job_log") + """
select distinct on (tenant_id, input_id) tenant_id, input_id, id, job_id, status, validos, criado_em
from job_log order by tenant_id, input_id, criado_em desc, id desc
""")
def q_job_latest_per_input(spark, sf_dir):
    """W-01: newest history row per (tenant, input)."""
    j = fx.job_log(spark, sf_dir)
    return latest_per_key(j, ["tenant_id", "input_id"], "criado_em", "id")


@register("job_history_page", sql=fx.with_fixtures("job_log") + """,
f as (
  select * from job_log
  where tenant_id = 1 and status in ('done', 'error') and job_id ilike '%1%'
    and criado_em >= timestamp '2024-01-01' and criado_em < timestamp '2024-01-04' + interval 1 day)
select id, job_id, input_id, status, criado_em, (select count(*) from f) as total
from f order by criado_em desc, id desc limit 20 offset 10
""")
def q_job_history_page(spark, sf_dir):
    """F-01..F-04, L-02, W-02: optional filters, date range, one page and the total."""
    from ..plans.reports import history_page
    j = fx.job_log(spark, sf_dir)
    return history_page(j, tenant_id=1, statuses=["done", "error"], text="1",
                        date_from="2024-01-01", date_to="2024-01-04", limit=20, offset=10)


@register("job_counts_per_input", sql=fx.with_fixtures("job_log") + """,
latest as (
  select distinct on (job_id) job_id, tenant_id, input_id, status, validos from job_log
  order by job_id, criado_em desc, id desc)
select i.tenant_id, i.input_id, i.n_rows, i.n_jobs, i.first_ts,
       coalesce(d.n_done, 0) as n_done, coalesce(d.validos_done, 0) as validos_done
from (select tenant_id, input_id, count(*) as n_rows, count(distinct job_id) as n_jobs, min(criado_em) as first_ts
      from job_log group by tenant_id, input_id) i
left join (select tenant_id, input_id, count(*) as n_done, cast(sum(validos) as bigint) as validos_done
           from latest where status = 'done' group by tenant_id, input_id) d
  on d.tenant_id = i.tenant_id and d.input_id = i.input_id
""")
def q_job_counts_per_input(spark, sf_dir):
    """A-08, A-10, A-11: counts and first date per input; last status per job -> done totals, zero-filled."""
    j = fx.job_log(spark, sf_dir)
    i = j.groupBy("tenant_id", "input_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                               F.count_distinct("job_id").alias("n_jobs"),
                                               F.min("criado_em").alias("first_ts"))
    latest = latest_per_key(j.select("job_id", "tenant_id", "input_id", "status", "validos", "criado_em", "id"),
                            ["job_id"], "criado_em", "id")
    d = (latest.filter(F.col("status") == "done").groupBy("tenant_id", "input_id")
         .agg(F.count(F.lit(1)).alias("n_done"), F.sum("validos").cast("long").alias("validos_done")))
    r = i.join(d, ["tenant_id", "input_id"], "left")
    return r.select("tenant_id", "input_id", "n_rows", "n_jobs", "first_ts",
                    F.coalesce("n_done", F.lit(0)).cast("long").alias("n_done"),
                    F.coalesce("validos_done", F.lit(0)).cast("long").alias("validos_done"))


K04_SQL = BASE.replace("with points as", "with points as", 1) + """,
target as (
  select lpad(cast((pdv_id * 6553) % 100000000 as varchar), 8, '0') as cep, zona as cluster_id, lat, lon,
         cast(1 as bigint) as clientes_total, cast(0 as bigint) as clientes_target
  from points where tenant_id = 0),
rows0 as (
  select c.row_id, c.cep, case when c.uf = 'ZZ' then null else p.zona end as cluster_id,
         p.lat + 0.01 as lat, p.lon as lon, cast(5 as bigint) as clientes_total, cast(5 as bigint) as clientes_target
  from clean c join points p on p.pdv_id = c.row_id
  where regexp_matches(c.cep, '^[0-9]{8}$') and p.lat is not null and p.lon is not null
    and (case when c.uf = 'ZZ' then null else p.zona end) is not null),
r as (select * from (select *, row_number() over (partition by cep order by row_id) rn from rows0) t where rn = 1)
select coalesce(t.cep, r.cep) as cep,
       case when r.cep is not null then r.cluster_id else t.cluster_id end as cluster_id,
       case when r.cep is not null then r.lat else t.lat end as lat,
       case when r.cep is not null then r.lon else t.lon end as lon,
       case when t.cep is not null then t.clientes_total else r.clientes_total end as clientes_total,
       case when t.cep is not null then t.clientes_target else r.clientes_target end as clientes_target
from target t full outer join r on r.cep = t.cep
"""


@register("upsert_clean_ceps", sql=K04_SQL.replace(
    "target as (select pdv_id, cnpj, cidade, pdv_vendas from points),", "", 1))
def q_upsert_clean_ceps(spark, sf_dir):
    """K-04: CEP rows filtered (8 digits, valid coordinates, a cluster), first per CEP wins,
    upserted; client counts of stored CEPs are not touched."""
    p = fx.points(spark, sf_dir)
    target = p.filter(F.col("tenant_id") == 0).select(
        F.lpad(((F.col("pdv_id") * 6553) % 100000000).cast("string"), 8, "0").alias("cep"),
        F.col("zona").alias("cluster_id"), "lat", "lon",
        F.lit(1).cast("long").alias("clientes_total"), F.lit(0).cast("long").alias("clientes_target"))
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    rows = c.join(p.select(F.col("pdv_id").alias("row_id"), "zona", "lat", "lon"), "row_id").select(
        "row_id", "cep", F.when(F.col("uf") == "ZZ", F.lit(None)).otherwise(F.col("zona")).alias("cluster_id"),
        (F.col("lat") + F.lit(0.01)).alias("lat"), "lon",
        F.lit(5).cast("long").alias("clientes_total"), F.lit(5).cast("long").alias("clientes_target"))
    return T.upsert_clean_ceps(target, rows, ["cep"], ["cluster_id", "lat", "lon"], order="row_id")


@register("manual_coordinate_edits", sql=fx.with_fixtures("points", "centers") + """,
edits as (
  select distinct on (tenant_id, cnpj) s_nationkey % 5 as tenant_id, lpad(cast(s_suppkey * 15 as varchar), 14, '0') as cnpj,
         s.lat, s.lon
  from (select c.*, sp.s_nationkey, sp.s_suppkey from centers c join supplier sp on sp.s_suppkey = c.centro_id) s
  order by tenant_id, cnpj),
t as (select pdv_id, tenant_id, cnpj, lat, lon, 'nominatim' as origem from points)
select t.pdv_id, t.tenant_id, t.cnpj,
       coalesce(e.lat, t.lat) as lat, coalesce(e.lon, t.lon) as lon,
       case when e.cnpj is not null then 'manual_edit' else t.origem end as origem
from t left join edits e on e.tenant_id = t.tenant_id and e.cnpj = t.cnpj
""")
def q_manual_coordinate_edits(spark, sf_dir):
    """K-10: manual coordinate edits applied by (tenant, CNPJ) and stamped `manual_edit`."""
    p = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "cnpj", "lat", "lon",
                                        F.lit("nominatim").alias("origem"))
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = fx.centers(spark, sf_dir)
    edits = c.join(s, c.centro_id == s.s_suppkey).select(
        (F.col("s_nationkey") % 5).alias("tenant_id"),
        F.lpad((F.col("s_suppkey") * 15).cast("string"), 14, "0").alias("cnpj"), "lat", "lon")
    return T.manual_edit(p, edits, ["tenant_id", "cnpj"], ["lat", "lon"])
