"""Projection of the driver's TPC-H-like tables onto the shapes this library works on.

The driver tables carry no coordinates or addresses, so both are derived by
integer arithmetic.  Every builder exists twice: a DataFrame builder (what the
Spark side runs) and the same projection as SQL text (what the DuckDB oracle
runs).  All literals are doubles and every ordering ends in an id, so both
engines produce identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _d(x: float) -> Column:
    return F.lit(float(x))


def _coord(base: float, step: float, zone_expr: Column, key: Column, mult: int, mod: int) -> Column:
    return (_d(base) + _d(step) * zone_expr
            + ((key * mult) % mod) / _d(mod) * _d(0.8))


def _uf4(nk: Column) -> Column:
    m = nk % 4
    return (F.when(m == 0, "SP").when(m == 1, "GO").when(m == 2, "MT").otherwise("BA"))


# --------------------------------------------------------------------------
# fx:points  (cleaned point table)
# --------------------------------------------------------------------------
POINTS_SQL = """
select c.c_custkey as pdv_id,
       c.c_nationkey % 5 as tenant_id,
       concat('00000000-0000-0000-0000-', lpad(cast(c.c_nationkey % 5 as string), 12, '0')) as input_id,
       lpad(cast(c.c_custkey as string), 14, '0') as cnpj,
       n.n_name as cidade,
       case c.c_nationkey % 4 when 0 then 'SP' when 1 then 'GO' when 2 then 'MT' else 'BA' end as uf,
       c.c_nationkey as zona,
       cast(-30.0 as double) + cast(1.1 as double) * c.c_nationkey
         + ((c.c_custkey * 7919) % 1000) / cast(1000 as double) * cast(0.8 as double) as lat,
       cast(-60.0 as double) + cast(0.9 as double) * ((c.c_nationkey * 7) % 25)
         + ((c.c_custkey * 104729) % 1009) / cast(1009 as double) * cast(0.8 as double) as lon,
       c.c_acctbal as pdv_vendas
from customer c join nation n on n.n_nationkey = c.c_nationkey
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    # nation is a fixed 25-row dimension: broadcasting it is size-safe.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    nk, ck = F.col("c_nationkey"), F.col("c_custkey")
    return (c.join(F.broadcast(n), nk == F.col("n_nationkey"))
            .select(ck.alias("pdv_id"),
                    (nk % 5).alias("tenant_id"),
                    F.concat(F.lit("00000000-0000-0000-0000-"),
                             F.lpad((nk % 5).cast("string"), 12, "0")).alias("input_id"),
                    F.lpad(ck.cast("string"), 14, "0").alias("cnpj"),
                    F.col("n_name").alias("cidade"),
                    _uf4(nk).alias("uf"),
                    nk.alias("zona"),
                    _coord(-30.0, 1.1, nk, ck, 7919, 1000).alias("lat"),
                    _coord(-60.0, 0.9, (nk * 7) % 25, ck, 104729, 1009).alias("lon"),
                    F.col("c_acctbal").alias("pdv_vendas")))


# --------------------------------------------------------------------------
# fx:centers  (fixed centres, one table of suppliers)
# --------------------------------------------------------------------------
CENTERS_SQL = """
select s_suppkey as centro_id, s_nationkey as zona, s_name as nome,
       cast(-30.0 as double) + cast(1.1 as double) * s_nationkey
         + ((s_suppkey * 6151) % 1000) / cast(1000 as double) * cast(0.8 as double) as lat,
       cast(-60.0 as double) + cast(0.9 as double) * ((s_nationkey * 7) % 25)
         + ((s_suppkey * 3571) % 1009) / cast(1009 as double) * cast(0.8 as double) as lon
from supplier
"""


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    nk, sk = F.col("s_nationkey"), F.col("s_suppkey")
    return s.select(sk.alias("centro_id"), nk.alias("zona"), F.col("s_name").alias("nome"),
                    _coord(-30.0, 1.1, nk, sk, 6151, 1000).alias("lat"),
                    _coord(-60.0, 0.9, (nk * 7) % 25, sk, 3571, 1009).alias("lon"))


# --------------------------------------------------------------------------
# fx:points_raw  (the uploaded sheet: every cell a string)
# --------------------------------------------------------------------------
POINTS_RAW_SQL = """
select c_custkey as row_id,
       case when c_custkey % 31 = 0 then ''
            else lpad(cast(case when c_custkey % 50 = 1 then c_custkey - 1 else c_custkey end as string), 14, '0') end as cnpj,
       case when c_custkey % 37 = 0 then ''
            else concat(case c_custkey % 4 when 0 then 'Av. São João' when 1 then 'RUA  25 DE MARÇO'
                             when 2 then 'al nogueira' else 'R Sto Antônio' end,
                        case when c_custkey % 3 = 0 then concat(', ', cast(c_custkey % 900 + 1 as string)) else '' end) end as logradouro,
       case c_custkey % 5 when 0 then 'S/N' when 1 then '' else cast(c_custkey % 500 as string) end as numero,
       case when c_custkey % 6 = 0 then concat('Centro NATION_', cast(c_nationkey as string)) else 'Jardim Europa' end as bairro,
       concat('NATION_', cast(c_nationkey as string)) as cidade,
       case c_nationkey % 5 when 0 then 'sp' when 1 then ' RJ' when 2 then 'MG' when 3 then 'BA' else 'ZZ' end as uf,
       case when c_custkey % 7 = 0 then '' else lpad(cast((c_custkey * 6553) % 100000000 as string), 8, '0') end as cep,
       case c_custkey % 4 when 0 then 'R$ 1.234,56' when 1 then cast(c_custkey as string) when 2 then 'abc' else '2000000000' end as pdv_vendas
from customer
"""


def points_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ck, nk = F.col("c_custkey"), F.col("c_nationkey")
    street = (F.when(ck % 4 == 0, "Av. São João").when(ck % 4 == 1, "RUA  25 DE MARÇO")
              .when(ck % 4 == 2, "al nogueira").otherwise("R Sto Antônio"))
    tail = F.when(ck % 3 == 0, F.concat(F.lit(", "), (ck % 900 + 1).cast("string"))).otherwise("")
    m5 = nk % 5
    return c.select(
        ck.alias("row_id"),
        F.when(ck % 31 == 0, "").otherwise(
            F.lpad(F.when(ck % 50 == 1, ck - 1).otherwise(ck).cast("string"), 14, "0")).alias("cnpj"),
        F.when(ck % 37 == 0, "").otherwise(F.concat(street, tail)).alias("logradouro"),
        F.when(ck % 5 == 0, "S/N").when(ck % 5 == 1, "").otherwise((ck % 500).cast("string")).alias("numero"),
        F.when(ck % 6 == 0, F.concat(F.lit("Centro NATION_"), nk.cast("string")))
        .otherwise("Jardim Europa").alias("bairro"),
        F.concat(F.lit("NATION_"), nk.cast("string")).alias("cidade"),
        F.when(m5 == 0, "sp").when(m5 == 1, " RJ").when(m5 == 2, "MG").when(m5 == 3, "BA")
        .otherwise("ZZ").alias("uf"),
        F.when(ck % 7 == 0, "").otherwise(
            F.lpad(((ck * 6553) % 100000000).cast("string"), 8, "0")).alias("cep"),
        F.when(ck % 4 == 0, "R$ 1.234,56").when(ck % 4 == 1, ck.cast("string"))
        .when(ck % 4 == 2, "abc").otherwise("2000000000").alias("pdv_vendas"))


# --------------------------------------------------------------------------
# fx:marketplace_cep  (CEP weights from orders)
# --------------------------------------------------------------------------
MARKETPLACE_CEP_SQL = """
select c.c_nationkey % 5 as tenant_id, c.c_nationkey as zona,
       lpad(cast((c.c_custkey * 6553) % 100000000 as string), 8, '0') as cep,
       count(o.o_orderkey) as clientes_total,
       count(case when o.o_orderstatus = 'F' then 1 end) as clientes_target
from customer c left join orders o on o.o_custkey = c.c_custkey
group by c.c_nationkey, c.c_custkey
"""


def marketplace_cep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # Pre-aggregate orders per customer before the join (map-side combine).
    o = (table(spark, sf_dir, "orders").groupBy("o_custkey")
         .agg(F.count("o_orderkey").alias("n_all"),
              F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("n_f")))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select(
        (F.col("c_nationkey") % 5).alias("tenant_id"), F.col("c_nationkey").alias("zona"),
        F.lpad(((F.col("c_custkey") * 6553) % 100000000).cast("string"), 8, "0").alias("cep"),
        F.coalesce(F.col("n_all"), F.lit(0)).cast("long").alias("clientes_total"),
        F.coalesce(F.col("n_f"), F.lit(0)).cast("long").alias("clientes_target"))


# --------------------------------------------------------------------------
# fx:job_log  (history rows derived from events)
# --------------------------------------------------------------------------
JOB_LOG_SQL = """
select event_id as id, user_id % 5 as tenant_id, concat('job-', cast(user_id as string)) as job_id,
       concat('input-', cast(user_id % 40 as string)) as input_id,
       case when event_type = 'error' then 'error' when event_id % 3 = 0 then 'done' else 'running' end as status,
       cast(event_id % 100 as bigint) as validos, ts as criado_em
from events
"""


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("tenant_id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.lit("input-"), (F.col("user_id") % 40).cast("string")).alias("input_id"),
        F.when(F.col("event_type") == "error", "error")
        .when(F.col("event_id") % 3 == 0, "done").otherwise("running").alias("status"),
        (F.col("event_id") % 100).cast("long").alias("validos"),
        F.col("ts").alias("criado_em"))


# --------------------------------------------------------------------------
# fx:route_stops  (points cut into routes of 8 along longitude per zone)
# --------------------------------------------------------------------------
ROUTE_STOPS_SQL = """
select zona as cluster_id,
       cast(floor((row_number() over (partition by zona order by lon, lat, pdv_id) - 1) / cast(8 as double)) as int) + 1 as subcluster_seq,
       pdv_id, lat, lon
from points
"""


def route_stops(pts: DataFrame) -> DataFrame:
    # Skew-safe rank inside each zone (range partitioning), not a per-zone window.
    from ..operators.windows import ranked
    r = ranked(pts.select("zona", "pdv_id", "lat", "lon"), ["zona"], ["lon", "lat", "pdv_id"], out="_rk")
    return r.select(
        F.col("zona").alias("cluster_id"),
        (F.floor((F.col("_rk") - 1) / _d(8)).cast("int") + 1).alias("subcluster_seq"),
        "pdv_id", "lat", "lon")


# --------------------------------------------------------------------------
# fx:polygon_vertices  (an L-shaped ring per city; every fifth zone has none)
# --------------------------------------------------------------------------
POLYGON_VERTICES_SQL = """
select n.n_name as cidade, v.seq,
       cast(-60.0 as double) + cast(0.9 as double) * ((n.n_nationkey * 7) % 25) + v.dx as lon,
       cast(-30.0 as double) + cast(1.1 as double) * n.n_nationkey + v.dy as lat
from nation n cross join (
  select 0 as seq, cast(0.0 as double) as dx, cast(0.0 as double) as dy union all
  select 1, cast(0.6 as double), cast(0.0 as double) union all
  select 2, cast(0.6 as double), cast(0.3 as double) union all
  select 3, cast(0.3 as double), cast(0.3 as double) union all
  select 4, cast(0.3 as double), cast(0.6 as double) union all
  select 5, cast(0.0 as double), cast(0.6 as double)) v
where n.n_nationkey % 5 <> 4
"""

# The L-shaped ring offsets (seq, dx, dy) in degrees.
L_SHAPE = [(0, 0.0, 0.0), (1, 0.6, 0.0), (2, 0.6, 0.3), (3, 0.3, 0.3), (4, 0.3, 0.6), (5, 0.0, 0.6)]


def polygon_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 5 != 4)
    nk = F.col("n_nationkey")
    shape = F.array(*[F.struct(F.lit(s).alias("seq"), _d(dx).alias("dx"), _d(dy).alias("dy"))
                      for s, dx, dy in L_SHAPE])
    v = n.select("n_name", "n_nationkey", F.explode(shape).alias("v"))
    return v.select(F.col("n_name").alias("cidade"), F.col("v.seq").alias("seq"),
                    (_d(-60.0) + _d(0.9) * ((nk * 7) % 25) + F.col("v.dx")).alias("lon"),
                    (_d(-30.0) + _d(1.1) * nk + F.col("v.dy")).alias("lat"))


# --------------------------------------------------------------------------
# fx:route_cache  (some legs inside each zone; the rest falls back)
# --------------------------------------------------------------------------
ROUTE_CACHE_SQL = """
select a.lat as origem_lat, a.lon as origem_lon, b.lat as destino_lat, b.lon as destino_lon,
       cast(1 + a.pdv_id % 40 as double) as distancia_km, cast(2 + a.pdv_id % 60 as double) as tempo_min, 'cache' as fonte
from points a join points b on b.zona = a.zona and b.pdv_id > a.pdv_id and b.pdv_id <= a.pdv_id + 60
where a.pdv_id % 2 = 0
"""


def route_cache(pts: DataFrame) -> DataFrame:
    """Band join on pdv_id inside a zone, written as an equi-join on id buckets.

    b.pdv_id in (a.pdv_id, a.pdv_id + 60]: bucket ids by 64 and join a's bucket
    to b's bucket and the next one, then apply the exact band.
    """
    a = (pts.filter(F.col("pdv_id") % 2 == 0)
         .select("zona", "pdv_id", "lat", "lon",
                 F.explode(F.array(F.floor(F.col("pdv_id") / 64), F.floor(F.col("pdv_id") / 64) + 1))
                 .alias("bkt")))
    b = pts.select(F.col("zona").alias("b_zona"), F.col("pdv_id").alias("b_id"),
                   F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
                   F.floor(F.col("pdv_id") / 64).alias("b_bkt"))
    j = a.join(b, (F.col("zona") == F.col("b_zona")) & (F.col("bkt") == F.col("b_bkt"))
               & (F.col("b_id") > F.col("pdv_id")) & (F.col("b_id") <= F.col("pdv_id") + 60))
    return j.select(F.col("lat").alias("origem_lat"), F.col("lon").alias("origem_lon"),
                    F.col("b_lat").alias("destino_lat"), F.col("b_lon").alias("destino_lon"),
                    (F.lit(1) + F.col("pdv_id") % 40).cast("double").alias("distancia_km"),
                    (F.lit(2) + F.col("pdv_id") % 60).cast("double").alias("tempo_min"),
                    F.lit("cache").alias("fonte"))


def with_fixtures(*names: str) -> str:
    """SQL `WITH` prefix defining the fixture views an oracle query reads."""
    defs = {
        "points": POINTS_SQL, "centers": CENTERS_SQL, "points_raw": POINTS_RAW_SQL,
        "marketplace_cep": MARKETPLACE_CEP_SQL, "job_log": JOB_LOG_SQL,
        "route_stops": ROUTE_STOPS_SQL, "polygon_vertices": POLYGON_VERTICES_SQL,
        "route_cache": ROUTE_CACHE_SQL,
    }
    order = ["points", "centers", "points_raw", "marketplace_cep", "job_log",
             "route_stops", "polygon_vertices", "route_cache"]
    needed = set(names)
    if needed & {"route_stops", "route_cache"}:
        needed.add("points")
    parts = [f"{n} as ({defs[n].strip()})" for n in order if n in needed]
    return "with " + ",\n".join(parts) + "\n"
