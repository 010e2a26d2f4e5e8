"""Registered scans, filters, semi/anti joins, order statistics, dedupe and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import haversine_sql, travel_min
from ..operators.aggregates import bbox_diameter, normalised_weight, weighted_centroid
from ..operators.quality import clean_points_raw, validate_points
from ..operators.spatial import nearest
from ..operators.windows import dense_relabel, duplicate_flag, keep_first, ranked
from ..sources import dims
from ..sources import fixtures as fx
from ..sources.tables import latest_run, scan_ceps, scan_points
from .q_clustering import NEAREST_CTE
from .q_text import CLEAN_SQL
from .registry import register

KMH = 35.0
ROUTE_KM_MAX = 60.0
CEP_MAX_MIN, CEP_MAX_KM = 45.0, 30.0

VALID = ("(lat is not null and lon is not null and not isnan(lat) and not isnan(lon) "
         "and lat between -90.0 and 90.0 and lon between -180.0 and 180.0)")


@register("scan_points_counts", sql=fx.with_fixtures("points") + f"""
select count(*) as n_total,
       cast(sum(case when {VALID} then 0 else 1 end) as bigint) as n_invalidas,
       cast(sum(case when {VALID} then 1 else 0 end)
            - count(distinct case when {VALID} then cast(round(lat, 6) as varchar) || ',' || cast(round(lon, 6) as varchar) end)
            as bigint) as n_coords_duplicadas
from points where tenant_id = 1 and upper(uf) = upper('go')
""")
def q_scan_points_counts(spark, sf_dir):
    """S-02 / F-01 / F-02: tenant + state (case-insensitive) scan; invalid and duplicate coordinate counts."""
    _, counts = scan_points(fx.points(spark, sf_dir), tenant_id=1, uf="go")
    return counts


def _cep_points(spark, sf_dir):
    p = fx.points(spark, sf_dir)
    return p.withColumn("cep", F.lpad(((F.col("pdv_id") * 6553) % 100000000).cast("string"), 8, "0"))


CEP_POINTS_SQL = """,
cep_points as (
  select *, lpad(cast((pdv_id * 6553) % 100000000 as varchar), 8, '0') as cep from points)
"""


@register("scan_ceps_points", sql=fx.with_fixtures("points").rstrip() + CEP_POINTS_SQL + """
select tenant_id, uf, cidade, cep, lat, lon, cast(1 as bigint) as clientes_total, cast(1 as bigint) as clientes_target
from cep_points where tenant_id = 2 and upper(uf) = 'MT'
""")
def q_scan_ceps_points(spark, sf_dir):
    """S-04 / S-05: each point as one client of its CEP, same schema as the marketplace source."""
    return scan_ceps(None, _cep_points(spark, sf_dir), use_marketplace=False, tenant_id=2, uf="mt")


@register("latest_done_job", sql=fx.with_fixtures("job_log") + """
select id, job_id, input_id, status from job_log
where status = 'done' and input_id is not distinct from 'input-7'
order by id desc limit 1
""")
def q_latest_done_job(spark, sf_dir):
    """S-09 / F-05 / L-01: newest `done` row with a null-safe key match."""
    return latest_run(fx.job_log(spark, sf_dir), match={"input_id": "input-7"}).select("id", "job_id", "input_id", "status")


@register("points_validate_existing", sql=CLEAN_SQL.replace(
    "with points_raw as", "with points as (" + fx.POINTS_SQL.strip() + "),\npoints_raw as", 1) + """,
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
ex as (select distinct cnpj from points where tenant_id = 3)
select s.row_id, s.cnpj,
       coalesce(s.m1, case when c.n > 1 then 'CNPJ duplicado no arquivo' end,
                case when e.cnpj is not null then 'CNPJ duplicado neste input_id' end) as motivo_invalidade
from staged s left join cnt c on c.cnpj = s.cnpj left join ex e on e.cnpj = s.cnpj
""")
def q_points_validate_existing(spark, sf_dir):
    """C-01 full precedence incl. J-11: CNPJs already stored for the input (tenant 3) rejected."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    existing = fx.points(spark, sf_dir).filter(F.col("tenant_id") == 3).select("cnpj")
    return validate_points(c, existing=existing).select("row_id", "cnpj", "motivo_invalidade")


@register("invalid_states", sql=CLEAN_SQL + f"""
select uf, cast(count(*) as bigint) as n from clean
where uf not in (select uf from {dims.STATE_BOUNDS_SQL}) group by uf
""")
def q_invalid_states(spark, sf_dir):
    """P-26: states of the sheet missing from the state dimension (anti join), counted."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    bad = c.join(F.broadcast(dims.state_bounds(spark).select("uf")), "uf", "left_anti")
    return bad.groupBy("uf").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------- CEP clustering
def _cep_assign(spark, sf_dir):
    m = fx.marketplace_cep(spark, sf_dir)
    cp = _cep_points(spark, sf_dir).select("cep", "lat", "lon")
    ceps = m.join(cp, "cep")
    cen = fx.centers(spark, sf_dir)
    a = nearest(ceps, cen, "centro_id")
    a = a.withColumn("tempo_min", travel_min(F.col("dist_km"), KMH))
    a = a.withColumn("mantido", (F.col("tempo_min") <= CEP_MAX_MIN) & (F.col("dist_km") <= CEP_MAX_KM))
    return a.join(cen.select("centro_id", F.col("nome").alias("centro_nome"), F.col("lat").alias("cluster_lat"),
                             F.col("lon").alias("cluster_lon")), "centro_id")


CEP_ASSIGN_SQL = fx.with_fixtures("points", "centers", "marketplace_cep").rstrip() + CEP_POINTS_SQL + f""",
ceps as (select m.*, c.lat, c.lon from marketplace_cep m join cep_points c on c.cep = m.cep),
cand as (select p.cep, c.centro_id, {haversine_sql('p.lat', 'p.lon', 'c.lat', 'c.lon')} as d from ceps p, centers c),
best as (select cep, centro_id, d from (
  select *, row_number() over (partition by cep order by d, centro_id) as rn from cand) t where rn = 1),
assigned as (
  select p.*, b.centro_id, b.d as dist_km, b.d / {KMH} * 60.0 as tempo_min,
         (b.d / {KMH} * 60.0 <= {CEP_MAX_MIN} and b.d <= {CEP_MAX_KM}) as mantido,
         c.nome as centro_nome, c.lat as cluster_lat, c.lon as cluster_lon
  from ceps p join best b on b.cep = p.cep join centers c on c.centro_id = b.centro_id)
"""


@register("active_assign_ceps", sql=CEP_ASSIGN_SQL + """
select cep, centro_id, round(dist_km, 3) as distancia_km, round(tempo_min, 3) as tempo_min, mantido from assigned
""")
def q_active_assign_ceps(spark, sf_dir):
    """C-14 / J-07: each CEP to its nearest centre; kept only within 45 minutes and 30 km."""
    a = _cep_assign(spark, sf_dir)
    return a.select("cep", "centro_id", F.round("dist_km", 3).alias("distancia_km"),
                    F.round("tempo_min", 3).alias("tempo_min"), "mantido")


@register("cep_cluster_summary", sql=CEP_ASSIGN_SQL + """
select centro_id, min(centro_nome) as centro_nome,
       round(avg(cluster_lat), 6) as cluster_lat, round(avg(cluster_lon), 6) as cluster_lon,
       count(distinct cep) as qtd_ceps, cast(sum(clientes_total) as bigint) as clientes_total,
       cast(sum(clientes_target) as bigint) as clientes_target,
       round(avg(dist_km), 2) as distancia_media_km, round(avg(tempo_min), 2) as tempo_medio_min,
       round(max(dist_km), 2) as distancia_max_km, round(max(tempo_min), 2) as tempo_max_min
from assigned where mantido group by centro_id
""")
def q_cep_cluster_summary(spark, sf_dir):
    """A-03 / X-09: per centre: name, centre, distinct CEPs, client sums, mean/max km and minutes."""
    a = _cep_assign(spark, sf_dir).filter("mantido")
    return a.groupBy("centro_id").agg(
        F.min("centro_nome").alias("centro_nome"),
        F.round(F.avg("cluster_lat"), 6).alias("cluster_lat"), F.round(F.avg("cluster_lon"), 6).alias("cluster_lon"),
        F.count_distinct("cep").alias("qtd_ceps"), F.sum("clientes_total").cast("long").alias("clientes_total"),
        F.sum("clientes_target").cast("long").alias("clientes_target"),
        F.round(F.avg("dist_km"), 2).alias("distancia_media_km"), F.round(F.avg("tempo_min"), 2).alias("tempo_medio_min"),
        F.round(F.max("dist_km"), 2).alias("distancia_max_km"), F.round(F.max("tempo_min"), 2).alias("tempo_max_min"))


@register("radius_stats", sql=fx.with_fixtures("points", "centers").rstrip() + "," + NEAREST_CTE + f""",
r as (select centro_id, d, row_number() over (partition by centro_id order by d, pdv_id) as rn,
             count(*) over (partition by centro_id) as n from best)
select centro_id,
       round(max(case when rn = n // 2 + 1 then d end), 3) as raio_mediano_km,
       round(max(case when rn = (case when n >= 2 then cast(floor(0.95 * n) as bigint) else n end) then d end), 3) as raio_p95_km,
       max(case when rn = (case when n >= 2 then cast(floor(0.95 * n) as bigint) else n end) then d end) * 3.0 <= {ROUTE_KM_MAX} as cabe_rota
from r group by centro_id
""")
def q_radius_stats(spark, sf_dir):
    """A-02 / C-20: upper-median and order-statistic p95 radius per centre (distributed rank), and the p95*3 check."""
    a = nearest(fx.points(spark, sf_dir), fx.centers(spark, sf_dir), "centro_id")
    n = a.groupBy("centro_id").agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(a.select("centro_id", "pdv_id", "dist_km"), ["centro_id"], ["dist_km", "pdv_id"], out="_rk").join(n, "centro_id")
    p95_rank = F.when(F.col("_n") >= 2, F.floor(F.col("_n") * 0.95)).otherwise(F.col("_n"))
    g = r.groupBy("centro_id").agg(
        F.max(F.when(F.col("_rk") == F.floor(F.col("_n") / 2) + 1, F.col("dist_km"))).alias("_med"),
        F.max(F.when(F.col("_rk") == p95_rank, F.col("dist_km"))).alias("_p95"))
    return g.select("centro_id", F.round("_med", 3).alias("raio_mediano_km"), F.round("_p95", 3).alias("raio_p95_km"),
                    (F.col("_p95") * 3.0 <= ROUTE_KM_MAX).alias("cabe_rota"))


@register("zone_centroids", sql=fx.with_fixtures("points", "marketplace_cep").rstrip() + CEP_POINTS_SQL + f""",
w as (select c.zona, c.lat, c.lon, m.clientes_total as peso from cep_points c join marketplace_cep m on m.cep = c.cep),
mx as (select zona, max(peso) as wmax from w group by zona)
select w.zona,
       round(case when sum(peso) = 0 then avg(lat) else sum(peso * lat) / sum(peso) end, 6) as centro_lat,
       round(case when sum(peso) = 0 then avg(lon) else sum(peso * lon) / sum(peso) end, 6) as centro_lon,
       min(w.lat) as lat_min, max(w.lat) as lat_max, min(w.lon) as lon_min, max(w.lon) as lon_max,
       round({haversine_sql('min(w.lat)', 'min(w.lon)', 'max(w.lat)', 'max(w.lon)')}, 3) as diametro_km,
       round(max(cast(peso as double) / mx.wmax), 6) as peso_norm_max,
       round(min(cast(peso as double) / mx.wmax), 6) as peso_norm_min
from w join mx on mx.zona = w.zona group by w.zona
""")
def q_zone_centroids(spark, sf_dir):
    """A-04 / A-15 / A-16: client-weighted centroid, bounding box and max-normalised weight per zone."""
    m = fx.marketplace_cep(spark, sf_dir).select("cep", F.col("clientes_total").alias("peso"))
    w = _cep_points(spark, sf_dir).select("zona", "cep", "lat", "lon").join(m, "cep")
    c = weighted_centroid(w, ["zona"], "peso")
    b = bbox_diameter(w, ["zona"])
    nw = normalised_weight(w, "peso", ["zona"]).groupBy("zona").agg(
        F.round(F.max("peso_norm"), 6).alias("peso_norm_max"), F.round(F.min("peso_norm"), 6).alias("peso_norm_min"))
    return c.join(b, "zona").join(nw, "zona")


@register("duplicate_and_first", sql=CLEAN_SQL + """,
d as (select cnpj, count(*) as n from clean group by cnpj),
f as (select cnpj, min(row_id) as first_row from clean group by cnpj)
select c.row_id, c.cnpj, d.n > 1 as duplicado, f.first_row
from clean c join d on d.cnpj = c.cnpj join f on f.cnpj = c.cnpj
""")
def q_duplicate_and_first(spark, sf_dir):
    """W-03 / W-04: every copy of a repeated CNPJ flagged, and the first row per CNPJ."""
    c = clean_points_raw(fx.points_raw(spark, sf_dir)).select("row_id", "cnpj")
    d = duplicate_flag(c, "cnpj")
    f = keep_first(c, ["cnpj"], "row_id").select("cnpj", F.col("row_id").alias("first_row"))
    return d.join(f, "cnpj").select("row_id", "cnpj", "duplicado", "first_row")


@register("farthest_three", sql=fx.with_fixtures("points", "centers").rstrip() + "," + NEAREST_CTE + """,
b2 as (select *, row_number() over (partition by centro_id order by d desc, pdv_id) as rk from best),
lab as (select centro_id, cast(dense_rank() over (order by centro_id) - 1 as int) as cluster_id
        from (select distinct centro_id from best) t)
select b2.pdv_id, b2.centro_id, lab.cluster_id, cast(b2.rk as bigint) as rk, round(b2.d, 6) as dist_km
from b2 join lab on lab.centro_id = b2.centro_id where b2.rk <= 3
""")
def q_farthest_three(spark, sf_dir):
    """W-05 / W-07 / L-03: the 3 farthest points of each centre (distributed rank) and dense labels 0..k-1."""
    a = nearest(fx.points(spark, sf_dir), fx.centers(spark, sf_dir), "centro_id").select("pdv_id", "centro_id", "dist_km")
    r = ranked(a, ["centro_id"], [F.col("dist_km").desc(), "pdv_id"], out="rk").filter(F.col("rk") <= 3)
    r = dense_relabel(r, "centro_id")
    return r.select("pdv_id", "centro_id", "cluster_id", "rk", F.round("dist_km", 6).alias("dist_km"))


@register("top_sales_points", sql=fx.with_fixtures("points") + """
select pdv_id, cidade, pdv_vendas from points where cidade ilike '%ation_1%' order by pdv_vendas desc, pdv_id limit 20
""")
def q_top_sales_points(spark, sf_dir):
    """F-03 / L-01: contains-style filter, multi-key order, top 20 (the report's feature)."""
    p = fx.points(spark, sf_dir).filter(F.col("cidade").ilike("%ation_1%"))
    return p.orderBy(F.col("pdv_vendas").desc(), "pdv_id").limit(20).select("pdv_id", "cidade", "pdv_vendas")


@register("state_cities", sql=fx.with_fixtures("points") + f"""
select distinct cidade, uf from points where uf = 'SP' and {VALID}
""")
def q_state_cities(spark, sf_dir):
    """U-03: distinct cities of a state that have coordinates."""
    from ..functions.geo import valid_coord
    p = fx.points(spark, sf_dir)
    return p.filter((F.col("uf") == "SP") & valid_coord("lat", "lon")).select("cidade", "uf").distinct()


@register("reverse_cache_lookup", sql=fx.with_fixtures("centers") + """,
cache as (select round(lat, 4) + 4e-7 as lat, round(lon, 4) - 4e-7 as lon, nome as endereco, zona from centers)
select distinct c.centro_id, k.endereco, k.zona
from centers c join cache k on abs(k.lat - round(c.lat, 4)) < 1e-6 and abs(k.lon - round(c.lon, 4)) < 1e-6
""")
def q_reverse_cache_lookup(spark, sf_dir):
    """F-06 / C-21: centre coordinates matched to a reverse-geocode cache within 1e-6 degrees
    (equi-join on a 1e-5 grid cell and its neighbours, then the exact residual)."""
    cen0 = fx.centers(spark, sf_dir)
    cache = cen0.select((F.round("lat", 4) + F.lit(4e-7)).alias("klat"), (F.round("lon", 4) - F.lit(4e-7)).alias("klon"),
                        F.col("nome").alias("endereco"), "zona")
    cen = cen0.select("centro_id", F.round("lat", 4).alias("qlat"), F.round("lon", 4).alias("qlon"))
    step = 1e-5
    cache = cache.withColumn("_a", F.floor(F.col("klat") / step)).withColumn("_b", F.floor(F.col("klon") / step))
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = (cen.withColumn("_o", F.explode(offs))
         .withColumn("_a", F.floor(F.col("qlat") / step) + F.col("_o.i"))
         .withColumn("_b", F.floor(F.col("qlon") / step) + F.col("_o.j")))
    j = q.join(cache, ["_a", "_b"]).filter((F.abs(F.col("klat") - F.col("qlat")) < 1e-6)
                                          & (F.abs(F.col("klon") - F.col("qlon")) < 1e-6))
    return j.select("centro_id", "endereco", "zona").distinct()


@register("order_dates_ids", sql="""
select o_orderkey,
       cast(coalesce(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y'),
                     try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%Y-%m-%d')) as date) as data_br,
       cast(coalesce(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%d/%m/%Y'),
                     try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')) as date) as data_iso,
       case when regexp_matches(lower(regexp_replace(regexp_replace(' ' || lpad(to_hex(o_orderkey), 32, 'A') || chr(9), '\\s+', '', 'g'), '[^0-9a-fA-F-]', '', 'g')), '^[0-9a-f]{32}$')
            then regexp_replace(lower(lpad(to_hex(o_orderkey), 32, 'A')), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') end as uuid_canon
from orders
""")
def q_order_dates_ids(spark, sf_dir):
    """P-27 / P-28: dates in dd/MM/yyyy and ISO text parsed back; ids turned into canonical UUID text."""
    from ..functions.ids import canonical_uuid, parse_date_br
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    raw_id = F.concat(F.lit(" "), F.lpad(F.hex(F.col("o_orderkey")), 32, "A"), F.lit("\t"))
    return o.select("o_orderkey",
                    parse_date_br(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("data_br"),
                    parse_date_br(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("data_iso"),
                    canonical_uuid(raw_id).alias("uuid_canon"))


@register("event_json_fields", sql="""
select event_id, try_cast(json_extract_string(props, '$.k') as double) as k,
       case when value = 0 then null else round(value / value, 3) end as razao
from events
""")
def q_event_json_fields(spark, sf_dir):
    """P-33 / P-31 / P-35: a JSON field as a number, and a ratio that is null instead of NaN/inf."""
    from ..functions.fmt import json_field, null_nan_inf
    e = fx.table(spark, sf_dir, "events")
    out = e.select("event_id", json_field("props", "k", as_double=True).alias("k"),
                   F.round(F.col("value") / F.nullif(F.col("value"), F.lit(0.0)), 3).alias("razao"))
    return null_nan_inf(out)


@register("address_fallbacks", sql=CLEAN_SQL + """
select row_id,
       coalesce(nullif(case when starts_with(bairro, 'Centro') then pdv_endereco_completo else '' end, ''),
                coalesce(logradouro, '')
                || case when numero is not null and numero <> '' then ', ' || numero else '' end
                || case when bairro is not null and bairro <> '' then ' - ' || bairro else '' end
                || case when cidade is not null and cidade <> '' then ', ' || cidade else '' end
                || case when uf is not null and uf <> '' then '/' || uf else '' end) as endereco
from clean
""")
def q_address_fallbacks(spark, sf_dir):
    """P-29: stored full address when present, else one built from the parts."""
    from ..functions.fmt import address_fallback
    c = clean_points_raw(fx.points_raw(spark, sf_dir))
    stored = F.when(F.col("bairro").startswith("Centro"), F.col("pdv_endereco_completo")).otherwise(F.lit(""))
    return c.select("row_id", address_fallback(stored, "logradouro", "numero", "bairro", "cidade", "uf").alias("endereco"))


@register("sql_functions", sql=fx.with_fixtures("points") + f"""
select pdv_id,
       round({haversine_sql('lat', 'lon', 'cast(-23.55 as double)', 'cast(-46.63 as double)')}, 6) as km_sp,
       round({haversine_sql('lat', 'lon', 'cast(-23.55 as double)', 'cast(-46.63 as double)')} / 35.0 * 60.0, 6) as min_sp,
       {VALID} as ok,
       nullif(regexp_replace(upper(regexp_replace(strip_accents(cidade || ' são'), '[^\\x00-\\x7F]', '', 'g')), '^\\s+|\\s+$', '', 'g'), '') as cidade_key
from points
""")
def q_sql_functions(spark, sf_dir):
    """N-01: the same scalars through registered SQL functions (`selectExpr`)."""
    from ..functions.sql_functions import register_sql_functions
    register_sql_functions(spark)
    p = fx.points(spark, sf_dir)
    return p.selectExpr("pdv_id", "round(haversine_km(lat, lon, -23.55D, -46.63D), 6) as km_sp",
                        "round(travel_min(haversine_km(lat, lon, -23.55D, -46.63D), 35.0D), 6) as min_sp",
                        "valid_coord(lat, lon) as ok", "city_key(cidade || ' são') as cidade_key")


@register("centre_reverse_lookup", sql=fx.with_fixtures("points", "centers") + f""",
sup as (select s_suppkey, s_acctbal from supplier),
cache as (select round(c.lat, 4) as lat, round(c.lon, 4) as lon, 'Rua ' || c.nome as rua, 'Centro' as bairro
          from centers c join sup on sup.s_suppkey = c.centro_id where sup.s_acctbal > 0),
hit as (select c.centro_id, min(k.rua) as rua, min(k.bairro) as bairro
        from centers c join cache k on abs(k.lat - c.lat) < 1e-6 and abs(k.lon - c.lon) < 1e-6 group by c.centro_id),
cand as (select c.centro_id, p.pdv_id, {haversine_sql('c.lat', 'c.lon', 'p.lat', 'p.lon')} as d
         from centers c, points p where c.centro_id not in (select centro_id from hit)),
near as (select centro_id, pdv_id from (
           select *, row_number() over (partition by centro_id order by d, pdv_id) as rn from cand) t where rn = 1)
select centro_id, rua, bairro, 'cache' as origem from hit
union all
select n.centro_id, 'Rua ' || p.cidade as rua, 'Bairro ' || cast(p.tenant_id as varchar) as bairro, 'gazetteer' as origem
from near n join points p on p.pdv_id = n.pdv_id
""")
def q_centre_reverse_lookup(spark, sf_dir):
    """C-21 / J-07: centre -> street and district from the reverse cache, else from the nearest gazetteer point."""
    from ..operators.geocode import reverse_geocode
    cen = fx.centers(spark, sf_dir)
    sup = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("centro_id"), "s_acctbal")
    cache = (cen.join(sup, "centro_id").filter(F.col("s_acctbal") > 0)
             .select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"),
                     F.concat(F.lit("Rua "), F.col("nome")).alias("rua"), F.lit("Centro").alias("bairro")))
    gaz = fx.points(spark, sf_dir).select(F.col("pdv_id").alias("gid"), "lat", "lon",
                                          F.concat(F.lit("Rua "), F.col("cidade")).alias("rua"),
                                          F.concat(F.lit("Bairro "), F.col("tenant_id").cast("string")).alias("bairro"))
    return reverse_geocode(cen, cache, gaz)
