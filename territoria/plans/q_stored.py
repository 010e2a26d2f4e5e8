"""Registered queries over stored rows and files: scans, work queues, ids, slices, memberships, sheets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.fmt import centre_address, parse_route_coords
from ..functions.geo import haversine_km, haversine_sql, route_time_min
from ..functions.text import parse_city_uf
from ..operators import tables as T
from ..operators.quality import capital_flag
from ..session import ensure_checkpoint_dir
from ..sources import dims
from ..sources import fixtures as fx
from ..sources import files, tables
from .q_misc import CEP_POINTS_SQL, _cep_points
from .registry import register


def _folder(spark, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("scan_ceps_marketplace", sql=fx.with_fixtures("points", "marketplace_cep").rstrip() + CEP_POINTS_SQL + """
select m.tenant_id, c.uf, c.cidade, c.cep, c.lat, c.lon, m.clientes_total, m.clientes_target
from marketplace_cep m join cep_points c on c.cep = m.cep where m.tenant_id = 1 and upper(c.uf) = 'GO'
""")
def q_scan_ceps_marketplace(spark, sf_dir):
    """S-03 / S-05: CEP weights of the marketplace table for a tenant and state."""
    places = _cep_points(spark, sf_dir).select("cep", "uf", "cidade", "lat", "lon")
    return tables.scan_ceps(fx.marketplace_cep(spark, sf_dir).join(places, "cep"), None, use_marketplace=True, tenant_id=1, uf="go")


@register("clusters_for_routing", sql=fx.with_fixtures("points") + """,
runs as (select *, zona % 2 as run_id from points)
select p.pdv_id, p.zona as cluster_id, c.n_pdvs from runs p
join (select zona, count(*) as n_pdvs from runs group by zona) c on c.zona = p.zona
where p.tenant_id = 3 and p.run_id = 1
""")
def q_clusters_for_routing(spark, sf_dir):
    """S-08: the sectors of one run read back with their members."""
    p = fx.points(spark, sf_dir).select("tenant_id", (F.col("zona") % 2).alias("run_id"), F.col("zona").alias("cluster_id"), "pdv_id")
    sectors = p.groupBy("tenant_id", "run_id", F.col("cluster_id").alias("cluster_label")).agg(F.count(F.lit(1)).alias("n_pdvs"))
    c, members = tables.scan_clusters(sectors, p, tenant_id=3, run_id=1)
    return members.join(c, members["cluster_id"] == c["cluster_label"]).select("pdv_id", "cluster_id", "n_pdvs")


@register("awaiting_validation", sql=fx.with_fixtures("points") + """
select pdv_id as id, lat as pdv_lat, lon as pdv_lon from points
where tenant_id = 2 and pdv_id % 7 <> 0 and pdv_id % 3 <> 0
""")
def q_awaiting_validation(spark, sf_dir):
    """F-07: the whole queue of a tenant's points with coordinates and no validation status."""
    p = fx.points(spark, sf_dir).select(
        F.col("pdv_id").alias("id"), "tenant_id", F.when(F.col("pdv_id") % 7 != 0, F.col("lat")).alias("pdv_lat"), F.col("lon").alias("pdv_lon"),
        F.when(F.col("pdv_id") % 3 == 0, F.lit("ok")).alias("geo_validacao_status"))
    return tables.awaiting_validation(p, tenant_id=2).select("id", "pdv_lat", "pdv_lon")


@register("sector_memberships", sql=fx.with_fixtures("points") + """
select pdv_id, case when pdv_id % 11 = 0 then null else cnpj end as cnpj, zona as cluster_id from points where pdv_id % 7 <> 0
""")
def q_sector_memberships(spark, sf_dir):
    """K-16: rows point -> sector, those without a sector skipped, a blank CNPJ stored as null."""
    a = fx.points(spark, sf_dir).select("pdv_id", F.when(F.col("pdv_id") % 11 == 0, F.lit("  ")).otherwise(F.col("cnpj")).alias("cnpj"),
                                        F.when(F.col("pdv_id") % 7 != 0, F.col("zona")).alias("cluster_id"))
    return T.append_membership(a, "cluster_id")


@register("batch_ids", sql=fx.with_fixtures("points", "points_raw") + """
select row_id, cnpj, (select max(pdv_id) from points) + row_number() over (order by cnpj, row_id) as id from points_raw
""")
def q_batch_ids(spark, sf_dir):
    """K-05: ids that follow the stored ones, in the order of the batch."""
    last = fx.points(spark, sf_dir).agg(F.max("pdv_id")).first()[0] or 0
    return T.with_ids(fx.points_raw(spark, sf_dir).select("row_id", "cnpj"), last, ["cnpj", "row_id"])


@register("replace_slices", sql=fx.with_fixtures("points") + """
select pdv_id, tenant_id, uf, pdv_vendas from points where not (tenant_id = 1 and uf in (select uf from points where tenant_id = 1 and pdv_id % 2 = 0))
union all
select pdv_id, tenant_id, uf, pdv_vendas + 1 as pdv_vendas from points where tenant_id = 1 and pdv_id % 2 = 0
""")
def q_replace_slices(spark, sf_dir):
    """K-06: the slices (tenant, state) of a batch are emptied, then its rows stored."""
    p = fx.points(spark, sf_dir).select("pdv_id", "tenant_id", "uf", "pdv_vendas")
    batch = p.filter((F.col("tenant_id") == 1) & (F.col("pdv_id") % 2 == 0)).withColumn("pdv_vendas", F.col("pdv_vendas") + 1)
    return T.replace_slice(p, batch, ["tenant_id", "uf"])


PURGED = ["sales_subcluster_pdv", "sales_subcluster", "sales_vendedor_base"]
STORED = [*PURGED, "cluster_setor", "points"]


@register("purge_routing", sql=fx.with_fixtures("points") + " union all ".join(
    f"select '{t}' as tabela, tenant_id, count(*) as n from points " + ("where tenant_id <> 1 " if t in PURGED else "") + "group by tenant_id" for t in STORED))
def q_purge_routing(spark, sf_dir):
    """K-09: one tenant's rows leave the tables of the level `routing` and no others."""
    p = fx.points(spark, sf_dir).select("tenant_id")
    left = T.purge_level({t: p for t in STORED}, "routing", tenant_id=1)
    out = None
    for name, df in left.items():
        n = df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tabela"), "tenant_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


@register("address_city_uf", sql=fx.with_fixtures("points") + """
select pdv_id, case when pdv_id % 5 <> 0 then upper(cidade) end as cidade_lida, case when pdv_id % 5 <> 0 then uf end as uf_lida,
       case when pdv_id % 5 <> 0 then 'Rua das Flores ' || pdv_id end as rua, case when pdv_id % 5 <> 0 then 'Rua das Flores' end as rua_sem_numero
from points
""")
def q_address_city_uf(spark, sf_dir):
    """P-20: city, state and street read back from `street, district, city - UF, Brasil`."""
    p = fx.points(spark, sf_dir)
    street = F.concat(F.lit("Rua das Flores "), F.col("pdv_id").cast("string"), F.lit(", Centro, "))
    addr = F.when(F.col("pdv_id") % 5 != 0, F.concat(street, F.lower("cidade"), F.lit(" - "), F.lower("uf"), F.lit(", Brasil"))).otherwise(street)
    city, uf, rua, plain = parse_city_uf(F.col("addr"))
    return p.select("pdv_id", addr.alias("addr")).select("pdv_id", city.alias("cidade_lida"), uf.alias("uf_lida"), rua.alias("rua"),
                                                         plain.alias("rua_sem_numero"))


CENTRE_NUMBER_SQL = r"'(.*?)[, ]+(\d+[A-Za-z\-/]*)$'"


@register("centre_addresses", sql=fx.with_fixtures("points_raw") + rf""",
c as (select row_id, trim(regexp_replace(logradouro, '\s+', ' ', 'g')) as l, trim(numero) as n, trim(bairro) as b, trim(cidade) as ci, trim(uf) as u, trim(cep) as ce
      from points_raw),
s as (select *, n = '' and regexp_matches(l, {CENTRE_NUMBER_SQL}) as hit from c),
p as (select *, case when hit then trim(regexp_extract(l, {CENTRE_NUMBER_SQL}, 1)) else l end as l2,
             case when hit then trim(regexp_extract(l, {CENTRE_NUMBER_SQL}, 2)) else n end as n2 from s)
select row_id, case when l2 = '' or ci = '' or u = '' then ''
  else concat_ws(' - ', nullif(l2, ''), nullif(n2, ''), nullif(b, ''), nullif(ci, ''), nullif(u, ''), nullif(ce, '')) end as endereco from p
""")
def q_centre_addresses(spark, sf_dir):
    """P-30: one line per centre, a missing number taken from the street's tail."""
    return fx.points_raw(spark, sf_dir).select("row_id", centre_address("logradouro", "numero", "bairro", "cidade", "uf", "cep").alias("endereco"))


@register("route_coords", sql=fx.with_fixtures("points") + """
select pdv_id, case when pdv_id % 3 = 0 then 1 when pdv_id % 4 = 0 then 1 else 2 end as n_pontos, cast(pdv_id % 90 as double) as lat0
from points
""")
def q_route_coords(spark, sf_dir):
    """P-34: stored route geometry read tolerantly: single quotes, one bare object, points without a longitude."""
    a = F.concat(F.lit("{'lat': "), (F.col("pdv_id") % 90).cast("string"), F.lit(", 'lon': -46.5}"))
    b = F.when(F.col("pdv_id") % 4 == 0, F.lit("{'lat': 1.5}")).otherwise(F.lit("{'lat': 1.5, 'lon': 2.5}"))
    text = F.when(F.col("pdv_id") % 3 == 0, a).otherwise(F.concat(F.lit(" ["), a, F.lit(", "), b, F.lit("]")))
    r = fx.points(spark, sf_dir).select("pdv_id", text.alias("t")).select("pdv_id", parse_route_coords("t").alias("r"))
    return r.select("pdv_id", F.size("r").alias("n_pontos"), F.col("r")[0]["lat"].alias("lat0"))


@register("route_minutes", sql=fx.with_fixtures("points") + f"""
select pdv_id, round({haversine_sql('lat', 'lon', 'cast(-23.55 as double)', 'cast(-46.63 as double)')} / 35.0 * 60.0 + (pdv_id % 30) * 10.0, 6) as minutos
from points
""")
def q_route_minutes(spark, sf_dir):
    """G-03: driving minutes to a fixed place and the service time of the stops."""
    km = haversine_km("lat", "lon", F.lit(-23.55), F.lit(-46.63))
    return fx.points(spark, sf_dir).select("pdv_id", F.round(route_time_min(km, F.col("pdv_id") % 30, 10.0, 35.0), 6).alias("minutos"))


@register("capital_points", sql=fx.with_fixtures("points") + """
select pdv_id, (uf = 'SP' and pdv_id % 2 = 0) or uf = 'GO' as is_capital from points
""")
def q_capital_points(spark, sf_dir):
    """G-08: is the city, however spelled, the capital of its state?"""
    city = (F.when((F.col("uf") == "SP") & (F.col("pdv_id") % 2 == 0), F.lit(" São Paulo")).when(F.col("uf") == "GO", F.lit("goiânia"))
            .when(F.col("uf") == "MT", F.lit("Goiania")).otherwise(F.col("cidade")))
    p = fx.points(spark, sf_dir).select("pdv_id", "uf", city.alias("cidade"))
    return capital_flag(p, dims.capitals(spark)).select("pdv_id", "is_capital")


@register("sheet_round_trip", sql=fx.with_fixtures("points") + """
select cast(pdv_id as varchar) as pdv_id, case when pdv_id % 6 = 0 then '' else cidade || '; "' || uf || '"' end as municipio,
       replace(cast(cast(round(pdv_vendas, 2) as decimal(38, 2)) as varchar), '.', ',') as vendas from points
""")
def q_sheet_round_trip(spark, sf_dir):
    """S-01 / P-01 / K-11: a sheet with mark, decimal comma and quoted cells written and read back as text."""
    path = _folder(spark, "sheet")
    p = fx.points(spark, sf_dir).select(
        "pdv_id", F.when(F.col("pdv_id") % 6 != 0, F.concat(F.col("cidade"), F.lit('; "'), F.col("uf"), F.lit('"'))).alias(" Município"),
        F.col("pdv_vendas").cast("double").alias("VENDAS"))
    files.write_csv_ptbr(p, path)
    return files.scan_delimited(spark, path)


@register("centre_sheet", sql="""
select s_name as logradouro, 'Centro' as bairro, 'NATION_' || s_nationkey as cidade, 'SP' as uf, '' as numero, '' as cep, '' as cnpj, s_name as bandeira
from supplier
""")
def q_centre_sheet(spark, sf_dir):
    """S-07: a centre list whose headers are aliases and whose optional columns are missing."""
    path = _folder(spark, "centres")
    s = fx.table(spark, sf_dir, "supplier")
    s.select(F.col("s_name").alias("Logradouro"), F.lit("Centro").alias("Bairro"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("Cidade"),
             F.lit("SP").alias("UF"), F.col("s_name").alias("Razão")).write.option("header", True).option("sep", ";").csv(path)
    return files.scan_centers(spark, path)


@register("json_round_trip", sql=fx.with_fixtures("points") + """
select pdv_id, cidade, pdv_vendas from points
""")
def q_json_round_trip(spark, sf_dir):
    """K-12: rows written as JSON lines and read back by schema."""
    path = _folder(spark, "json")
    p = fx.points(spark, sf_dir).select("pdv_id", "cidade", "pdv_vendas")
    files.write_json(p, path)
    return spark.read.schema(p.schema).json(path)


@register("geojson_cities", sql="with v as (" + fx.POLYGON_VERTICES_SQL + """)
select upper(cidade) as cidade_key, 'XX' as uf_key, cast(0 as int) as ring, cast(seq as int) as seq, lon, lat from v
""")
def q_geojson_cities(spark, sf_dir):
    """S-06 / N-05: city rings written as one GeoJSON document and read back feature by feature.
    Names of other members hold braces and quotes, which are no structure."""
    path = _folder(spark, "geojson")
    odd = F.lit('a } "quoted" { name')
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"]))
    feat = fx.polygon_vertices(spark, sf_dir).groupBy("cidade").agg(ring.alias("r")).select(F.to_json(F.struct(
        F.struct(odd.alias("nota"), F.col("cidade").alias("NM_MUN"), F.lit("XX").alias("SIGLA_UF")).alias("properties"),
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), F.array("r").alias("coordinates")).alias("geometry"))).alias("f"))
    # one row a nation at most, so the document is small
    doc = feat.agg(F.array_join(F.collect_list("f"), ", ").alias("f")).select(F.concat(
        F.lit('{"type": "FeatureCollection", "name": "x { y", "crs": {"type": "name", "properties": {"name": "}"}}, "features": ['),
        F.col("f"), F.lit("]}")).alias("value"))
    doc.coalesce(1).write.text(path)
    return files.scan_polygons(spark, path)
