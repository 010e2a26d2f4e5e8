"""File sources and sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL

from territoria.operators.polygons import validate_geo
from territoria.sources import files
from territoria.sources import fixtures as fx


def test_scan_delimited_folds_headers_and_sniffs(spark):
    d = tempfile.mkdtemp(prefix="s01-")
    p = os.path.join(d, "sheet.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿CNPJ ; Logradouro;Número;BAIRRO;Cidade;UF;CEP\n")
        f.write("1,23E+13;AV PAULISTA, 1578;;Centro SP;São Paulo;sp;01310-100\n")
        f.write(";RUA 25 DE MARÇO;S/N;;SP;SP;\n")
    df = files.scan_delimited(spark, p)
    assert df.columns == ["cnpj", "logradouro", "numero", "bairro", "cidade", "uf", "cep"]
    rows = df.collect()
    assert rows[1]["cnpj"] == "" and rows[0]["cidade"] == "São Paulo"


def test_scan_centers_aliases(spark):
    d = tempfile.mkdtemp(prefix="s07-")
    p = os.path.join(d, "centros.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("logradouro,bairro,cidade,uf,Bandeira Cliente\nRua A 10,Centro,Campinas,SP,X\n")
    df = files.scan_centers(spark, p)
    assert set(["numero", "cep", "cnpj", "bandeira"]) <= set(df.columns)
    assert df.first()["bandeira"] == "X"


def test_geojson_polygons_match_vertex_table(spark):
    verts = fx.polygon_vertices(spark, SF_SMALL).orderBy("cidade", "seq").collect()
    feats = {}
    for v in verts:
        feats.setdefault(v["cidade"], []).append([v["lon"], v["lat"]])
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"NM_MUN": c, "SIGLA_UF": "XX"},
         "geometry": {"type": "Polygon", "coordinates": [ring + [ring[0]]]}} for c, ring in feats.items()]}
    d = tempfile.mkdtemp(prefix="s06-")
    p = os.path.join(d, "cities.json")
    with open(p, "w") as f:
        json.dump(doc, f)
    poly = files.scan_polygons(spark, p).select(F.col("cidade_key").alias("cidade"), "ring", "seq", "lon", "lat")
    pts = fx.points(spark, SF_SMALL)
    a = validate_geo(pts, poly).select("pdv_id", "geo_validacao_status")
    b = validate_geo(pts, fx.polygon_vertices(spark, SF_SMALL)).select("pdv_id", "geo_validacao_status")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.filter(F.col("geo_validacao_status") == "ok").count() > 0


def test_writers(spark):
    d = tempfile.mkdtemp(prefix="k11-")
    df = spark.createDataFrame([(1, 1234.5, "a"), (2, 2.0, "b")], "id int, v double, s string")
    files.write_csv_ptbr(df, os.path.join(d, "csv"))
    text = "".join(open(os.path.join(d, "csv", f), encoding="utf-8").read()
                   for f in sorted(os.listdir(os.path.join(d, "csv"))) if f.endswith(".csv"))
    assert "1234,50" in text and ";" in text
    rej = df.withColumn("motivo_invalidade", F.lit("numero"))
    assert files.write_rejects(rej, os.path.join(d, "rej"))
    assert not files.write_rejects(rej.filter("false"), os.path.join(d, "rej2"))


def test_capital_polygon_gate(spark):
    from territoria.operators.geocode import geocode_cascade
    from territoria.sources import dims
    # a unit square around (-23.5, -46.6) as the capital's polygon
    sq = [(0, 0, -47.0, -24.0), (0, 1, -46.0, -24.0), (0, 2, -46.0, -23.0), (0, 3, -47.0, -23.0)]
    poly = spark.createDataFrame([("SAO PAULO", "SP", r, s_, lo, la) for r, s_, lo, la in sq],
                                 "cidade_key string, uf_key string, ring int, seq int, lon double, lat double")
    rows = spark.createDataFrame(
        [(1, "K1", "rua a", "1", "São Paulo", "SP"), (2, "K2", "rua b", "2", "Campinas", "SP")],
        "row_id long, endereco_cache_key string, logradouro string, numero string, cidade string, uf string")
    cache = spark.createDataFrame([("K1", -20.0, -40.0), ("K2", -20.0, -40.0)], "endereco string, lat double, lon double")
    gnum = spark.createDataFrame([("rua a", "1", "São Paulo", "SP", -23.5, -46.5)],
                                 "rua_key string, numero string, cidade string, uf string, lat double, lon double")
    out = geocode_cascade(rows, cache, gnum, None, capitals=dims.capitals(spark), capital_polygons=poly)
    got = {r["row_id"]: r["status_geolocalizacao"] for r in out.collect()}
    # the capital row skips the cache hit outside its polygon; the other city keeps it
    assert got == {1: "gazetteer_numero", 2: "cache"}
