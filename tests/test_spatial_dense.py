"""Nearest neighbours where a third of all distinct places stand in one square kilometre."""

import numpy as np
from pyspark.sql import functions as F

from territoria.functions.geo import chord_for_km
from territoria.operators import spatial
from territoria.operators.routing import _hav_np


def plain_knn(xy, k):
    out = []
    for i, (a, b) in enumerate(xy):
        d = np.sort(np.delete(_hav_np(a, b, xy[:, 0], xy[:, 1]), i))[:k]
        out.append((d[0], d.mean()))
    return out


def dense(rng, n):
    city = np.round(rng.uniform([-23.55, -46.64], [-23.541, -46.631], size=(n // 3, 2)), 6)
    rest = np.round(rng.uniform([-33, -60], [2, -35], size=(n - n // 3, 2)), 6)
    return np.vstack([city, rest, city[:40], rest[:5]])  # some places twice


def test_knn_in_a_dense_district_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    xy = dense(rng, 2400)
    df = spark.createDataFrame([(i, 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "pdv_id long, t int, lat double, lon double")
    for by in ((), ("t",)):
        got = {r["pdv_id"]: (r["d1_km"], r["dk_mean_km"], r["k_found"]) for r in spatial.knn_distances(df, 5, by=by).collect()}
        assert len(got) == len(xy)
        for i, (d1, dk) in enumerate(plain_knn(xy, 5)):
            assert abs(got[i][0] - d1) < 1e-6 and abs(got[i][1] - dk) < 1e-6 and got[i][2] == 5


def test_searches_begin_where_few_places_meet(spark):
    """Each place starts at an edge whose 27 cells hold at most `most` places, and the next larger edge holds more."""
    rng = np.random.default_rng(5)
    xy = np.unique(dense(rng, 3000), axis=0)
    loc = spark.createDataFrame([(i, float(a), float(b), 1) for i, (a, b) in enumerate(xy)], "_loc long, _lat double, _lon double, _m int")
    s0 = chord_for_km(60.0)
    starts = spatial.start_edges(loc, s0, (), most=100)
    assert sum(d.count() for d in starts.values()) == len(xy) and len(starts) > 3

    lat, lon = np.radians(xy[:, 0]), np.radians(xy[:, 1])
    xyz = np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])

    def around(i, edge):
        cells = np.floor(xyz / edge)
        return int((np.abs(cells - cells[i]).max(1) <= 1).sum())

    for edge, rows in starts.items():
        for r in rows.orderBy(F.rand(1)).limit(40).collect():
            assert around(r["_loc"], edge) <= 100
            assert edge == s0 or around(r["_loc"], 2 * edge) > 100


def test_knn_of_little(spark):
    schema = "pdv_id long, lat double, lon double"
    assert spatial.knn_distances(spark.createDataFrame([], schema), 5).count() == 0
    two = spatial.knn_distances(spark.createDataFrame([(1, -10.0, -40.0), (2, -10.0, -41.0), (3, None, None)], schema), 5).collect()
    assert {r["pdv_id"]: r["k_found"] for r in two if r["pdv_id"] < 3} == {1: 1, 2: 1}


def test_work_on_one_file_split_is_spread(spark):
    """A sheet that arrives as one partition is cleaned by many tasks; points of one partition find their centres."""
    from territoria.operators.quality import clean_points_raw
    from territoria.operators.spatial import nearest
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = spark.range(40).coalesce(1).selectExpr("id as row_id", *[f"'x' as {c}" for c in ("cnpj", "logradouro", "numero", "bairro", "cidade", "uf", "cep", "pdv_vendas")])
    assert clean_points_raw(raw).rdd.getNumPartitions() == n
    pts = spark.range(400).coalesce(1).selectExpr("id as pdv_id", "id / 100.0D as lat", "0.0D as lon")
    cen = spark.createDataFrame([(1, 0.0, 0.0), (2, 4.0, 0.0)], "centro_id int, lat double, lon double")
    found = nearest(pts, cen, "centro_id")
    assert {r["pdv_id"]: r["centro_id"] for r in found.collect()} == {i: 1 if i <= 200 else 2 for i in range(400)}
