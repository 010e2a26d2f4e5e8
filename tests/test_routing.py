"""Routing invariants: every point in one route, stop order a permutation, 2-opt never longer."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MED, SF_SMALL

import __spark_entry__ as E
from territoria.operators import routing as R
from territoria.sources import fixtures as fx


def test_two_opt_never_longer():
    rng = np.random.default_rng(7)
    for _ in range(20):
        pts = rng.uniform([-24, -47], [-23, -46], size=(12, 2))
        depot = pts.mean(0)
        ids = np.arange(12)
        nn = R.nearest_neighbour_order(depot[0], depot[1], ids, pts[:, 0], pts[:, 1])
        opt = R.two_opt(depot, pts, nn)
        assert sorted(opt.tolist()) == list(range(12))
        assert R._tour_km(depot, pts, opt) <= R._tour_km(depot, pts, nn) + 1e-9


def test_plan_routing_invariants(spark):
    totals = E.queries()["plan_routing"](spark, SF_MED)
    pts = fx.points(spark, SF_MED)
    assert totals.agg(F.sum("n_pdvs")).first()[0] == pts.count()
    assert totals.filter((F.col("dist_total_km") < 0) | (F.col("tempo_total_min") < 0)).count() == 0
    # route counts follow ceil(n * 2 / 21)
    n = pts.groupBy(F.col("zona").alias("cluster_id")).count()
    k = totals.groupBy("cluster_id").agg(F.countDistinct("subcluster_seq").alias("k"))
    j = n.join(k, "cluster_id").withColumn("want", F.least(F.ceil(F.col("count") * 2 / 21.0), F.col("count")))
    assert j.filter(F.col("k") > F.col("want")).count() == 0


def test_sequence_is_permutation(spark):
    stops = fx.route_stops(fx.points(spark, SF_SMALL))
    dep = stops.groupBy("cluster_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    seq = R.sequence_stops(stops, dep, ["cluster_id", "subcluster_seq"], ["cluster_id"], improve=True)
    g = seq.groupBy("cluster_id", "subcluster_seq").agg(F.count("*").alias("n"), F.max("sequencia_ordem").alias("mx"),
                                                        F.countDistinct("sequencia_ordem").alias("d"))
    assert g.filter((F.col("n") != F.col("mx")) | (F.col("n") != F.col("d"))).count() == 0
    assert seq.count() == stops.count()


def test_until_feasible(spark):
    totals = E.queries()["routes_until_feasible"](spark, SF_SMALL)
    assert totals.agg(F.sum("n_pdvs")).first()[0] == fx.points(spark, SF_SMALL).count()


def test_until_feasible_goes_on_to_n(spark):
    rows = [(i, 1, -10.0 + 0.5 * (i % 5), -40.0 + 0.5 * (i // 5)) for i in range(15)] + [(99, 2, -10.0, -40.001)]
    p = spark.createDataFrame(rows, "pdv_id long, cluster_id long, lat double, lon double")
    dep = spark.createDataFrame([(1, -9.0, -39.0), (2, -10.0, -40.0)], "cluster_id long, lat double, lon double")
    totals, stops = R.split_until_feasible(p, dep, ["cluster_id"], 1.0, 1.0, 35.0, 0.1, 1.3)
    got = {r["cluster_id"]: (r["k"], r["s"], r["n"]) for r in totals.groupBy("cluster_id").agg(
        F.max("k_final").alias("k"), F.min("status").alias("s"), F.sum("n_pdvs").alias("n")).collect()}
    assert got == {1: (15, "EXCEDIDO", 15), 2: (1, "OK", 1)}
    assert stops.count() == 16


def test_search_in_tasks_finds_the_first_k_that_the_plans_find(spark):
    """The routes and k of planning every k in turn; stops that no route can reach end the search at once."""
    rng = np.random.default_rng(3)
    rows = [("near", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.4, 0.4, (70, 2)))]
    rows += [("twice", 200 + i // 2, float(i // 2) / 50, 0.1) for i in range(24)] + [("far", 300 + i, 0.01 * i, 9.0 * (i % 2)) for i in range(6)]
    df = spark.createDataFrame(rows, "cluster_id string, pdv_id long, lat double, lon double")
    dep = spark.createDataFrame([("near", 0.0, 0.0), ("twice", 0.2, 0.0), ("far", 0.0, 0.0)], "cluster_id string, lat double, lon double")

    def search(local):
        totals, stops = R.split_until_feasible(df, dep, ["cluster_id"], 480.0, 300.0, 35.0, 10.0, 1.3, local=local)
        cols = ["cluster_id", "k_final", "subcluster_seq", "n_pdvs", "dist_total_km", "tempo_total_min", "status"]
        return sorted(map(tuple, totals.select(*cols).collect())), stops.count()

    in_tasks = search(None)
    assert in_tasks == search(0)
    assert {(r[0], r[-1]) for r in in_tasks[0]} == {("near", "OK"), ("twice", "OK"), ("far", "EXCEDIDO")}


def test_routes_share_tasks_and_go_on_over_batches(spark):
    """Stop orders equal each route's own search, though routes share a task and end in another batch than they began in."""
    rng = np.random.default_rng(4)
    rows = [(int(r) if r < 40 else None, i, float(a), float(b)) for i, (r, a, b) in
            enumerate(zip(rng.integers(0, 41, 900), np.round(rng.normal(-23, 0.3, 900), 2), np.round(rng.normal(-46, 0.3, 900), 2)))]
    stops = spark.createDataFrame(rows, "c long, pdv_id long, lat double, lon double")
    dep = spark.createDataFrame([(c, -23.0, -46.0) for c in range(40)], "c long, lat double, lon double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        plan = R.sequence_stops(stops, dep, ["c"], ["c"])
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()
        got = {(r["c"], r["sequencia_ordem"]): r["pdv_id"] for r in plan.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for c in range(40):
        own = [x for x in rows if x[0] == c]
        ids, lat, lon = (np.array([x[i] for x in own]) for i in (1, 2, 3))
        left, at = set(range(len(own))), (-23.0, -46.0)
        for step in range(len(own)):
            d = np.round(R._hav_np(at[0], at[1], lat, lon), 9)
            pick = min(left, key=lambda i: (d[i], ids[i]))
            left.discard(pick)
            want[c, step + 1], at = ids[pick], (lat[pick], lon[pick])
    assert got == want
