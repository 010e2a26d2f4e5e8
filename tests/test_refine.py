"""C-09 and C-10 against plain recursions, and routes longer than one task holds."""

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_MED

import __spark_entry__ as E
from territoria.operators import routing as R
from territoria.operators.clustering import recluster_by_route, recluster_recursive, refine_macro
from territoria.operators.lloyd import k_for_capacity
from territoria.plans.q_clustering import KMH, REFINE
from territoria.sources import fixtures as fx


def plain_lloyd(points, k):
    """points: (id, lat, lon); (labels, centres) by the same start, rounding and stop."""
    order = sorted(range(len(points)), key=lambda i: (points[i][2], points[i][1], points[i][0]))
    xy = np.array([p[1:] for p in points], float)
    tile = np.empty(len(points), int)
    for r, i in enumerate(order):
        tile[i] = r * k // len(points)

    def centre(label, old=None):
        out = {} if old is None else dict(old)
        for c in set(label.tolist()):
            out[c] = tuple(round(float(v), 6) for v in xy[label == c].mean(0))
        return out

    def nearest(cs):
        names = sorted(cs)
        m = np.array([cs[c] for c in names])
        return np.array(names)[((xy[:, None] - m) ** 2).sum(2).argmin(1)]

    cs = centre(tile)
    slack = 1e-4 / 2 * (xy[:, 0].var() + xy[:, 1].var())
    for _ in range(300):
        new = centre(nearest(cs), cs)
        shift = sum((new[c][0] - cs[c][0]) ** 2 + (new[c][1] - cs[c][1]) ** 2 for c in cs)
        cs = new
        if shift <= slack:
            break
    return nearest(cs), cs


def km(a, b):
    return float(R._hav_np(a[0], a[1], b[0], b[1]))


def plain_tour(points, centre, service=10.0, kmh=KMH):
    left, at, total = list(points), centre, 0.0
    while left:
        best = min(left, key=lambda p: (round(km(at, p[1:]), 9), p[0]))
        total += km(at, best[1:])
        left.remove(best)
        at = best[1:]
    total += km(at, centre)
    return round(total, 2), round(total / kmh * 60 + len(points) * service, 2)


def rows_of(spark, key, few=10**9):
    out = defaultdict(list)
    for r in fx.points(spark, SF_MED).collect():
        out[r[key]].append((r["pdv_id"], r["lat"], r["lon"]))
    return out


def close(a, b):
    return abs(a - b) <= 0.011


def test_refine_macro_equals_plain_version(spark):
    limits = REFINE | {"max_min": 700.0, "max_km": 500.0}
    pts = fx.points(spark, SF_MED).select("pdv_id", "tenant_id", "lat", "lon").where("tenant_id <= 2")
    k0 = k_for_capacity(pts, ["tenant_id"], 80)
    subs, members = refine_macro(pts, ["tenant_id"], k0, 5, **limits)
    got = defaultdict(dict)
    for r in subs.collect():
        got[r["tenant_id"]][r["macro"], r["seq"]] = r
    starts = {r["tenant_id"]: r["k"] for r in k0.collect()}
    for tenant, points in rows_of(spark, "tenant_id").items():
        if tenant > 2:
            continue
        for k in range(starts[tenant], len(points) + 1):
            labels, _ = plain_lloyd(points, k)
            expected, fits = {}, True
            for m, macro in enumerate(sorted(set(labels.tolist()))):
                own = [p for p, c in zip(points, labels) if c == macro]
                inner, centres = plain_lloyd(own, min(5, len(own)))
                for c in sorted(set(inner.tolist())):
                    part = [p for p, x in zip(own, inner) if x == c]
                    d, t = plain_tour(part, centres[c])
                    fits &= t <= limits["max_min"] and d <= limits["max_km"]
                    expected[m, c + 1] = (len(part), d, t)
            if fits:
                break
        assert {r["k_final"] for r in got[tenant].values()} == {k}
        assert set(got[tenant]) == set(expected)
        for at, (n, d, t) in expected.items():
            r = got[tenant][at]
            assert r["n_pdvs"] == n and close(r["dist_km"], d) and close(r["tempo_min"], t) and r["status"] == "OK"
    assert members.count() == members.select("pdv_id").distinct().count() == pts.count()


def test_refine_macro_ends_at_one_point_a_cluster(spark):
    rows = [(i, 1, -10.0 + 0.5 * i, -40.0) for i in range(6)] + [(10 + i, 2, -10.0, -40.0) for i in range(4)]
    p = spark.createDataFrame(rows, "pdv_id long, t long, lat double, lon double")
    k0 = spark.createDataFrame([(1, 1), (2, 1)], "t long, k int")
    subs, members = refine_macro(p, ["t"], k0, 2, max_min=5.0, max_km=1.0, kmh=35.0, service_min=10.0)
    assert {(r["t"], r["status"]) for r in subs.collect()} == {(1, "EXCEDIDO"), (2, "EXCEDIDO")} and members.count() == 10
    subs, _ = refine_macro(p, ["t"], k0, 2, max_min=100.0, max_km=1.0, kmh=35.0, service_min=10.0)
    assert {(r["t"], r["status"], r["k_final"]) for r in subs.collect()} == {(1, "OK", 3), (2, "OK", 1)}


def test_recluster_by_route_equals_plain_recursion(spark):
    pts = fx.points(spark, SF_MED).select("pdv_id", "tenant_id", "zona", "lat", "lon").where("zona <= 6")
    members, clusters = recluster_by_route(pts, ["tenant_id"], "zona", 5, **REFINE)
    expected, tours = {}, {}

    def descend(points, label, centre, divide):
        d, t = plain_tour(points, centre)
        bad = t > REFINE["max_min"] or d > REFINE["max_km"]
        if bad and len(points) > 5 and divide:
            labels, centres = plain_lloyd(points, divide)
            used = sorted(set(labels.tolist()))
            for c in used:
                descend([p for p, x in zip(points, labels) if x == c], f"{label}.{c + 1}", centres[c], divide + 1 if len(used) > 1 else 0)
        else:
            tours[label] = (len(points), d, t, "EXCEDIDO" if bad else "OK")
            expected.update({p[0]: label for p in points})

    start = defaultdict(list)
    for r in pts.collect():
        start[r["tenant_id"], r["zona"]].append((r["pdv_id"], r["lat"], r["lon"]))
    for (tenant, zone), points in start.items():
        descend(points, f"{tenant}/{zone}", tuple(np.array([p[1:] for p in points]).mean(0)), 2)
    got = {r["pdv_id"]: f"{r['tenant_id']}/{r['cluster_label']}" for r in members.collect()}
    assert got == expected
    for r in clusters.collect():
        n, d, t, status = tours.pop(f"{r['tenant_id']}/{r['cluster_label']}")
        assert (r["n_pdvs"], r["status"]) == (n, status) and close(r["dist_km"], d) and close(r["tempo_min"], t)
    assert not tours and any("." in x for x in got.values())


def test_recluster_by_route_of_one_place(spark):
    rows = [(i, 1, 0, -10.0, -40.0) for i in range(9)] + [(20, 1, 1, -10.0, -41.0)]
    p = spark.createDataFrame(rows, "pdv_id long, t long, zona long, lat double, lon double")
    members, clusters = recluster_by_route(p, ["t"], "zona", 5, max_min=60.0, max_km=10.0, kmh=35.0, service_min=10.0)
    assert {r["status"] for r in members.collect() if r["pdv_id"] < 9} == {"EXCEDIDO"} and members.count() == 10
    assert clusters.where("status = 'OK'").count() == 1


def tour_km(rows, depot):
    path = [depot, *[(r["lat"], r["lon"]) for r in sorted(rows, key=lambda r: r["sequencia_ordem"])], depot]
    xy = np.array(path)
    return float(R._hav_np(xy[:-1, 0], xy[:-1, 1], xy[1:, 0], xy[1:, 1]).sum())


def test_long_routes_are_divided_and_joined(spark, monkeypatch):
    rng = np.random.default_rng(4)
    xy = rng.uniform([-24, -47], [-23, -46], size=(3000, 2))
    rows = [(i, 1, 1 if i < 2600 else 2, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    p = spark.createDataFrame(rows, "pdv_id long, cluster_id long, subcluster_seq long, lat double, lon double")
    dep = spark.createDataFrame([(1, -23.5, -46.5)], "cluster_id long, lat double, lon double")
    route, depot = ["cluster_id", "subcluster_seq"], (-23.5, -46.5)
    whole = R.sequence_stops(p, dep, route, ["cluster_id"]).where("subcluster_seq = 2").collect()
    tiles = R._tiles(p.withColumn("_n", F.lit(2600)).where("subcluster_seq = 1"), route, "pdv_id", 120).groupBy("_t").count()
    assert tiles.agg(F.max("count"), F.sum("count")).first()[:] == (tiles.agg(F.max("count")).first()[0], 2600)
    assert tiles.agg(F.max("count")).first()[0] <= 120
    lengths = {}
    for mended in (True, False):
        if not mended:
            monkeypatch.setattr(R, "SEAM_STOPS", 0)
        out = R.sequence_stops(p, dep, route, ["cluster_id"], limit=500, piece=120).join(p, ["cluster_id", "subcluster_seq", "pdv_id"]).collect()
        long = [r for r in out if r["subcluster_seq"] == 1]
        assert sorted(r["sequencia_ordem"] for r in long) == list(range(1, 2601)) and len({r["pdv_id"] for r in long}) == 2600
        lengths[mended] = tour_km(long, depot)
        short = {(r["pdv_id"], r["sequencia_ordem"]) for r in out if r["subcluster_seq"] == 2}
        assert short == {(r["pdv_id"], r["sequencia_ordem"]) for r in whole}
    assert lengths[True] <= lengths[False] + 1e-6
    at_once = R.sequence_stops(p, dep, route, ["cluster_id"]).join(p, ["cluster_id", "subcluster_seq", "pdv_id"]).where("subcluster_seq = 1").collect()
    assert lengths[True] < 1.3 * tour_km(at_once, depot)


def test_registered_refinements(spark):
    subs = E.queries()["refine_macro_clusters"](spark, SF_MED)
    n = fx.points(spark, SF_MED).count()
    assert subs.agg(F.sum("n_pdvs")).first()[0] == n
    assert subs.where("status = 'OK' and (tempo_min > 480 or dist_km > 200)").count() == 0
    assert E.queries()["recluster_by_route"](spark, SF_MED).count() == n


def _jobs(spark, name, fn):
    sc = spark.sparkContext
    sc.setJobGroup(name, "")
    out = fn()
    sc.setLocalProperty("spark.jobGroup.id", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_splits_in_tasks_equal_splits_level_by_level(spark):
    """Clusters larger than a task's share take jobs of a level first; one id twice, one key null."""
    rng = np.random.default_rng(5)
    rows = [(1, "a" if i % 3 else "b", i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-1, 1, (150, 2)))]
    rows += [(1, "a", 7, 0.25, 0.5), (None, "a", 900, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "t int, z string, pdv_id long, lat double, lon double")

    def recursive(local):
        return sorted(map(tuple, recluster_recursive(df, ["t"], "z", 12, 40.0, KMH, local=local).select("pdv_id", "cluster_label", "status").collect()))

    def by_route(local):
        members, clusters = recluster_by_route(df, ["t"], "z", 5, local=local, **REFINE)
        ends = {r["cluster_label"]: (r["n_pdvs"], r["dist_km"], r["tempo_min"], r["status"]) for r in clusters.collect()}
        return sorted((r["pdv_id"], r["cluster_label"], r["status"]) for r in members.collect()), ends

    one, jobs = _jobs(spark, "recursive-in-tasks", lambda: recursive(None))
    assert one == recursive(60) and jobs <= 10
    (members, ends), jobs = _jobs(spark, "by-route-in-tasks", lambda: by_route(None))
    levels = by_route(60)
    assert members == levels[0] and jobs <= 14
    assert ends.keys() == levels[1].keys()
    for label, (n, dist, minutes, status) in ends.items():
        assert levels[1][label][::3] == (n, status)
        assert np.allclose(levels[1][label][1:3], (dist, minutes), atol=0.011)


def test_macro_counts_ruled_out_in_tasks_give_the_same_plan(spark, monkeypatch):
    """Small groups plan the first count that is not ruled out only; the sub-clusters are those of the search by plans."""
    from territoria.operators import clustering as C
    rng = np.random.default_rng(6)
    rows = [(int(g), i, float(a), float(b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 2, 90), rng.normal(0, 0.2, 90), rng.normal(0, 0.2, 90)))]
    pts = spark.createDataFrame(rows, "g long, pdv_id long, lat double, lon double")
    k = spark.createDataFrame([(0, 1), (1, 1)], "g long, k int")
    plans, plan = [], C._tour_status
    monkeypatch.setattr(C, "_tour_status", lambda *a: plans.append(1) or plan(*a))

    def result(local):
        plans.clear()
        subs, members = C.refine_macro(pts, ["g"], k, 2, 240.0, 200.0, 35.0, 20.0, local=local)
        return sorted(map(tuple, subs.collect())), sorted(map(tuple, members.collect())), len(plans)

    by_tasks, by_plans = result(10**6), result(0)
    assert by_tasks[:2] == by_plans[:2] and {r[2] for r in by_tasks[1]} != {1}
    assert by_tasks[2] == 1 < by_plans[2]
