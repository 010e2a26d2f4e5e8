"""The grid assignment equals the brute-force arg-min (squared degrees, ties by label)."""

import numpy as np

from territoria.operators.lloyd import assign, assign_grid, half_up, nearest_centres


def test_assign_grid_exact(spark):
    rng = np.random.default_rng(3)
    pts = [(int(g), i, float(a), float(b)) for i, (g, a, b) in
           enumerate(zip(rng.integers(0, 3, 3000), rng.normal(-23, 2, 3000), rng.normal(-46, 2, 3000)))]
    cen = [(int(g), c, float(a), float(b)) for c, (g, a, b) in
           enumerate(zip(rng.integers(0, 3, 400), rng.normal(-23, 2, 400), rng.normal(-46, 2, 400)))]
    P = spark.createDataFrame(pts, "g long, pdv_id long, lat double, lon double")
    C = spark.createDataFrame(cen, "g long, c long, lat double, lon double")
    grid = {r["pdv_id"]: r["c"] for r in assign_grid(P, C, ["g"]).collect()}
    arr = {r["pdv_id"]: r["c"] for r in assign(P, C, ["g"], k_max=1).collect()}
    assert grid == arr and len(grid) == 3000


def test_nearest_centres_equals_brute_force():
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(0, 1, 6000), 2), np.round(rng.normal(0, 1, 6000), 2)
    cs = np.round(rng.normal(0, 1, (900, 2)), 1)  # many ties: the first of equals
    brute = ((x[:, None] - cs[:, 0]) ** 2 + (y[:, None] - cs[:, 1]) ** 2).argmin(1)
    assert (nearest_centres(x, y, cs) == brute).all()


def test_half_up_as_spark_rounds():
    assert half_up(np.array([0.0000005, -0.0000005, 1.0000015, -30.1234565, 2.5])).tolist() == [1e-6, -1e-6, 1.000002, -30.123457, 2.5]


def test_rounds_in_tasks_equal_rounds_as_jobs(spark, monkeypatch):
    """Groups small enough run all rounds in one task: same labels and centres as by jobs, and few jobs."""
    from territoria.operators import lloyd
    rng = np.random.default_rng(8)
    rows = [(int(g) if g < 4 else None, i, float(a), float(b)) for i, (g, a, b) in enumerate(zip(rng.integers(0, 5, 4000), rng.normal(0, 1, 4000), rng.normal(0, 1, 4000)))]
    rows += [(0, 9000 + i, None, None) for i in range(3)]
    pts = spark.createDataFrame(rows, "g long, pdv_id long, lat double, lon double")
    k = spark.createDataFrame([(0, 90), (1, 3), (2, 1), (3, 70)], "g long, k int")

    def result(limit):
        monkeypatch.setattr(lloyd, "LOCAL_POINTS", limit)
        a, c = lloyd.kmeans(pts, k, ["g"])
        return ({r["pdv_id"]: (r["g"], r["c"]) for r in a.collect()}, sorted((r["g"], r["c"], round(r["lat"], 6), round(r["lon"], 6)) for r in c.collect()))

    by_jobs, by_tasks, mixed = result(0), result(10**6), result(820)
    assert by_tasks == by_jobs == mixed and len(by_tasks[0]) == 4003
