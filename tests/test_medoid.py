"""C-12: exact medoids, however many places stay candidates."""

import numpy as np
import pytest

from territoria.operators.clustering import dense_subset, medoids

KM = 6371.0


def _hav(a, b):
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[..., 0] - a[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((b[..., 1] - a[..., 1]) / 2) ** 2
    return 2 * KM * np.arcsin(np.sqrt(h))


def _totals(xy):
    return np.array([_hav(p[None, :], xy).sum() for p in xy])


def _points(kind: str, n: int) -> np.ndarray:
    rng = np.random.default_rng(n)
    if kind == "area":
        return rng.uniform(-5, 5, (n, 2))
    if kind == "ring":  # nearly equal totals, so bounds rule out little
        a = rng.uniform(0, 2 * np.pi, n)
        return np.stack([np.cos(a), np.sin(a)], 1)
    if kind == "copies":
        return rng.uniform(-5, 5, (7, 2))[rng.integers(0, 7, n)]
    return np.vstack([rng.normal(0, 1e-4, (n // 2, 2)), rng.uniform(-5, 5, (n - n // 2, 2))])


@pytest.mark.parametrize("kind, n", [("area", 1500), ("ring", 300), ("copies", 400), ("dense", 1000)])
def test_medoid_equals_brute_force(spark, kind, n):
    xy = _points(kind, n)
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(xy)] + [("one", 10**6, 1.0, 1.0), ("g", -1, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, pdv_id long, lat double, lon double")
    got = {r["g"]: r["medoid_id"] for r in medoids(df, ["g"], side=4, batch=16).collect()}
    tot = _totals(xy)
    assert got["one"] == 10**6
    assert tot[got["g"]] <= tot.min() * (1 + 1e-12)
    if kind == "copies":
        assert got["g"] == min(i for i in range(n) if (xy[i] == xy[got["g"]]).all())


def test_subset_of_small_and_large_groups(spark):
    xy = _points("area", 200)
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("b", 1000 + i, 0.0, 0.0) for i in range(3)]
    out = dense_subset(spark.createDataFrame(rows, "g string, pdv_id long, lat double, lon double"), 20, ["g"]).collect()
    m = int(_totals(xy).argmin())
    near = np.argsort(_hav(xy[m][None, :], xy), kind="stable")[:20]
    assert sorted(r["pdv_id"] for r in out if r["g"] == "a") == sorted(near.tolist())
    assert sorted(r["pdv_id"] for r in out if r["g"] == "b") == [1000, 1001, 1002]


@pytest.mark.parametrize("kind, n", [("area", 1500), ("ring", 300), ("copies", 400), ("dense", 1000)])
def test_jobs_over_all_tasks_equal_the_search_in_a_task(spark, kind, n):
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(_points(kind, n))] + [("one", 10**6, 1.0, 1.0), (None, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, pdv_id long, lat double, lon double")
    in_task, by_jobs = ({r["g"]: r["medoid_id"] for r in medoids(df, ["g"], side=4, local=k).collect()} for k in (n, 1))
    tot = _totals(_points(kind, n))
    assert set(in_task) == set(by_jobs) == {"g", "one"}
    assert tot[in_task["g"]] == pytest.approx(tot[by_jobs["g"]], rel=1e-12)


def test_groups_that_a_task_holds_need_no_rounds_of_jobs(spark):
    rows = [(g, 1000 * g + i, float(a), float(b)) for g in range(3) for i, (a, b) in enumerate(_points("ring", 900))]
    df = spark.createDataFrame(rows, "g long, pdv_id long, lat double, lon double")
    sc = spark.sparkContext
    sc.setJobGroup("medoids-in-tasks", "")
    medoids(df, ["g"]).collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("medoids-in-tasks")) <= 14
