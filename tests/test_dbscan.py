"""DBSCAN against a brute-force numpy implementation on a small fixture."""

import numpy as np

from conftest import SF_SMALL

from territoria.operators.clustering import adaptive_dbscan_params, dbscan
from territoria.sources import fixtures as fx


def _brute(X, eps, ms):
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = D <= eps * eps
    core = nb.sum(1) >= ms
    lab = -np.ones(len(X), int)
    c = 0
    for i in np.where(core)[0]:
        if lab[i] >= 0:
            continue
        stack, lab[i] = [i], c
        while stack:
            u = stack.pop()
            for v in np.where(nb[u] & core)[0]:
                if lab[v] < 0:
                    lab[v] = c
                    stack.append(v)
        c += 1
    return core, lab, c


def test_dbscan_matches_brute_force_on_cores(spark):
    pts = fx.points(spark, SF_SMALL).select("pdv_id", "tenant_id", "lat", "lon")
    eps_km, ms = 40.0, 3
    out = dbscan(pts, eps_km, ms, by=("tenant_id",)).toPandas().set_index("pdv_id")
    df = pts.toPandas()
    assert len(out) == len(df)
    for _, g in df.groupby("tenant_id"):
        X = g[["lat", "lon"]].to_numpy()
        core, lab, c = _brute(X, eps_km / 111.0, ms)
        got = out.loc[g.pdv_id.to_numpy(), "cluster_id"].to_numpy()
        # one label per brute-force component, distinct components -> distinct labels
        firsts = []
        for a in range(c):
            labels = set(got[lab == a])
            assert len(labels) == 1
            firsts.append(labels.pop())
        assert len(set(firsts)) == c
        # every point carries one of those labels (noise joins a cluster)
        if c:
            assert set(got) <= set(firsts)


def _planes(spark):
    """Three groups: a dense one, one four times as wide, and one too thin for any cluster."""
    rng = np.random.default_rng(3)
    rows = []
    for grp, side, n in ((0, 0.2, 90), (1, 0.8, 90), (2, 8.0, 4)):
        rows += [(len(rows) + i, grp, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, side, (n, 2)))]
    return spark.createDataFrame(rows, "pdv_id long, g int, lat double, lon double"), rows


def test_adaptive_parameters_per_group_match_brute_force(spark):
    pts, rows = _planes(spark)
    params = adaptive_dbscan_params(pts, by=("g",), eps_min_km=0.5, eps_max_km=20.0, ms_min=3, ms_max=9)
    got = {r["g"]: (r["eps_km"], r["min_samples"]) for r in params.collect()}
    for g in (0, 1, 2):
        X = np.array([r[2:] for r in rows if r[1] == g])
        la, lo = np.radians(X).T
        h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la)[:, None] * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
        d = 2 * 6371.0 * np.arcsin(np.sqrt(h))
        np.fill_diagonal(d, np.inf)
        med = np.median(d.min(1))
        dens = min(max((1 / (med + 1e-6) - 0.05) / 0.1, 0), 1)
        assert abs(got[g][0] - min(max(20 * med, 0.5), 20.0)) < 0.05
        assert got[g][1] == (max(3, len(X) // 2) if len(X) < 60 else int(3 + dens * 6))


def test_groups_with_their_own_eps_match_single_runs(spark):
    pts, rows = _planes(spark)
    own = {0: (3.0, 4), 1: (12.0, 4), 2: (2.0, 3)}
    params = spark.createDataFrame([(g, e, m) for g, (e, m) in own.items()], "g int, eps_km double, min_samples int")
    got = {r["pdv_id"]: r["cluster_id"] for r in dbscan(pts, by=("g",), params=params).collect()}
    assert len(got) == len(rows)  # the group without any cluster keeps its points, label 0
    assert {got[r[0]] for r in rows if r[1] == 2} == {0}
    for g in (1,):
        alone = dbscan(pts.where(f"g = {g}"), *own[g]).collect()
        assert {r["pdv_id"]: r["cluster_id"] for r in alone} == {r[0]: got[r[0]] for r in rows if r[1] == g}
