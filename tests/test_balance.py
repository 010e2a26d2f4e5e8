"""The balancing target of every mover equals the brute-force choice."""

import numpy as np

from territoria.operators.clustering import _best_target


def _km(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


def test_best_target_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    cen = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(np.round(rng.normal(-23, 0.4, 120), 2), np.round(rng.normal(-46, 0.4, 120), 2)))]
    cen += [(500, cen[3][1], cen[3][2])]  # two centres in one place
    movers = [(i, float(a), float(b), int(s), cen[s][1], cen[s][2]) for i, (a, b, s) in
              enumerate(zip(rng.normal(-23, 0.6, 400), rng.normal(-46, 0.6, 400), rng.integers(0, 120, 400)))]
    M = spark.createDataFrame(movers, "pdv_id long, lat double, lon double, src long, _slat double, _slon double")
    C = spark.createDataFrame(cen, "label long, lat double, lon double")
    for merge in (None, 30.0):
        got = {r["pdv_id"]: r["dst"] for r in _best_target(M, C, 40.0, 35.0, 3.0, merge).collect()}
        want = {}
        for i, la, lo, _, sa, so in movers:
            fit = [(_km(la, lo, a, b), c) for c, a, b in cen if _km(la, lo, a, b) / 35.0 * 60.0 <= 40.0 and (merge is None or _km(sa, so, a, b) <= merge)]
            if fit:
                want[i] = min(fit)[1]
        assert got == want and 0 < len(want) < 400


def test_targets_are_not_paired_with_all_points_in_reach(spark, monkeypatch):
    """No radius join in the balancing: its pairs grow with points times centres."""
    from territoria.operators import clustering
    assert not hasattr(clustering, "pairs_within")


def test_rounds_in_a_task_equal_the_rounds_as_jobs(spark, monkeypatch):
    """Ids and centres that repeat or are null, points without coordinates; and only a few tables are kept on the way."""
    from collections import Counter

    from territoria.operators import clustering

    rng = np.random.default_rng(9)
    cen = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(-23, 0.3, 24), rng.normal(-46, 0.3, 24)))]
    pts = [(i, float(a), float(b), int(s)) for i, (a, b, s) in
           enumerate(zip(rng.normal(-23, 0.3, 260), rng.normal(-46, 0.3, 260), np.minimum(rng.integers(0, 24, 260), rng.integers(0, 24, 260))))]
    odd = [pts[0], pts[7], (None, -23.1, -46.1, 1), (None, -23.2, -46.0, 1), (900, None, None, 0), (901, -23.0, -46.0, None), (902, -23.0, -46.0, 77)]
    kept = []
    real = clustering.cut_lineage
    monkeypatch.setattr(clustering, "cut_lineage", lambda df: kept.append(1) or real(df))
    few = [(i, a, b, s % 9) for i, a, b, s in pts[:130]]
    for p, c in ((pts, cen), (few + odd, [*cen[:9], cen[2], (None, -23.0, -46.0), (50, None, -46.0)])):
        P, C = spark.createDataFrame(p, "pdv_id long, lat double, lon double, label long"), spark.createDataFrame(c, "label long, lat double, lon double")
        found = []
        for local in (0, None):
            kept.clear()
            a, left = clustering.balance_points(P, C, 7, 14, 60.0, 35.0, 50.0, rounds=2, local=local)
            found.append((Counter(map(tuple, a.collect())), Counter(map(tuple, left.collect())), a.columns, left.columns))
        assert len(kept) <= 4
        assert found[0] == found[1] and found[0][0] != Counter(p)
