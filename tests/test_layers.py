"""Edge cases of route paths, stop orders of the user's, snapshots, histories and bubbles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from territoria.operators import layers as L
from territoria.operators import routing as R
from territoria.operators import tables as T
from territoria.plans import reports

ROUTE = ["c", "s"]


def _paths(spark, stops, depot, cache=None):
    seq = spark.createDataFrame([(1, 1, i + 1, *p) for i, p in enumerate(stops)], "c int, s int, sequencia_ordem int, lat double, lon double")
    dep = spark.createDataFrame([(1, *depot)], "c int, lat double, lon double")
    costed = R.leg_costs(R.route_legs(seq, dep, ROUTE, ["c"]), cache, 30.0, 1.3)
    return [(r["lat"], r["lon"]) for r in R.route_paths(costed, dep, ROUTE, ["c"]).orderBy("ponto").collect()]


def test_path_without_stored_ways_goes_over_both_ends_of_each_leg(spark):
    assert _paths(spark, [(1.0, 1.0), (2.0, 2.0)], (0.0, 0.0)) == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (2.0, 2.0), (2.0, 2.0), (0.0, 0.0)]


def test_path_of_identical_points_begins_and_ends_at_the_centre(spark):
    assert _paths(spark, [(0.0, 0.0), (0.0, 0.0)], (0.0, 0.0)) == [(0.0, 0.0)] * 4
    # a repeated stop gives no vertices of its own
    assert _paths(spark, [(1.0, 1.0), (1.0, 1.0)], (0.0, 0.0)) == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_stored_way_that_misses_the_centre_is_closed(spark):
    cache = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 1.0, 5.0, 6.0, [(0.5, 0.0), (1.0, 1.0)]), (1.0, 1.0, 0.0, 0.0, 5.0, 6.0, [(1.0, 1.0), (0.2, 0.2)])],
        "origem_lat double, origem_lon double, destino_lat double, destino_lon double, distancia_km double, tempo_min double, "
        "rota_coord array<struct<lat:double,lon:double>>")
    assert _paths(spark, [(1.0, 1.0)], (0.0, 0.0), cache) == [(0.0, 0.0), (0.5, 0.0), (1.0, 1.0), (1.0, 1.0), (0.2, 0.2), (0.0, 0.0)]


def test_solver_must_return_every_stop_once(spark):
    stops = spark.createDataFrame([(1, 1, i, float(i), 0.0) for i in range(4)], "c int, s int, pdv_id long, lat double, lon double")
    dep = spark.createDataFrame([(1, 0.0, 0.0)], "c int, lat double, lon double")
    back = R.sequence_stops(stops, dep, ROUTE, ["c"], solver=lambda d, ids, xy: np.argsort(-ids)).orderBy("sequencia_ordem").collect()
    assert [r["pdv_id"] for r in back] == [3, 2, 1, 0]
    with pytest.raises(Exception, match="every position"):
        R.sequence_stops(stops, dep, ROUTE, ["c"], solver=lambda d, ids, xy: [0, 0, 1, 2]).collect()


def test_restore_without_a_snapshot_changes_nothing(spark):
    live = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "tenant_id long, rota string, v int")
    heads = spark.createDataFrame([(1, "s1", "m", "2024-01-01"), (1, "s2", "m", "2024-02-01"), (1, "s3", "vazio", "2024-03-01")],
                                  "tenant_id long, snapshot_id string, nome string, criado_em string")
    frozen = spark.createDataFrame([("s1", "old", 1), ("s2", "new", 2)], "snapshot_id string, rota string, v int")

    def rows(tenant, name):
        return sorted(map(tuple, T.restore_snapshot(live, frozen, heads, tenant, name).collect()))
    assert rows(1, "m") == [(1, "new", 2), (2, "b", 20)]
    assert rows(1, "vazio") == rows(1, "outro") == rows(2, "m") == [(1, "a", 10), (2, "b", 20)]


def test_history_filters_and_totals(spark):
    jobs = spark.createDataFrame([(i, 1, f"c{i % 3}", f"Carga {i}", "done", f"2024-01-{i + 1:02d}") for i in range(9)] + [(99, 2, "c0", "Carga 1", "done", "2024-01-01")],
                                 "id long, tenant_id long, clusterization_id string, descricao string, status string, d string")
    jobs = jobs.withColumn("criado_em", F.to_timestamp("d"))
    runs = spark.createDataFrame([(1, 1, "c0", "done", "2024-01-01"), (2, 1, "c0", "error", "2024-01-02"), (3, 1, "c1", "done", "2024-01-01")],
                                 "run_id long, tenant_id long, clusterization_id string, status string, criado_em string")
    sectors = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "run_id long, n_pdvs long")
    page = reports.clustering_history(jobs, runs, sectors, 1, "2024-01-02", "2024-01-08", None, limit=4, offset=1).orderBy(F.col("id").desc()).collect()
    assert [r["id"] for r in page] == [6, 5, 4, 3] and {r["total"] for r in page} == {7}
    assert {r["clusterization_id"]: (r["qtd_clusters"], r["pdvs_total"]) for r in page} == {"c0": (1, 5), "c1": (0, 0), "c2": (0, 0)}
    done = reports.finished_clusterings(runs, sectors, 1).collect()
    assert {(r["clusterization_id"], r["run_id"], r["qtd_clusters"], r["pdvs_total"]) for r in done} == {("c0", 1, 2, 30), ("c1", 3, 0, 0)}
    assert reports.clustering_history(jobs, runs, sectors, 1, text="nada").count() == 0


def test_bubbles_and_spread(spark):
    ceps = spark.createDataFrame([(1, "01", 100, 0, ""), (1, "02", 5, 2, None), (1, "03", 0, 0, "Centro")],
                                 "cluster_id int, cep string, clientes_total long, clientes_target long, cluster_bairro string")
    ceps = ceps.withColumns({"cluster_lat": F.lit(1.0), "cluster_lon": F.lit(2.0), "dist_km": F.lit(0.0), "tempo_min": F.lit(0.0)})
    rows = {r["cep"]: r for r in L.cep_bubble_layer(ceps).collect()}
    assert [rows[c]["tamanho"] for c in ("01", "02", "03")] == pytest.approx([12.0, 4.2, 3.0])
    assert [rows[c]["bairro"] for c in ("01", "02", "03")] == ["N/D", "N/D", "Centro"]
    assert {(r["cluster_total"], r["cluster_target"]) for r in rows.values()} == {(105, 2)}
    moved = L.cep_bubble_layer(ceps, spread=True).collect()
    assert all(abs(r["lat"] - 1.0) <= 0.010 and abs(r["lon"] - 2.0) <= 0.010 for r in moved) and len({r["lat"] for r in moved}) == 3
