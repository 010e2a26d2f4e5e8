"""Invariants of the iterative clustering operators (no closed SQL form)."""

from pyspark.sql import functions as F

from conftest import SF_MED, SF_SMALL

import __spark_entry__ as E
from territoria.functions.geo import haversine_km
from territoria.sources import fixtures as fx


def test_kmeans_capacity_invariants(spark):
    out = E.queries()["kmeans_capacity"](spark, SF_MED)
    pts = fx.points(spark, SF_MED)
    assert out.count() == pts.count()
    assert out.select("pdv_id").distinct().count() == pts.count()
    sizes = out.groupBy("zona", "cluster_id").count()
    k = out.groupBy("zona").agg(F.max("k_final").alias("k"), F.countDistinct("cluster_id").alias("used"))
    # every zone uses at most k labels, all labels inside 0..k-1
    assert k.filter(F.col("used") > F.col("k")).count() == 0
    assert out.filter((F.col("cluster_id") < 0) | (F.col("cluster_id") >= F.col("k_final"))).count() == 0
    # zones that did not hit the try limit respect the capacity
    n = pts.groupBy("zona").count().withColumnRenamed("count", "n")
    chk = sizes.join(k, "zona").join(n, "zona")
    bad = chk.filter((F.col("count") > 20) & (F.col("k") < F.ceil(F.col("n") / 20.0) + 7))
    assert bad.count() == 0


def test_balance_invariants(spark):
    out = E.queries()["balance_fixed_centres"](spark, SF_MED)
    pts = fx.points(spark, SF_MED)
    assert out.count() == pts.count()                      # no point lost or duplicated
    assert out.select("pdv_id").distinct().count() == pts.count()
    cen = fx.centers(spark, SF_MED)
    j = out.join(pts.select("pdv_id", "lat", "lon"), "pdv_id").join(
        cen.select("centro_id", F.col("lat").alias("clat"), F.col("lon").alias("clon")), "centro_id")
    assert j.count() == pts.count()                        # every label is a real centre
    # start sizes vs final sizes: balancing never makes the largest cluster larger
    from territoria.operators.spatial import nearest
    start = nearest(pts, cen, "centro_id").groupBy("centro_id").count().agg(F.max("count")).first()[0]
    final = out.groupBy("centro_id").count().agg(F.max("count")).first()[0]
    assert final <= start


def test_cep_clusters_by_time(spark):
    out = E.queries()["cep_clusters_by_time"](spark, SF_MED)
    # every CEP with clients appears once; outlier flag is exactly "beyond the time limit"
    assert out.count() == out.select("cep").distinct().count()
    assert out.filter(F.col("is_outlier") != (F.col("tempo_min") > 40.0)).count() == 0
    k = out.groupBy("tenant_id").agg(F.max("k_final").alias("k"), F.countDistinct("cluster_id").alias("u"))
    assert k.filter(F.col("u") > F.col("k")).count() == 0


def test_recluster_and_balanced(spark):
    from conftest import SF_SMALL
    rec = E.queries()["recluster_recursive"](spark, SF_SMALL)
    assert rec.count() == fx.points(spark, SF_SMALL).count()
    assert rec.select("pdv_id").distinct().count() == rec.count()
    st = E.queries()["kmeans_balanced"](spark, SF_SMALL)
    assert st.agg(F.sum("n_pdvs")).first()[0] == fx.points(spark, SF_SMALL).count()
    assert set(r[0] for r in st.select("status").distinct().collect()) <= {"OK", "EXCEDIDO"}


def test_run_clustering_sectors(spark):
    from conftest import SF_SMALL
    sec = E.queries()["run_clustering"](spark, SF_SMALL)
    assert sec.agg(F.sum("n_pdvs")).first()[0] == fx.points(spark, SF_SMALL).count()
    assert sec.filter(F.col("dist_max_km") < F.col("distancia_media_km")).count() == 0


def test_balance_ceps_merges_small_centres(spark):
    out = E.queries()["balance_ceps"](spark, SF_MED)
    sizes = out.groupBy("centro_id").count()
    assert out.count() == out.select("cep").distinct().count()
    assert sizes.filter(F.col("count") < 8).count() == 0


def test_active_balanced_sectors(spark):
    from conftest import SF_SMALL
    sec = E.queries()["active_balanced"](spark, SF_SMALL)
    assert sec.agg(F.sum("n_pdvs")).first()[0] == fx.points(spark, SF_SMALL).count()
    ids = [r[0] for r in sec.select("cluster_id").collect()]
    assert sorted(ids) == list(range(len(ids)))


def test_purge_keeps_other_tenants(spark):
    from territoria.operators.tables import purge_level
    pts = fx.points(spark, SF_SMALL)
    out = purge_level({"pdvs": pts, "cluster_setor_pdv": pts, "historico_pdv_jobs": pts}, "clusterization", 1)
    assert out["cluster_setor_pdv"].filter(F.col("tenant_id") == 1).count() == 0
    assert out["pdvs"].count() == pts.count()                # preprocessing level not reached
    assert out["historico_pdv_jobs"].count() == pts.count()  # histories are kept


def test_recluster_ends_and_marks_what_cannot_be_split(spark):
    from territoria.operators.clustering import recluster_recursive
    rows = [(i, 1, 0, -10.0, -40.0) for i in range(9)] + [(100 + i, 1, 1, -10.0 - 0.1 * (i % 3), -41.0) for i in range(12)]
    p = spark.createDataFrame(rows, "pdv_id long, t long, zona long, lat double, lon double")
    out = recluster_recursive(p, ["t"], "zona", 5, 60.0, 35.0)
    assert out.count() == 21
    n = {(r["cluster_label"], r["status"]): r["count"] for r in out.groupBy("cluster_label", "status").count().collect()}
    assert n[("0", "EXCEDIDO")] == 9  # all in one place
    assert all(v <= 5 for (lab, s), v in n.items() if s == "OK") and all(lab == "0" for lab, s in n if s != "OK")
