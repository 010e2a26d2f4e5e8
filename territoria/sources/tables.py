"""Reads of stored tables (S-02..S-05, S-08, S-09) as filtered, pruned scans.

Every read takes the tenant first (F-08): on the partitioned Parquet layout
(`tenant_id=`/`input_id=`) the filter prunes directories before any file is
opened, and the select list prunes columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import valid_coord


def _and(conds):
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def scan_points(points: DataFrame, tenant_id: int, input_id: str | None = None, uf: str | None = None,
                cidade: str | None = None, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """S-02: points of one tenant (optionally input/state/city, case-insensitive),
    with invalid coordinates dropped; also (n_total, n_invalid, n_duplicate_coords)
    as a one-row DataFrame computed in the same pass."""
    f = points.filter(_and([
        F.col("tenant_id") == F.lit(tenant_id),
        F.col("input_id") == F.lit(input_id) if input_id else None,
        F.upper(F.col("uf")) == F.upper(F.lit(uf)) if uf else None,
        F.upper(F.col("cidade")) == F.upper(F.lit(cidade)) if cidade else None]))
    ok = valid_coord(F.col(lat), F.col(lon))
    good = f.filter(ok)
    # duplicates = valid rows minus distinct 6-decimal coordinates, in one aggregate
    counts = f.agg(F.count(F.lit(1)).alias("n_total"),
                   F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("n_invalidas"),
                   (F.sum(F.when(ok, 1).otherwise(0))
                    - F.count_distinct(F.when(ok, F.struct(F.round(lat, 6), F.round(lon, 6))))).cast("long")
                   .alias("n_coords_duplicadas"))
    return good, counts


def scan_ceps(marketplace: DataFrame | None, points: DataFrame | None, use_marketplace: bool,
              tenant_id: int, uf: str | None = None, cidade: str | None = None) -> DataFrame:
    """S-03/S-04/S-05: CEP weights from the marketplace table, or each point as
    one client; one output schema either way."""
    cols = ["tenant_id", "uf", "cidade", "cep", "lat", "lon", "clientes_total", "clientes_target"]
    if use_marketplace:
        src = marketplace
    else:
        src = points.withColumn("clientes_total", F.lit(1).cast("long")).withColumn(
            "clientes_target", F.lit(1).cast("long"))
    f = src.filter(_and([F.col("tenant_id") == F.lit(tenant_id),
                         F.upper(F.col("uf")) == F.upper(F.lit(uf)) if uf else None,
                         F.upper(F.col("cidade")) == F.upper(F.lit(cidade)) if cidade else None]))
    return f.select(*cols)


def latest_run(runs: DataFrame, uf: str | None = None, match: dict | None = None, status: str = "done") -> DataFrame:
    """S-09: newest run with the status; the columns of `match` (a run's city, say) are matched null-safely (F-05)."""
    f = runs.filter(F.col("status") == status)
    if uf is not None:
        f = f.filter(F.col("uf") == uf)
    for column, value in (match or {}).items():
        f = f.filter(F.col(column).eqNullSafe(F.lit(value)))
    return f.orderBy(F.col("id").desc()).limit(1)


def scan_clusters(clusters: DataFrame, points: DataFrame, tenant_id: int, run_id: int) -> tuple[DataFrame, DataFrame]:
    """S-08: a clustering read back for routing: sectors by label, members by sector and point."""
    c = clusters.filter((F.col("tenant_id") == tenant_id) & (F.col("run_id") == run_id)).orderBy("cluster_label")
    p = points.filter((F.col("tenant_id") == tenant_id) & (F.col("run_id") == run_id)).orderBy("cluster_id", "pdv_id")
    return c, p


def awaiting_validation(points: DataFrame, tenant_id: int, limit: int | None = None) -> DataFrame:
    """F-07: points that have coordinates and no geo-validation status yet (a work queue page)."""
    f = points.filter((F.col("tenant_id") == tenant_id) & F.col("pdv_lat").isNotNull() & F.col("pdv_lon").isNotNull()
                      & F.col("geo_validacao_status").isNull()).orderBy("id")
    return f.limit(limit) if limit else f
