"""Table maintenance as pure functions `(current, delta) -> new` (K-01..K-10, K-14..K-16).

Parquet has no row update: each mutation computes the new table and the
caller writes it with `write_slice` (dynamic partition overwrite), so a retry
after a lost executor rewrites the same partitions with the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_per_key(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """Within-batch dedupe, first row per key wins (an aggregate, hot-key safe)."""
    if order is None:
        return rows.dropDuplicates(key)
    cols = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*key, *[F.col("_r." + c).alias(c) for c in cols])


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """K-01: `INSERT ... ON CONFLICT DO NOTHING` — stored rows win, then the first new row."""
    new = _first_per_key(rows, key, order).select(*target.columns)
    return target.unionByName(new.join(target.select(*key), key, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, key: list[str], cols: list[str],
           order: str | None = None) -> DataFrame:
    """K-03: `INSERT ... ON CONFLICT (key) DO UPDATE SET cols`: new keys are
    inserted whole; existing keys get only `cols` from the new row."""
    return _merge(target, rows, key, cols, None, None, order)


def upsert_guarded(target: DataFrame, rows: DataFrame, key: list[str], cols: list[str],
                   guard: Column, reject: Column | None = None, order: str | None = None) -> DataFrame:
    """K-02: like `upsert`, but a stored row for which `guard` holds (e.g. a
    manual edit) is never overwritten; `reject` filters bad new rows first."""
    return _merge(target, rows, key, cols, guard, reject, order)


def _merge(target, rows, key, cols, guard, reject, order):
    new = rows.filter(~reject) if reject is not None else rows
    new = _first_per_key(new, key, order)
    other = [c for c in target.columns if c not in key]
    n = new.select(*key, *[(F.col(c) if c in new.columns else F.lit(None)).alias("_n_" + c) for c in other],
                   F.lit(True).alias("_hit"))
    t = target.withColumn("_old", F.lit(True))
    t = t.withColumn("_locked", F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(False))
    j = t.join(n, key, "full_outer")
    is_new = F.col("_old").isNull()
    take = F.col("_hit") & ~F.coalesce(F.col("_locked"), F.lit(False))
    out = [F.col(c) for c in key]
    for c in other:
        if c in cols:
            out.append(F.when(is_new | take, F.col("_n_" + c)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(is_new, F.col("_n_" + c)).otherwise(F.col(c)).alias(c))
    return j.select(*out).select(*target.columns)


def replace_slice(target: DataFrame, rows: DataFrame, slice_cols: list[str]) -> DataFrame:
    """K-06: delete the slices present in `rows`, then insert `rows`."""
    slices = rows.select(*slice_cols).distinct()
    return target.join(slices, slice_cols, "left_anti").unionByName(rows.select(*target.columns))


def update_from(target: DataFrame, src: DataFrame, on: list[str], set_cols: list[str],
                only_where_null: str | None = None) -> DataFrame:
    """K-07: `UPDATE t SET c = s.c FROM s WHERE t.k = s.k [AND t.x IS NULL]`
    (`src` de-duplicated on `on` first, so the join never fans out)."""
    s = (src.select(*on, *[F.col(c).alias("_s_" + c) for c in set_cols]).dropDuplicates(on)
         .withColumn("_m", F.lit(True)))
    j = target.join(s, on, "left")
    matched = F.coalesce(F.col("_m"), F.lit(False))
    if only_where_null:
        matched = matched & F.col(only_where_null).isNull()
    out = [F.when(matched, F.col("_s_" + c)).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
           for c in target.columns]
    return j.select(*out)


def delete_cascade(points: DataFrame, cache: DataFrame, flagged: DataFrame, pid: str,
                   cache_key: str, point_key: str) -> tuple[DataFrame, DataFrame]:
    """K-08: drop flagged points and the cache rows of their (non-null) keys."""
    keys = (points.join(flagged.select(pid), pid, "left_semi")
            .select(F.col(point_key).alias(cache_key)).filter(F.col(cache_key).isNotNull()).distinct())
    return (points.join(flagged.select(pid), pid, "left_anti"),
            cache.join(keys, cache_key, "left_anti"))


def append_membership(assign: DataFrame, cluster_col: str, cnpj: str = "cnpj") -> DataFrame:
    """K-16: point -> sector rows; rows without a sector skipped; blank CNPJ -> null."""
    return (assign.filter(F.col(cluster_col).isNotNull())
            .withColumn(cnpj, F.nullif(F.trim(F.col(cnpj)), F.lit(""))))


def with_ids(rows: DataFrame, current_max: int, order: list[str], id_col: str = "id") -> DataFrame:
    """K-05: deterministic ids `max(id) + rank` (the `RETURNING id` of a batch insert)."""
    from .windows import ranked
    return ranked(rows, [], order, out="_rk").withColumn(id_col, F.lit(int(current_max)) + F.col("_rk")).drop("_rk")


def snapshot(rows: DataFrame, snapshot_id, name, tags: list[str] | None = None) -> DataFrame:
    """K-14: frozen copy of routes under a name and tags.  The id and the name are one value
    each, or columns of `rows` where several snapshots are taken at once."""
    def value(v):
        return v if isinstance(v, Column) else F.lit(v)
    return (rows.withColumn("snapshot_id", value(snapshot_id)).withColumn("nome", value(name))
            .withColumn("tags", F.array(*[F.lit(t) for t in (tags or [])]).cast("array<string>")))


def list_snapshots(headers: DataFrame, tenant_id: int, uf: str | None = None, cidade: str | None = None) -> DataFrame:
    """K-14: a tenant's snapshots, of one state or city where given, newest first (ties by id)."""
    h = headers.filter(F.col("tenant_id") == F.lit(tenant_id))
    if uf:
        h = h.filter(F.col("uf") == F.lit(uf))
    if cidade:
        h = h.filter(F.col("cidade") == F.lit(cidade))
    return (h.select("snapshot_id", "nome", "descricao", "criado_em", "tags", "uf", "cidade")
            .orderBy(F.col("criado_em").desc(), F.col("snapshot_id").desc()))


def restore_snapshot(live: DataFrame, frozen: DataFrame, headers: DataFrame, tenant_id: int, name: str) -> DataFrame:
    """K-14: the tenant's live rows replaced by those of its snapshot of that name, the newest
    where several have it (ties by id).  Other tenants keep their rows.  Where the tenant has
    no such snapshot, or the snapshot holds no rows, everything stays as it is."""
    chosen = (headers.filter((F.col("tenant_id") == F.lit(tenant_id)) & (F.col("nome") == F.lit(name)))
              .agg(F.max_by("snapshot_id", F.struct("criado_em", "snapshot_id")).alias("snapshot_id")))
    back = frozen.join(chosen, "snapshot_id", "left_semi").withColumn("tenant_id", F.lit(tenant_id).cast(live.schema["tenant_id"].dataType))
    emptied = back.agg(F.max("tenant_id").alias("tenant_id"))  # null, which equals none, where nothing comes back
    return live.join(emptied, "tenant_id", "left_anti").select(*live.columns).unionByName(back.select(*live.columns))


def write_slice(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Idempotent write: dynamic partition overwrite of exactly the slices in `df`."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).parquet(path))


def append_log(df: DataFrame, path: str) -> None:
    """K-15: history rows that are only ever added."""
    df.write.mode("append").parquet(path)


def upsert_clean_ceps(target: DataFrame, rows: DataFrame, key: list[str], update_cols: list[str],
                      order: str, cep: str = "cep", cluster: str = "cluster_id") -> DataFrame:
    """K-04: keep rows with an 8-digit CEP, valid coordinates and a cluster; first
    row per key wins; existing keys get `update_cols` only (client counts stay)."""
    from ..functions.geo import valid_coord
    ok = rows.filter(F.col(cep).rlike(r"^[0-9]{8}$") & valid_coord(F.col("lat"), F.col("lon"))
                     & F.col(cluster).isNotNull())
    first = _first_per_key(ok, key, order)
    return upsert(target, first.select(*target.columns), key, update_cols)


def manual_edit(target: DataFrame, edits: DataFrame, key: list[str], cols: list[str],
                stamp_col: str = "origem", stamp: str = "manual_edit") -> DataFrame:
    """K-10: edits applied by key (the key includes the tenant, so edits never
    cross tenants) and stamped so later automatic writes leave them alone."""
    e = edits.select(*key, *cols).dropDuplicates(key).withColumn(stamp_col, F.lit(stamp))
    hit = target.join(e.select(*key), key, "left_semi")
    rest = target.join(e.select(*key), key, "left_anti")
    changed = hit.drop(*cols, stamp_col).join(e, key)
    return rest.unionByName(changed.select(*target.columns))


# Tables emptied by each purge level.
PURGE_LEVELS = {
    "assign_vendedores": ["sales_vendedor_base"],
    "routing": ["sales_subcluster_pdv", "sales_subcluster", "sales_vendedor_base"],
    "clusterization": ["sales_subcluster_pdv", "sales_subcluster", "cluster_setor_pdv", "cluster_setor", "cluster_run", "sales_vendedor_base"],
    "preprocessing": ["sales_subcluster_pdv", "sales_subcluster", "cluster_setor_pdv", "cluster_setor", "cluster_run", "sales_vendedor_base"],
}


def purge_level(tables: dict[str, DataFrame], level: str, tenant_id: int | None = None) -> dict[str, DataFrame]:
    """K-09: remove a tenant's rows (no tenant: all rows) from the tables of a level.

    Source points, caches, snapshots and histories are in no level.
    """
    if level not in PURGE_LEVELS:
        raise ValueError(f"unknown purge level {level}")

    def emptied(df: DataFrame) -> DataFrame:
        if tenant_id is None:
            return df.limit(0)
        return df.filter(~F.col("tenant_id").eqNullSafe(F.lit(tenant_id)))

    return {name: emptied(df) if name in PURGE_LEVELS[level] else df for name, df in tables.items()}
