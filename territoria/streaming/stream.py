"""Structured Streaming paths (T-01 file-drop ingest, T-02 job state).

Both sinks are `foreachBatch` updates of a Parquet table that is kept in leaves
of its keys' hash.  A leaf holds the rows whose hash ends in certain bits; when it
grows past `LEAF_ROWS` rows it is split on further bits, so a micro-batch that
touches few keys rewrites few rows however large the table is:

    data/v=<batch>/leaf_depth=<d>/leaf_bits=<b>/   rows of a leaf, as that batch wrote it
    manifest/m=<batch>/                            for every leaf: depth, bits, version, rows

A batch reads the manifest before its own, applies the pure update function to the
leaves it touches, writes them under its own version and then its manifest, whose
`_SUCCESS` is the commit.  A replayed batch starts from the same manifest and
rewrites the same files; a reader always sees a complete manifest.  Leaves that
neither of the last two manifests names are removed after the commit.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import tables as T
from ..operators.quality import clean_points_raw, split_valid, validate_points

JOB_LOG_SCHEMA = ("id long, tenant_id long, job_id string, input_id string, status string, "
                  "validos long, criado_em timestamp")
SHEET_SCHEMA = ("row_id long, cnpj string, logradouro string, numero string, bairro string, cidade string, "
                "uf string, cep string, pdv_vendas string")


# ------------------------------------------------------------ table of leaves
LEAF_ROWS = 200_000
MANIFEST = "depth int, bits long, version long, n long"


def _folder(spark: SparkSession, path: str):
    """The path and its Hadoop file system, so HDFS and object stores work as local folders do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """Batches with a complete manifest."""
    root, fs = _folder(spark, f"{path.rstrip('/')}/manifest")
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        m = re.fullmatch(r"m=(\d+)", st.getPath().getName())
        if m and fs.exists(_folder(spark, f"{st.getPath().toString()}/_SUCCESS")[0]):
            out.append(int(m.group(1)))
    return sorted(out)


def _manifest(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest/m={batch_id}")


def _leaf(path: str, depth: int, bits: int, version: int) -> str:
    return f"{path.rstrip('/')}/data/v={version}/leaf_depth={depth}/leaf_bits={bits}"


def _read_leaves(spark: SparkSession, path: str, leaves, schema) -> DataFrame:
    files = [_leaf(path, r["depth"], r["bits"], r["version"]) for r in leaves if r["n"] > 0]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_latest(spark: SparkSession, path: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """The table as of the newest manifest (below `before`, where given); empty, with the
    columns of `schema`, where there is none.  The leaves' names go through the driver: some
    numbers for every `LEAF_ROWS` rows or so."""
    vs = [v for v in _manifests(spark, path) if before is None or v < before]
    leaves = _manifest(spark, path, vs[-1]).filter("n > 0").collect() if vs else []
    files = [_leaf(path, r["depth"], r["bits"], r["version"]) for r in leaves]
    return spark.read.parquet(*files) if files else spark.createDataFrame([], schema)


def _in_leaves(df: DataFrame, keys: list[str], depths: list[int]) -> DataFrame:
    """Every row once for each depth in use, with the bits it has there; a join with the leaves
    on (depth, bits) keeps exactly one."""
    d = df.withColumn("_h", F.xxhash64(*keys)).withColumn("depth", F.explode(F.array(*[F.lit(x) for x in depths])))
    return d.withColumn("bits", F.expr("_h & (shiftleft(1L, depth) - 1L)"))


def update_table(spark: SparkSession, path: str, batch_id: int, batch: DataFrame, keys: list[str],
                 update: Callable[[DataFrame, DataFrame], DataFrame], schema: str | StructType,
                 leaf_rows: int = LEAF_ROWS) -> None:
    """Apply `update(rows of the touched leaves, batch)` and commit it as batch `batch_id`.

    `batch` has the key columns; the update must decide every key from the rows of that key
    alone and may not lose rows it was given.  Rows with the same key share a leaf, so equal
    keys are never looked for elsewhere.  The driver sees the touched leaves' names only.
    """
    done = [v for v in _manifests(spark, path) if v < batch_id]
    old = _manifest(spark, path, done[-1]) if done else spark.createDataFrame([(0, 0, -1, 0)], MANIFEST)
    depths = [r[0] for r in old.select("depth").distinct().collect()]
    batch = batch.persist()
    hit = _in_leaves(batch.select(*keys).distinct(), keys, depths).select("depth", "bits").distinct()
    touched = old.join(hit, ["depth", "bits"], "left_semi").collect()
    if not touched:  # nothing came: the table stays as it is under a new manifest
        old.write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest/m={batch_id}")
        batch.unpersist()
        return _forget(spark, path, batch_id)
    new = update(_read_leaves(spark, path, touched, schema), batch)
    cols = new.columns
    own = spark.createDataFrame([(r["depth"], r["bits"]) for r in touched], "depth int, bits long")
    new = _in_leaves(new, keys, sorted({r["depth"] for r in touched})).join(own, ["depth", "bits"], "left_semi").persist()
    sizes = own.join(new.groupBy("depth", "bits").agg(F.count(F.lit(1)).alias("n")), ["depth", "bits"], "left")
    further = F.greatest(F.lit(0), F.ceil(F.log2(F.coalesce("n", F.lit(0)) / F.lit(float(leaf_rows))))).cast("int")
    sizes = sizes.select("depth", "bits", (F.col("depth") + F.when(F.col("n") > 0, further).otherwise(0)).alias("leaf_depth"))
    out = new.join(sizes, ["depth", "bits"]).withColumn("leaf_bits", F.expr("_h & (shiftleft(1L, leaf_depth) - 1L)"))
    (out.select(*cols, "leaf_depth", "leaf_bits").repartition("leaf_depth", "leaf_bits")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("leaf_depth", "leaf_bits")
     .parquet(f"{path.rstrip('/')}/data/v={batch_id}"))
    held = out.groupBy("leaf_depth", "leaf_bits").agg(F.count(F.lit(1)).alias("n"))
    # all leaves a touched one was split into, those without rows as well, so that every hash has one
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, leaf_depth - depth) - 1L")))
    fresh = (sizes.withColumn("_i", split).withColumn("leaf_bits", F.expr("bits | shiftleft(_i, depth)"))
             .join(held, ["leaf_depth", "leaf_bits"], "left").select(
                 F.col("leaf_depth").cast("int").alias("depth"), F.col("leaf_bits").alias("bits"),
                 F.when(F.col("n") > 0, F.lit(batch_id)).otherwise(-1).cast("long").alias("version"), F.coalesce("n", F.lit(0)).cast("long").alias("n")))
    (old.join(own, ["depth", "bits"], "left_anti").select("depth", "bits", "version", "n").unionByName(fresh)
     .write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest/m={batch_id}"))
    new.unpersist()
    batch.unpersist()
    _forget(spark, path, batch_id)


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove the manifests before the last two and the leaves that only those name."""
    done = [v for v in _manifests(spark, path) if v <= batch_id]
    keep, gone = done[-2:], done[:-2]
    for v in gone:
        names = _manifest(spark, path, v).filter("n > 0")
        for k in keep:
            names = names.join(_manifest(spark, path, k), ["depth", "bits", "version"], "left_anti")
        for r in names.toLocalIterator():
            p, fs = _folder(spark, _leaf(path, r["depth"], r["bits"], r["version"]))
            fs.delete(p, True)
        p, fs = _folder(spark, f"{path.rstrip('/')}/manifest/m={v}")
        fs.delete(p, True)


# ------------------------------------------------------------------- T-02
STATE_COLS = ["job_id", "dia", "status", "ultimo_id", "inicio", "fim", "n_eventos", "duracao_s"]
STATE_SCHEMA = ("job_id string, dia timestamp, status string, ultimo_id long, inicio timestamp, fim timestamp, "
                "n_eventos long, duracao_s double")


def job_state(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Latest status and duration per (job, day window); one stateful aggregate.

    Batch and stream share this code; in a stream the watermark bounds the
    state (windows older than it are finalised and dropped).
    """
    e = events.withColumn("ts", F.col("criado_em").cast("timestamp"))
    if watermark:
        e = e.withWatermark("ts", watermark)
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "job_id").agg(
        F.max_by(F.struct("status", "id"), F.struct("ts", "id")).alias("_last"),
        F.min("ts").alias("inicio"), F.max("ts").alias("fim"), F.count(F.lit(1)).alias("n_eventos"))
    return g.select("job_id", F.col("w.start").alias("dia"), F.col("_last.status").alias("status"),
                    F.col("_last.id").alias("ultimo_id"), "inicio", "fim", "n_eventos",
                    (F.unix_micros("fim") - F.unix_micros("inicio")).cast("double") / F.lit(1e6))


def _fix_state_cols(df: DataFrame) -> DataFrame:
    return df.toDF(*STATE_COLS)


def job_state_stream(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str,
                     watermark: str = "400 days", max_files: int = 1):
    """T-02: stream job-log files into the job-state table (update mode)."""
    src = (spark.readStream.schema(JOB_LOG_SCHEMA).option("maxFilesPerTrigger", max_files)
           .parquet(source_dir))
    agg = _fix_state_cols(job_state(src, watermark))

    key = ["job_id", "dia"]

    def upsert_batch(batch: DataFrame, batch_id: int) -> None:
        update_table(spark, table_path, batch_id, batch, key,
                     lambda cur, b: T.upsert(cur, b, key, [c for c in STATE_COLS if c not in key]), STATE_SCHEMA)

    return (agg.writeStream.outputMode("update").foreachBatch(upsert_batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ------------------------------------------------------------------- T-01
STORED_COLS = ["row_id", "cnpj", "logradouro", "numero", "bairro", "cidade", "uf", "cep", "pdv_vendas",
               "pdv_endereco_completo", "endereco_cache_key"]


def ingest_batch(stored: DataFrame, sheet: DataFrame) -> DataFrame:
    """One file's worth of C-02 without geocoding: clean, validate against the
    stored rows (file-level duplicate rule inside the batch only), insert-ignore."""
    return _ingest_clean(stored, clean_points_raw(sheet))


def _ingest_clean(stored: DataFrame, clean: DataFrame) -> DataFrame:
    valid, _ = split_valid(validate_points(clean, existing=stored.select("cnpj")))
    return T.insert_ignore(stored, valid.select(*STORED_COLS), ["cnpj"], order="row_id")


def ingest_stream(spark: SparkSession, source_dir: str, table_path: str, checkpoint: str, max_files: int = 1):
    """T-01: new sheet files (CSV, `;`, header) -> cleaned, validated, insert-ignored."""
    src = (spark.readStream.schema(SHEET_SCHEMA).option("header", True).option("sep", ";")
           .option("maxFilesPerTrigger", max_files).csv(source_dir))
    empty_schema = clean_points_raw(spark.createDataFrame([], SHEET_SCHEMA)).select(*STORED_COLS).schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        update_table(spark, table_path, batch_id, clean_points_raw(batch), ["cnpj"], _ingest_clean, empty_schema)

    return (src.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
