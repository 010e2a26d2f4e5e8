"""Streams equal their batch twins (T-01, T-02)."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL

from territoria.sources import fixtures as fx
from territoria.streaming import stream as S


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_job_state_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="t02-")
    src = os.path.join(base, "src")
    jl = fx.job_log(spark, SF_SMALL).withColumn("criado_em", F.col("criado_em").cast("timestamp"))
    # four files whose events interleave in time
    for i in range(4):
        jl.filter(F.col("id") % 4 == i).coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
        time.sleep(0.05)
    files = os.path.join(base, "flat")
    os.makedirs(files)
    for i in range(4):
        d = os.path.join(src, f"part{i}")
        for f in os.listdir(d):
            if f.endswith(".parquet"):
                os.rename(os.path.join(d, f), os.path.join(files, f"f{i}.parquet"))
    q = S.job_state_stream(spark, files, os.path.join(base, "table"), os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = S.read_latest(spark, os.path.join(base, "table"), S.STATE_SCHEMA)
    want = S._fix_state_cols(S.job_state(jl))
    assert got.count() == want.count()
    assert _rows(got.select(*S.STATE_COLS)) == _rows(want.select(*S.STATE_COLS))


def test_ingest_stream_equals_sequential_batches(spark):
    base = tempfile.mkdtemp(prefix="t01-")
    src = os.path.join(base, "src")
    os.makedirs(src)
    raw = fx.points_raw(spark, SF_SMALL).toPandas()
    parts = [raw.iloc[i::3] for i in range(3)]
    for i, p in enumerate(parts):
        p.to_csv(os.path.join(src, f"sheet{i}.csv"), sep=";", index=False)
        os.utime(os.path.join(src, f"sheet{i}.csv"), (1_700_000_000 + i, 1_700_000_000 + i))
    table = os.path.join(base, "table")
    q = S.ingest_stream(spark, src, table, os.path.join(base, "ckpt"))
    q.awaitTermination(300)
    got = S.read_latest(spark, table, "row_id long")
    # batch twin: the same files applied one after another
    stored = spark.createDataFrame([], got.schema)
    for p in parts:
        sheet = spark.createDataFrame(p.astype(object).where(p.notna(), None), S.SHEET_SCHEMA)
        stored = S.ingest_batch(stored, sheet)
    assert _rows(got.select(*S.STORED_COLS)) == _rows(stored.select(*S.STORED_COLS))
    # a restart with the same checkpoint adds nothing
    before = got.count()
    q2 = S.ingest_stream(spark, src, table, os.path.join(base, "ckpt"))
    q2.awaitTermination(300)
    assert S.read_latest(spark, table, "row_id long").count() == before


def _upsert(cur, b):
    return S.T.upsert(cur, b, ["k"], ["x"])


def test_leaves_hold_the_table_and_split(spark):
    """Batches of random keys equal a dictionary; a replay changes nothing; an old state is still
    read; a small batch writes little however large the table has grown."""
    path = tempfile.mkdtemp(prefix="leaves-")
    schema, want, size = "k long, x long", {}, {}
    for i, (lo, n) in enumerate([(0, 500), (200, 1500), (5000, 3000), (0, 4), (9000, 3000), (1, 4)]):
        rows = {lo + j * 3: i * 100 + j for j in range(n)}
        if i == 3:
            rows[None] = 7
        batch = spark.createDataFrame(list(rows.items()), schema)
        before = _rows_of(S.read_latest(spark, path, schema))
        for _ in range(2):  # the second time is a replay
            S.update_table(spark, path, i, batch, ["k"], _upsert, schema, leaf_rows=100)
        assert _rows_of(S.read_latest(spark, path, schema, before=i)) == before
        want.update(rows)
        assert _rows_of(S.read_latest(spark, path, schema)) == _rows_of_dict(want)
        written = os.path.join(path, "data", f"v={i}")
        size[i] = spark.read.parquet(written).count()
    leaves = S._manifest(spark, path, 5).collect()
    assert len(leaves) > 32 and max(r["n"] for r in leaves) <= 300
    assert sum(2.0 ** -r["depth"] for r in leaves) == 1.0  # every hash has one leaf
    assert size[5] <= 4 * 300 and size[3] <= 5 * 300
    assert S._manifests(spark, path) == [4, 5]  # older ones and what only they named are gone
    named = {(r["version"], r["depth"], r["bits"]) for m in (4, 5) for r in S._manifest(spark, path, m).filter("n > 0").collect()}
    there = set()
    for root, _, names in os.walk(os.path.join(path, "data")):
        if any(x.endswith(".parquet") for x in names):
            v, d, b = root.split(os.sep)[-3:]
            there.add((int(v[2:]), int(d.split("=")[1]), int(b.split("=")[1])))
    assert there == named


def test_empty_batch_keeps_the_table(spark):
    path = tempfile.mkdtemp(prefix="leaves-")
    S.update_table(spark, path, 0, spark.createDataFrame([(1, 2)], "k long, x long"), ["k"], _upsert, "k long, x long")
    S.update_table(spark, path, 1, spark.createDataFrame([], "k long, x long"), ["k"], _upsert, "k long, x long")
    assert _rows_of(S.read_latest(spark, path, "k long, x long")) == [(1, 2)]


def _rows_of(df):
    return sorted(map(tuple, df.select("k", "x").collect()), key=repr)


def _rows_of_dict(d):
    return sorted(d.items(), key=repr)
