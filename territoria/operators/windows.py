"""Window-style operators (W-01..W-08) that stay correct when one key is hot.

`ranked` gives a dense 1..n rank per group without a per-group window: rows
are range-partitioned on (group, order keys), sorted inside each partition,
and each row's rank is its partition offset (from a small per-partition count
table) plus its position inside the partition.  A group holding a third of
all rows is then spread over many tasks instead of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def ranked(df: DataFrame, group: list[str], order: list, out: str = "rn",
           partitions: int | None = None) -> DataFrame:
    """Row number 1..n per `group` in `order` (which must end in a unique id).

    The range-partitioned rows are checkpointed once and both uses (positions
    and per-partition counts) read that copy.  Two plans of the same range
    exchange need not agree: after column pruning they are sampled apart and
    their bounds differ, which would lose rows and shift ranks.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = cut_lineage(s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    stats = s.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_mid0"))
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1) if group else \
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # `stats` has one row per (partition, group): small, so this window is cheap.
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # Null-safe on the group, so rows of the null group keep their ranks too.
    stats = stats.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_off", "_mid0")
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Plain join: AQE broadcasts it at run time when its measured size is small.
    j = s.join(stats, on).drop("_p", *[f"_g{i}" for i in range(len(group))])
    return j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_mid0") + 1).cast("long")) \
        .drop("_pid", "_mid", "_off", "_mid0")


def chunk(df: DataFrame, group: list[str], order: list, cap: int, out: str = "chunk") -> DataFrame:
    """W-06: fixed-size chunks of an ordered list: floor((rank - 1) / cap)."""
    r = ranked(df, group, order, out="_rk")
    return r.withColumn(out, F.floor((F.col("_rk") - 1) / F.lit(float(cap))).cast("int")).drop("_rk")


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """W-01: newest row per key (ts desc, then id desc), as `max_by` on a struct.

    An aggregate, not a window: partial aggregation keeps one row per key per
    task before the shuffle, so a hot key costs nothing extra.
    """
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.col(tie))).alias("_r"))
    return g.select(*keys, *[F.col("_r." + c).alias(c) for c in cols])


def duplicate_flag(df: DataFrame, key: str, out: str = "duplicado") -> DataFrame:
    """W-03: every copy of a repeated key (keep=False), via grouped count joined back."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(c, key, "left").withColumn(out, F.col("_n") > 1).drop("_n")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """W-04: first row per key by arrival order (min of `order`)."""
    cols = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, *[F.col("_r." + c).alias(c) for c in cols])


def dense_relabel(df: DataFrame, label: str, group: list[str] | None = None, out: str = "cluster_id") -> DataFrame:
    """W-07: labels renumbered 0..k-1 (per group) in label order.

    The distinct labels are ranked with the distributed rank and joined back
    by key.
    """
    group = group or []
    d = df.select(*group, label).distinct()
    # distinct labels: their row number is the dense rank (skew-safe, no global window)
    d = ranked(d, group, [label], out="_dr").select(*group, label, (F.col("_dr") - 1).cast("int").alias(out))
    return df.join(d, [*group, label])


def stop_legs(stops: DataFrame, route: list[str], seq: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """W-08: next stop of each stop along a route (`lead`), null after the last."""
    w = Window.partitionBy(*route).orderBy(seq)
    return (stops.withColumn("next_lat", F.lead(lat).over(w))
            .withColumn("next_lon", F.lead(lon).over(w)))
