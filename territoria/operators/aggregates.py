"""Group metrics (A-01..A-19) as built-in aggregate compositions.

All aggregates are algebraic (count/sum/min/max/avg) or Spark's exact
`percentile`, so partial aggregation runs map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, travel_min


def _percentile_from_ranks(r: DataFrame, keys: list[str], value: str, p: float, n_col: str, out: str) -> DataFrame:
    pos = (F.col(n_col) - 1) * F.lit(float(p))
    lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1
    g = r.filter((F.col("_rk") == lo) | (F.col("_rk") == hi)).groupBy(*keys, n_col).agg(
        F.max(F.when(F.col("_rk") == lo, F.col(value))).alias("_lo"),
        F.max(F.when(F.col("_rk") == hi, F.col(value))).alias("_hi"))
    frac = pos - F.floor(pos)
    return g.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
                    .otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(out))


def exact_percentile(df: DataFrame, keys, value: str, p: float, tie: str, out: str) -> DataFrame:
    """Exact percentile with linear interpolation (as `percentile` / `quantile_cont`)
    per key, from the skew-safe distributed rank: a key holding a third of all
    rows is sorted across many tasks, never gathered into one buffer."""
    from .windows import ranked
    keys = list(keys)
    r = ranked(df.filter(F.col(value).isNotNull()).select(*keys, value, tie), keys, [value, tie], out="_rk")
    n = r.groupBy(*keys).agg(F.max("_rk").alias("_n"))
    return _percentile_from_ranks(r.join(n, keys), keys, value, p, "_n", out)


def cluster_metrics(assigned: DataFrame, keys: list[str] | tuple[str, ...], kmh: float,
                    dist_col: str = "dist_km", digits: int = 3, tie: str = "pdv_id") -> DataFrame:
    """A-01: n, mean/max km, mean/max minutes, exact p95 (linear interpolation).

    Everything comes from one range-partitioned, sorted copy of (key, distance):
    the input is shuffled once, the hot key is spread over many tasks, and the
    count/mean/max aggregate and the p95 picks both read that one exchange.
    """
    from .windows import ranked
    keys = list(keys)
    r = ranked(assigned.select(*keys, dist_col, tie), keys, [dist_col, tie], out="_rk")
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pdvs"), F.avg(dist_col).alias("_mean"),
                             F.max(dist_col).alias("_max"))
    p95 = _percentile_from_ranks(r.join(g.select(*keys, "n_pdvs"), keys), keys, dist_col, 0.95, "n_pdvs", "_p95")
    g = g.join(p95, keys, "left")
    return g.select(*keys, "n_pdvs",
                    F.round("_mean", digits).alias("distancia_media_km"),
                    F.round("_max", digits).alias("dist_max_km"),
                    F.round(travel_min(F.col("_mean"), kmh), digits).alias("tempo_medio_min"),
                    F.round(travel_min(F.col("_max"), kmh), digits).alias("tempo_max_min"),
                    F.round("_p95", digits).alias("raio_p95_km"))


def weighted_centroid(df: DataFrame, keys, w: str, lat: str = "lat", lon: str = "lon",
                      digits: int = 6) -> DataFrame:
    """A-04: sum(w*x)/sum(w); plain mean when the weights sum to 0."""
    sw = F.sum(F.col(w))
    g = df.groupBy(*keys).agg(sw.alias("_sw"),
                              F.sum(F.col(w) * F.col(lat)).alias("_swl"), F.sum(F.col(w) * F.col(lon)).alias("_swo"),
                              F.avg(lat).alias("_al"), F.avg(lon).alias("_ao"))
    return g.select(*keys,
                    F.round(F.when(F.col("_sw") == 0, F.col("_al")).otherwise(F.col("_swl") / F.col("_sw")), digits)
                    .alias("centro_lat"),
                    F.round(F.when(F.col("_sw") == 0, F.col("_ao")).otherwise(F.col("_swo") / F.col("_sw")), digits)
                    .alias("centro_lon"))


def bbox_diameter(df: DataFrame, keys, lat: str = "lat", lon: str = "lon", digits: int = 3) -> DataFrame:
    """A-15: bounding box and its diagonal in km."""
    g = df.groupBy(*keys).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"),
                              F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"))
    return g.withColumn("diametro_km", F.round(haversine_km("lat_min", "lon_min", "lat_max", "lon_max"), digits))


def zscore_threshold(df: DataFrame, col: str, z: float, keys=()) -> DataFrame:
    """A-14: mean + z * population std, as a scalar (or per key) joined back."""
    stat = (F.avg(col) + F.lit(float(z)) * F.stddev_pop(col)).alias("limiar")
    if keys:
        return df.join(df.groupBy(*keys).agg(stat), list(keys))
    return df.withColumn("limiar", F.lit(df.agg(stat).first()[0]))  # one scalar to the driver


def normalised_weight(df: DataFrame, w: str, keys=()) -> DataFrame:
    """A-16: w / max(w) joined back from a grouped max (not an unpartitioned window)."""
    if keys:
        j = df.join(df.groupBy(*keys).agg(F.max(w).alias("_wmax")), list(keys))
    else:
        j = df.withColumn("_wmax", F.lit(df.agg(F.max(w)).first()[0]))  # one scalar
    return j.withColumn("peso_norm", F.col(w) / F.col("_wmax")).drop("_wmax")


def safe_ratio(a, b, digits: int) -> Column:
    """P-35: round(a / nullif(b, 0), digits)."""
    ac = F.col(a) if isinstance(a, str) else a
    bc = F.col(b) if isinstance(b, str) else b
    return F.round(ac / F.nullif(bc, F.lit(0)), digits)


def rollup_sector_metrics(sectors: DataFrame, sub: str = "subclusters", stored: str = "metrics",
                          digits: int = 3) -> DataFrame:
    """A-19: sector minutes/km from its sub-clusters when it has any (mean and max
    over the array), else the stored values; the stored metric map is merged
    with the new values, blank entries dropped.  Array and map functions only:
    one row per sector, no explode."""
    arr = F.coalesce(F.col(sub), F.array())
    n = F.size(arr)
    tempos = F.transform(arr, lambda s: s["tempo_total_min"])
    dists = F.transform(arr, lambda s: s["dist_total_km"])

    def mean(a, scale):
        # sub-cluster values carry 1 (minutes) / 2 (km) decimals: sum them as integers,
        # then round the mean half-up to 3 decimals, independent of array order
        units = F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + F.round(x * scale, 0).cast("long"))
        return F.floor((2 * units * (1000 // scale) + n) / (2 * n).cast("double")) / F.lit(1000.0)
    has = n > 0
    st = F.col(stored)
    tm = F.when(has, mean(tempos, 10)).otherwise(st["tempo_medio_min"])
    tx = F.when(has, F.array_max(tempos)).otherwise(st["tempo_max_min"])
    dm = F.when(has, mean(dists, 100)).otherwise(st["distancia_media_km"])
    dx = F.when(has, F.array_max(dists)).otherwise(st["dist_max_km"])
    new = F.create_map(F.lit("tempo_medio_min"), tm, F.lit("tempo_max_min"), tx,
                       F.lit("distancia_media_km"), dm, F.lit("dist_max_km"), dx)
    merged = F.map_filter(F.map_concat(F.map_filter(st, lambda k, v: ~F.map_contains_key(new, k)), new),
                          lambda k, v: v.isNotNull())
    return sectors.select("*", F.round(tm, digits).alias("tempo_medio_min"), F.round(tx, digits).alias("tempo_max_min"),
                          F.round(dm, digits).alias("distancia_media_km"), F.round(dx, digits).alias("dist_max_km"),
                          F.size(merged).alias("n_metricas"))
