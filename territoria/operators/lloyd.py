"""Grouped Lloyd k-means in DataFrame operations (C-05..C-08).

One job clusters every group at once (a group can be a city, a parent
cluster, or a (group, candidate k) pair).  State is two tables:
points(group, id, lat, lon) and centres(group, c, lat, lon).  Distances are
squared degrees, as in the reference's k-means on raw coordinates.

* init: inside each group rank points by (lon, lat, id) with the skew-safe
  distributed rank, cut into k equal tiles, centre = mean of each tile;
* assign: centres of a group travel as one small array (k entries) joined to
  its points by the group key; the arg-min over (d2, c) is an array
  expression, so points are never grouped or shuffled by point;
* update: `avg` per (group, c), rounded to 6 decimals; an empty cluster keeps
  its centre;
* groups of at most `LOCAL_POINTS` points, counted first, run all their rounds in one task
  each, many groups at once; larger groups run the rounds as jobs over all tasks;
* stop when the centres of every group moved by at most `TOLERANCE` of the group's
  variance (squared shifts against the mean variance of the coordinates); `MAX_ROUNDS`
  is the user's limit.  Groups that have come to rest leave the rounds.  The centre
  table, with the verdict on each group, is checkpointed to the shared folder every
  round, so lineage stays short and a round is one job over the points.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.geo import haversine_km
from ..session import cut_lineage
from .windows import ranked

DIGITS = 6
MAX_ROUNDS = 300
TOLERANCE = 1e-4
LOCAL_POINTS = 250_000  # points (about 50 bytes each) up to which a group's rounds run in one task; counted before
BLOCK = 256  # points whose centres are looked for together
BROADCAST_CENTRES = 50_000  # centre rows (about 40 bytes each) up to which they are broadcast; counted before


def init_centres(points: DataFrame, k: DataFrame, group: list[str], pid: str = "pdv_id") -> DataFrame:
    """k tiles per group along (lon, lat, id); `k` has columns group + `k`."""
    n = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    r = ranked(points.select(*group, pid, "lat", "lon"), group, ["lon", "lat", pid], out="_rk")
    r = r.join(n, group).join(k, group)
    tile = F.floor((F.col("_rk") - 1) * F.col("k") / F.col("_n")).cast("int")
    return (r.withColumn("c", tile).groupBy(*group, "c")
            .agg(F.round(F.avg("lat"), DIGITS).alias("lat"), F.round(F.avg("lon"), DIGITS).alias("lon")))


ARRAY_K_MAX = 64  # up to this many centres per group the arg-min runs over one small array


def assign(points: DataFrame, centres: DataFrame, group: list[str], out: str = "c",
           k_max: int | None = None, edge: float | None = None, small: bool = False, inner: bool = False) -> DataFrame:
    """Nearest centre of the point's own group by squared degrees (ties -> smaller c).

    Few centres per group: the group's centres travel as one array and the
    arg-min is an array expression.  Many centres: an exact planar grid
    (`assign_grid`), so a point only meets the centres of nearby cells.

    `small` says that all centres together are few enough to broadcast, so that
    the points are not shuffled; with `inner`, points of groups without centres
    are left out.
    """
    if k_max is None:
        k_max = centres.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if k_max > ARRAY_K_MAX:
        if inner:
            points = points.join(centres.select(*group).distinct(), group, "left_semi")
        return assign_grid(points, centres, group, out, edge=edge)
    arr = centres.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("c", F.col("lat").alias("clat"),
                                                                           F.col("lon").alias("clon")))).alias("_cs"))
    return nearest_of_array(points.join(F.broadcast(arr) if small else arr, group, "inner" if inner else "left"), out)


def nearest_of_array(joined: DataFrame, out: str = "c") -> DataFrame:
    """The arg-min over the centres in `_cs` as `out`, its squared distance as `_d2`."""
    best = F.array_min(F.transform("_cs", lambda e: F.struct(
        (F.pow(F.col("lat") - e["clat"], 2) + F.pow(F.col("lon") - e["clon"], 2)).alias("d2"), e["c"].alias("c"))))
    return joined.withColumn(out, best["c"]).withColumn("_d2", best["d2"]).drop("_cs")


def grid_edge(centres: DataFrame, group: list[str]) -> tuple[float, float]:
    """(cell edge, span) in degrees: about 8 centres per occupied cell, from measured occupancy."""
    import math
    st = centres.agg(F.count(F.lit(1)).alias("n"), (F.max("lat") - F.min("lat")).alias("a"),
                     (F.max("lon") - F.min("lon")).alias("b")).first()
    span = max(st["a"] or 0.0, st["b"] or 0.0, 1e-6)
    s = max(math.sqrt(span * span * 4.0 / max(1, st["n"])), 1e-6)
    for _ in range(6):
        occ = (centres.groupBy(*group, F.floor(F.col("lat") / s).alias("_a"), F.floor(F.col("lon") / s).alias("_b"))
               .count().agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("o")).first()["o"] or 0)
        if occ <= 8.0:
            break
        s = max(s * math.sqrt(8.0 / occ), 1e-6)
    return s, span


def assign_grid(points: DataFrame, centres: DataFrame, group: list[str], out: str = "c",
                edge: tuple[float, float] | None = None) -> DataFrame:
    """Exact planar nearest centre on a lat/lon grid.

    Centres are copied into the 3x3 cells around their own; a point reads the
    candidate array of its cell.  A centre outside that block is at least one
    cell edge away, so a best squared distance below edge^2 is proven; other
    points retry with edges x4, and the last level puts the whole group in one
    cell.
    """
    s, span = edge if edge is not None else grid_edge(centres, group)
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cols = points.columns
    cur, parts = points, []
    while True:
        final = s >= 4 * span
        if final:
            cells = centres.groupBy(*group).agg(F.collect_list(F.struct("c", F.col("lat").alias("clat"),
                                                                        F.col("lon").alias("clon"))).alias("_cs"))
            j = cur.join(cells, group, "left")
        else:
            cc = (centres.withColumn("_o", F.explode(offs))
                  .withColumn("_gi", F.floor(F.col("lat") / s) + F.col("_o.i"))
                  .withColumn("_gj", F.floor(F.col("lon") / s) + F.col("_o.j")))
            cells = cc.groupBy(*group, "_gi", "_gj").agg(
                F.collect_list(F.struct("c", F.col("lat").alias("clat"), F.col("lon").alias("clon"))).alias("_cs"))
            j = (cur.withColumn("_gi", F.floor(F.col("lat") / s)).withColumn("_gj", F.floor(F.col("lon") / s))
                 .join(cells, [*group, "_gi", "_gj"], "left"))
        best = F.array_min(F.transform(F.coalesce("_cs", F.array()), lambda e: F.struct(
            (F.pow(F.col("lat") - e["clat"], 2) + F.pow(F.col("lon") - e["clon"], 2)).alias("d2"), e["c"].alias("c"))))
        scored = j.withColumn("_b", best)
        ok = F.lit(True) if final else F.coalesce(F.col("_b.d2") < F.lit(s * s), F.lit(False))
        parts.append(scored.filter(ok).select(*cols, F.col("_b.c").alias(out), F.col("_b.d2").alias("_d2")))
        if final:
            break
        rest = scored.filter(~ok).select(*cols)
        if rest.isEmpty():
            break
        cur = cut_lineage(rest)
        s *= 4.0
    res = parts[0]
    for p_ in parts[1:]:
        res = res.unionByName(p_)
    return res


def means(assigned: DataFrame, group: list[str], weight: str | None = None, label: str = "c") -> DataFrame:
    """group, c, _nlat, _nlon: (weighted) mean of each cluster's points."""
    g = assigned.groupBy(*group, F.col(label).alias("c"))
    if not weight:
        return g.agg(F.round(F.avg("lat"), DIGITS).alias("_nlat"), F.round(F.avg("lon"), DIGITS).alias("_nlon"))
    w = F.col(weight)
    s = g.agg(F.sum(w).alias("_sw"), F.sum(w * F.col("lat")).alias("_swl"), F.sum(w * F.col("lon")).alias("_swo"),
              F.avg("lat").alias("_al"), F.avg("lon").alias("_ao"))
    return s.select(*group, "c", F.round(F.when(F.col("_sw") > 0, F.col("_swl") / F.col("_sw")).otherwise(F.col("_al")), DIGITS).alias("_nlat"),
                    F.round(F.when(F.col("_sw") > 0, F.col("_swo") / F.col("_sw")).otherwise(F.col("_ao")), DIGITS).alias("_nlon"))


def update(assigned: DataFrame, old: DataFrame, group: list[str], label: str = "c",
           weight: str | None = None, small: bool = False) -> DataFrame:
    """New centre = (weighted) mean of the cluster's points, and its squared shift; empty clusters keep theirs."""
    new = means(assigned, group, weight, label)
    j = old.join(F.broadcast(new) if small else new, [*group, "c"], "left")
    shift = F.coalesce(F.pow(F.col("_nlat") - F.col("lat"), 2) + F.pow(F.col("_nlon") - F.col("lon"), 2), F.lit(0.0))
    return j.select(*group, "c", F.coalesce("_nlat", "lat").alias("lat"), F.coalesce("_nlon", "lon").alias("lon"), shift.alias("_shift"))


def kmeans(points: DataFrame, k: DataFrame, group: list[str], pid: str = "pdv_id", max_iter: int = MAX_ROUNDS,
           fixed_iter: bool = False, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run grouped Lloyd; returns (points with `c`, centres).

    With `fixed_iter` every round runs (no convergence test), which is what
    the SQL oracle unrolls.
    """
    # The rounds re-read the points many times: materialise the narrow input once
    # (as iterative MLlib estimators cache theirs) instead of re-running its plan.
    # Each round costs a distance a centre and point, far more than its bytes: spread by
    # count, since adaptive coalescing by bytes would leave few tasks.
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pts = cut_lineage(points.select(*group, pid, "lat", "lon", *([weight] if weight else [])).repartition(spread))
    sizes = cut_lineage(pts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    known = " and ".join(f"`{g}` is not null" for g in group)  # a null key has no k and so no centre
    few = sizes.where(known).agg(F.count(F.lit(1)), F.count_if(F.col("_n") > LOCAL_POINTS)).first()
    if not few[1]:
        return _kmeans_local(pts, k, group, pid, max_iter, fixed_iter, weight, spread, few[0])
    if few[0] == few[1]:
        return _kmeans_rounds(pts, k, group, pid, max_iter, fixed_iter, weight)
    large = sizes.where(known).where(F.col("_n") > LOCAL_POINTS).select(*group)
    parts = [_kmeans_rounds(pts.join(large, group, "left_semi"), k.join(large, group, "left_semi"), group, pid, max_iter, fixed_iter, weight),
             _kmeans_local(pts.join(large, group, "left_anti"), k, group, pid, max_iter, fixed_iter, weight, spread, few[0] - few[1])]
    (a, ca), (b, cb) = parts
    return a.unionByName(b), ca.unionByName(cb)


def _kmeans_rounds(pts: DataFrame, k: DataFrame, group: list[str], pid: str, max_iter: int, fixed_iter: bool,
                   weight: str | None) -> tuple[DataFrame, DataFrame]:
    """Every round is one job over all points."""
    cen = cut_lineage(init_centres(pts, k, group, pid))
    size = cen.agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c")).first()
    k_max, small = (size["c"] or 0) + 1, size["n"] <= BROADCAST_CENTRES
    edge = grid_edge(cen, group) if k_max > ARRAY_K_MAX else None  # centres move little: size cells once
    slack = None if fixed_iter else cut_lineage(pts.groupBy(*group).agg(
        (F.lit(TOLERANCE / 2) * (F.var_pop("lat") + F.var_pop("lon"))).alias("_slack")))
    if small:
        cen = _rounds_with_small_centres(pts, cen, slack, group, max_iter, fixed_iter, weight)
        return assign(pts, cen, group, k_max=k_max, edge=edge, small=True), cen
    settled = []
    for _ in range(max_iter):
        a = assign(pts, cen, group, k_max=k_max, edge=edge, small=small, inner=True)
        new = update(a, cen, group, weight=weight, small=small)
        if fixed_iter:
            cen = cut_lineage(new.drop("_shift"))
            continue
        moved = F.sum("_shift").over(Window.partitionBy(*group)) > F.col("_slack")
        new = cut_lineage(new.join(F.broadcast(slack) if small else slack, group).withColumn("_moving", moved).drop("_shift", "_slack"))
        moving, still = (new.agg(F.count_if("_moving"), F.count_if(~F.col("_moving"))).first())
        if still:
            settled.append(new.filter(~F.col("_moving")).drop("_moving"))
        cen = (new.filter("_moving") if still else new).drop("_moving")
        if not moving:
            break
    for s in settled:  # groups that have come to rest; when the rounds ran out, `cen` holds the others
        cen = cen.unionByName(s)
    if settled:
        cen = cut_lineage(cen)
    final = assign(pts, cen, group, k_max=k_max, edge=edge, small=small)
    return final, cen


def half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Rounded to `digits` decimals, halves away from zero, as Spark's `round` does."""
    scale = 10.0 ** digits
    scaled = np.abs(x) * scale
    out = np.copysign(np.floor(scaled + 0.5) / scale, x)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):  # near a half the decimal digits decide
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def point_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, boxes): the points in blocks of about BLOCK near ones: strips along x cut along y."""
    n = len(x)
    strips = max(1, math.isqrt(n // BLOCK))
    order = np.argsort(x, kind="stable")
    starts = []
    for lo, hi in zip(np.arange(strips) * n // strips, (np.arange(strips) + 1) * n // strips):
        order[lo:hi] = order[lo:hi][np.argsort(y[order[lo:hi]], kind="stable")]
        starts.extend(range(lo, hi, BLOCK))
    at = np.array(starts, np.int64)
    xo, yo = x[order], y[order]
    boxes = np.stack([f.reduceat(v, at) for v in (xo, yo) for f in (np.minimum, np.maximum)], 1) if n else np.empty((0, 4))
    return order, at, boxes


def nearest_centres(x: np.ndarray, y: np.ndarray, cs: np.ndarray, blocks=None) -> np.ndarray:
    """Position of each point's nearest centre, the first of equals.

    With many centres each block of points meets only those that can be the nearest of one
    of its points: their least distance to the block's box does not exceed the smallest of
    all centres' largest distances to it.
    """
    near = np.empty(len(x), np.int64)
    if len(cs) <= 24 or len(x) <= BLOCK or np.isnan(cs).any():
        step = max(1, 2_000_000 // len(cs))  # distances held at once
        for at in range(0, len(x), step):
            here = slice(at, at + step)
            near[here] = ((x[here, None] - cs[:, 0]) ** 2 + (y[here, None] - cs[:, 1]) ** 2).argmin(1)
        return near
    order, starts, boxes = point_blocks(x, y) if blocks is None else blocks
    cx, cy = np.ascontiguousarray(cs[:, 0]), np.ascontiguousarray(cs[:, 1])
    ends = [*starts[1:], len(x)]
    step = max(1, 500_000 // len(cs))
    for first in range(0, len(starts), step):
        x0, x1, y0, y1 = (boxes[first:first + step, i, None] for i in range(4))
        ax, bx, ay, by = x0 - cx, cx - x1, y0 - cy, cy - y1
        least = np.maximum(np.maximum(ax, bx), 0.0) ** 2 + np.maximum(np.maximum(ay, by), 0.0) ** 2
        most = (np.maximum(-ax, -bx) ** 2 + np.maximum(-ay, -by) ** 2).min(1)
        may = least <= most[:, None] * (1 + 1e-9)
        for b in range(len(may)):
            rows = order[starts[first + b]:ends[first + b]]
            c = np.flatnonzero(may[b])
            near[rows] = c[((x[rows, None] - cx[c]) ** 2 + (y[rows, None] - cy[c]) ** 2).argmin(1)]
    return near


def _tiles_of(lat: np.ndarray, lon: np.ndarray, ids: pd.Series, k: int) -> dict[int, tuple[float, float]]:
    """The first centres of one group, as `init_centres` has them."""
    n = len(lat)
    order = pd.DataFrame({"a": lon, "b": lat, "c": ids.to_numpy()}).sort_values(["a", "b", "c"], na_position="first", kind="stable").index.to_numpy()
    tile = np.floor(np.arange(n, dtype=np.int64) * k / n).astype(np.int64)
    means = []
    for v in (lat[order], lon[order]):
        has = ~np.isnan(v)
        with np.errstate(invalid="ignore", divide="ignore"):
            means.append(half_up(np.bincount(tile[has], v[has], k) / np.bincount(tile[has], minlength=k)))
    return {int(c): (means[0][c], means[1][c]) for c in np.unique(tile)}


def lloyd_of_group(lat: np.ndarray, lon: np.ndarray, w: np.ndarray | None, ids: pd.Series, k: int, max_iter: int, fixed_iter: bool):
    """(label of each point, its squared distance, labels, centres) of one group, all rounds."""
    found = _tiles_of(lat, lon, ids, k)
    names, cs = np.array(list(found), np.int64), np.array(list(found.values()), float)
    has = ~(np.isnan(lat) | np.isnan(lon))
    x, y, v = lat[has], lon[has], None if w is None else np.nan_to_num(w[has])
    limit = 0.0
    if not fixed_iter and (~np.isnan(lat)).any() and (~np.isnan(lon)).any():
        limit = TOLERANCE / 2 * (np.nanvar(lat) + np.nanvar(lon))
    blocks = point_blocks(x, y)
    for _ in range(max_iter if len(x) else 0):
        near = nearest_centres(x, y, cs, blocks)
        n = np.bincount(near, minlength=len(cs))
        used = np.flatnonzero(n)
        sums = [np.bincount(near, z, len(cs))[used] for z in (x, y)]
        new = np.stack([s / n[used] for s in sums], 1)
        if v is not None:
            total = np.bincount(near, v, len(cs))[used]
            heavy = total > 0
            for i, z in enumerate((x, y)):
                new[heavy, i] = np.bincount(near, v * z, len(cs))[used][heavy] / total[heavy]
        new = half_up(new.ravel()).reshape(new.shape)
        shift = ((new - cs[used]) ** 2).sum()
        cs[used] = new
        if not fixed_iter and not shift > limit:
            break
    label, d2 = np.zeros(len(lat), np.int64), np.full(len(lat), np.nan)
    if len(x):
        label[has] = nearest_centres(x, y, cs, blocks)
        at = cs[label[has]]
        d2[has] = (x - at[:, 0]) ** 2 + (y - at[:, 1]) ** 2
    return names[label], d2, names, cs


def _kmeans_local(pts: DataFrame, k: DataFrame, group: list[str], pid: str, max_iter: int, fixed_iter: bool, weight: str | None,
                  spread: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """All rounds of a group in one task; the groups, of at most LOCAL_POINTS points each, are spread over the tasks."""
    extra = [weight] if weight else []
    # no key column may be called as one of these
    keys = [f"_g{i}" for i in range(len(group))]
    named = pts.select(*[F.col(g).alias(n) for g, n in zip(group, keys)], F.col(pid).alias("_id"), F.col("lat").cast("double").alias("_lat"),
                       F.col("lon").cast("double").alias("_lon"), *[F.col(x).alias("_w") for x in extra])
    tiles = k.select(*[F.col(g).alias(n) for g, n in zip(group, keys)], F.col("k").cast("long").alias("_k"))
    rows = named.join(tiles, keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"{n} {types[n]}" for n in [*keys, "_id"]]) + ", _lat double, _lon double, c int, _d2 double, _centre boolean" \
        + "".join(f", _w {types['_w']}" for _ in extra)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon = pdf["_lat"].to_numpy(float), pdf["_lon"].to_numpy(float)
        w = pd.to_numeric(pdf["_w"]).to_numpy(float) if extra else None
        label, d2, names, cs = lloyd_of_group(lat, lon, w, pdf["_id"], int(pdf["_k"].iloc[0]), max_iter, fixed_iter)
        points = pdf.drop(columns="_k").assign(c=label.astype(np.int32), _d2=d2, _centre=False)
        centres = pd.DataFrame({**{n: [pdf[n].iloc[0]] * len(cs) for n in keys}, "_lat": cs[:, 0], "_lon": cs[:, 1], "c": names.astype(np.int32), "_centre": True})
        return pd.concat([points, centres.reindex(columns=points.columns).astype({"_centre": bool})], ignore_index=True)[
            [*keys, "_id", "_lat", "_lon", "c", "_d2", "_centre", *(["_w"] if extra else [])]]

    # by number, since adaptive coalescing by bytes would leave few tasks
    dealt = rows.repartition(max(spread, min(4 * groups, 512)), *keys)
    done = cut_lineage(dealt.groupBy(*keys).applyInPandas(run, schema=schema))
    back = [F.col(n).alias(g) for g, n in zip(group, keys)]
    out = done.where(~F.col("_centre")).select(*back, F.col("_id").alias(pid), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"),
                                               *[F.col("_w").alias(x) for x in extra], "c", "_d2")
    no_key = pts.where(" or ".join(f"`{g}` is null" for g in group)).withColumns({"c": F.lit(None).cast("int"), "_d2": F.lit(None).cast("double")})
    centres = done.where("_centre").select(*back, "c", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    return out.unionByName(no_key.select(*out.columns)), centres


_PART = "gi int, c int, n long, slat double, slon double, w double, wlat double, wlon double"


def partial_sums(batches, centres: list[np.ndarray]):
    """Rows (gi, lat, lon, weight), sorted by gi, to the sums of each centre's points, one row a centre and task.

    centres[gi] has the group's centres as rows; an empty array stands for a group at rest.
    """
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        gi, lat, lon, w = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(4))
        edges = np.flatnonzero(np.diff(gi)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(gi)]):
            cs = centres[gi[lo]] if hi > lo else np.empty((0, 2))
            if not len(cs):
                continue
            acc = sums.setdefault(int(gi[lo]), np.zeros((6, len(cs))))
            x, y, v = lat[lo:hi], lon[lo:hi], w[lo:hi]
            near = nearest_centres(x, y, cs)  # first, so smallest, c of ties
            for row, values in enumerate((None, x, y, v, v * x, v * y)):
                acc[row] += np.bincount(near, values, len(cs))
    for g, acc in sums.items():
        used = np.flatnonzero(acc[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), g, np.int32)), pa.array(used.astype(np.int32)), pa.array(acc[0][used].astype(np.int64)),
                                          *(pa.array(acc[i][used]) for i in range(1, 6))], names=["gi", "c", "n", "slat", "slon", "w", "wlat", "wlon"])


def _rounds_with_small_centres(pts: DataFrame, cen: DataFrame, slack: DataFrame | None, group: list[str], max_iter: int,
                               fixed_iter: bool, weight: str | None) -> DataFrame:
    """The rounds where all centres are at most BROADCAST_CENTRES rows: one job a round.

    As in any k-means, the centres are the model: they are sent to the tasks, which
    add their points up by centre, and the new means, one row a centre, come back.
    The points stay where they are; only sums are shuffled.
    """
    spark, k = pts.sparkSession, len(group)
    found: dict[tuple, dict[int, tuple[float, float]]] = {}
    for r in cen.select(*group, "c", "lat", "lon").collect():
        found.setdefault(tuple(r[:k]), {})[r["c"]] = (r["lat"], r["lon"])
    if not found:
        return cen
    groups = list(found)
    centres = [np.array([found[g][c] for c in sorted(found[g])], float) for g in groups]
    labels = [sorted(found[g]) for g in groups]
    keys = [StructField(f"_g{i}", pts.schema[g].dataType) for i, g in enumerate(group)]
    numbered = spark.createDataFrame([(*g, i) for i, g in enumerate(groups)], StructType([*keys, StructField("gi", IntegerType())]))
    on = [F.col(g) == F.col(f"_g{i}") for i, g in enumerate(group)]
    rows = pts.where("lat is not null and lon is not null").join(F.broadcast(numbered), on)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)
    rows = rows.select("gi", F.col("lat").cast("double"), F.col("lon").cast("double"), w.alias("w"))
    # strips of near points, so that a block of points meets few centres; the number spreads points of one place
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strips = rows.withColumn("_i", F.monotonically_increasing_id()).repartitionByRange(max(64, spread), "gi", "lon", "lat", "_i")
    rows = cut_lineage(strips.sortWithinPartitions("gi", "lat", "lon").drop("_i"))
    limit = {}
    if slack is not None:
        limit = {tuple(r[:k]): r["_slack"] for r in slack.select(*group, "_slack").collect()}
    moving = set(range(len(groups)))
    for _ in range(max_iter):
        if not moving:
            break
        shared = spark.sparkContext.broadcast([c if i in moving else c[:0] for i, c in enumerate(centres)])
        sums = rows.mapInArrow(lambda batches, shared=shared: partial_sums(batches, shared.value), _PART) \
            .groupBy("gi", "c").agg(*[F.sum(x).alias(x) for x in ("n", "slat", "slon", "w", "wlat", "wlon")])
        new = sums.select("gi", "c", *[F.round(F.when(F.col("w") > 0, F.col(f"w{x}") / F.col("w")).otherwise(F.col(f"s{x}") / F.col("n")), DIGITS)
                                       for x in ("lat", "lon")]).collect()
        shift = [0.0] * len(groups)
        for i, c, x, y in new:
            shift[i] += (x - centres[i][c][0]) ** 2 + (y - centres[i][c][1]) ** 2
            centres[i][c] = (x, y)
        shared.destroy()
        if not fixed_iter:
            moving = {i for i in moving if shift[i] > (limit[groups[i]] or 0.0)}
    out = [(*g, c, float(x), float(y)) for g, names, own in zip(groups, labels, centres) for c, (x, y) in zip(names, own)]
    schema = StructType([*[pts.schema[g] for g in group], StructField("c", IntegerType()), StructField("lat", DoubleType()), StructField("lon", DoubleType())])
    return spark.createDataFrame(out, schema)


def k_for_capacity(points: DataFrame, group: list[str], cap: int, freq: float = 1.0) -> DataFrame:
    """C-05: k = ceil(n / (cap * max(freq, 1))) per group."""
    return (points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
            .select(*group, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(cap) * max(freq, 1.0))))
                    .cast("int").alias("k")))


def k_for_radius(points: DataFrame, group: list[str], radius_km: float, pid: str = "pdv_id") -> DataFrame:
    """C-05, by density: the points spread over the circle of their 95th-percentile distance to
    the mean point; k = ceil(n / (density * area of a circle of `radius_km`)), 1 at least."""
    from .aggregates import exact_percentile
    mean = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"))
    d = points.select(*group, pid, "lat", "lon").join(mean, group).withColumn("_d", haversine_km("_clat", "_clon", "lat", "lon"))
    far = exact_percentile(d, group, "_d", 0.95, pid, "raio_p95_km")
    density = F.col("_n") / (F.lit(math.pi) * F.col("raio_p95_km") * F.col("raio_p95_km"))
    k = F.ceil(F.col("_n") / (density * F.lit(math.pi * radius_km * radius_km)))
    return mean.join(far, group, "left").select(
        *group, F.when((F.col("_n") >= 2) & (F.col("raio_p95_km") > 0), F.greatest(F.lit(1), k)).otherwise(1).cast("int").alias("k"))
