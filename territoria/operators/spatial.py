"""Exact distance joins without cross joins (J-07 nearest centre, J-08/J-10 radius
pairs, J-09 k nearest neighbours).

Every point is placed on the unit sphere (x, y, z) and bucketed into cubic grid
cells of edge `s` (chord units).  A row outside the 27 cells around a point's
cell is at chord distance >= s, i.e. at least `km_for_chord(s)` km away, so a
candidate found inside the neighbourhood that is closer than that bound is
provably the true answer.  Points whose answer is not yet proven move on to a
coarser level (edge x4); the last level has edge 2 and covers the whole
sphere, so the search always ends exact.  Each level is an equi-join on the
cell key: the adaptive plan broadcasts the centre side where its measured bytes
are few and else sort-merges, splitting skewed cells.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import chord_for_km, haversine_km, km_for_chord, unit_xyz
from ..session import cut_lineage, spread_rows

OFFSETS = list(product((-1, 0, 1), repeat=3))
_SAFETY = 1.0 - 1e-9
_MIN_CELL = chord_for_km(0.01)
_SAME_PLACE = chord_for_km(1e-4)  # 10 cm: what six decimals of a degree tell apart
NEIGHBOURHOOD = 32  # locations a wanted neighbour that the 27 cells of a first search may hold


def _cell_cols(lat: Column, lon: Column, s: float, prefix: str) -> list[Column]:
    x, y, z = unit_xyz(lat, lon)
    return [F.floor(x / F.lit(s)).alias(f"{prefix}x"), F.floor(y / F.lit(s)).alias(f"{prefix}y"),
            F.floor(z / F.lit(s)).alias(f"{prefix}z")]


def _neighbour_cells(df: DataFrame, prefix: str) -> DataFrame:
    off = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                    for a, b, c in OFFSETS])
    d = df.withColumn("_off", F.explode(off))
    return (d.withColumn(f"{prefix}x", F.col(f"{prefix}x") + F.col("_off.a"))
            .withColumn(f"{prefix}y", F.col(f"{prefix}y") + F.col("_off.b"))
            .withColumn(f"{prefix}z", F.col(f"{prefix}z") + F.col("_off.c")).drop("_off"))


def _levels(s0: float) -> list[float]:
    out, s = [], max(s0, 1e-7)
    while s < 2.0:
        out.append(s)
        s *= 4.0
    out.append(2.0)
    return out


def _spacing_chord(df: DataFrame, lat: str, lon: str, per_cell: float,
                   by: tuple[str, ...] = ()) -> tuple[float, int]:
    """Cell edge giving about `per_cell` rows per occupied cell.

    One scalar aggregate gives the bounding-box density; one more pass scores
    eight candidate edges at once (edge / 2^i) by their measured row-weighted
    occupancy, since real points cluster far more than their box suggests.
    """
    x, y, z = unit_xyz(F.col(lat), F.col(lon))
    r = df.agg(F.count(F.lit(1)).alias("n"),
               (F.max(x) - F.min(x)).alias("ex"), (F.max(y) - F.min(y)).alias("ey"),
               (F.max(z) - F.min(z)).alias("ez")).first()
    n = int(r["n"] or 0)
    if n == 0:
        return 2.0, 0
    ext = sorted([r["ex"] or 0.0, r["ey"] or 0.0, r["ez"] or 0.0], reverse=True)
    area = max(ext[0], 1e-6) * max(ext[1], 1e-6)
    s0 = min(2.0, max(math.sqrt(area * per_cell / n), _MIN_CELL))
    edges = [max(s0 / (2 ** i), _MIN_CELL) for i in range(8)]
    lv = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(edges)]))
    e = df.select(*by, lat, lon).withColumn("_l", lv)
    cells = [F.floor(c / F.col("_l.e")).alias(f"_o{j}") for j, c in enumerate(unit_xyz(F.col(lat), F.col(lon)))]
    cnt = e.groupBy(*by, F.col("_l.i").alias("_i"), *cells).agg(F.count(F.lit(1)).alias("c"))
    occ = {row["_i"]: row["o"] for row in cnt.groupBy("_i").agg(
        (F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("o")).collect()}
    for i, edge in enumerate(edges):  # largest edge whose occupancy is small enough
        if occ.get(i, 0.0) <= 2.0 * per_cell:
            return edge, n
    return edges[-1], n


def nearest(points: DataFrame, centres: DataFrame, centre_id: str, by: tuple[str, ...] = (),
            lat: str = "lat", lon: str = "lon", c_lat: str = "lat", c_lon: str = "lon",
            out_id: str = "centro_id", out_km: str = "dist_km",
            cell_km: float | None = None, within_km: float | None = None, allowed=None) -> DataFrame:
    """Append the nearest centre (haversine; ties -> smallest id) to every point.

    `by` restricts candidates to centres with equal key columns.  Points keep
    all their columns and are never grouped or shuffled by point: each point
    meets exactly one row of its cell, which holds the centres of the 27
    surrounding cells as an array, and the arg-min is an array expression.

    With `within_km` only centres up to that far count and the search ends at cells of that
    size; points without one get a null id.  `allowed(lat, lon)` is a condition on a point
    and a centre's coordinates; centres that do not meet it are passed over.
    """
    by = tuple(by)
    c = centres.select(*[F.col(b) for b in by], F.col(centre_id).alias("_cid"),
                       F.col(c_lat).cast("double").alias("_clat"), F.col(c_lon).cast("double").alias("_clon"))
    c = c.filter(F.col("_clat").isNotNull() & F.col("_clon").isNotNull())
    # Co-located centres: the smallest id wins every tie, so keep only it.
    c = c.groupBy(*by, "_clat", "_clon").agg(F.min("_cid").alias("_cid"))
    if cell_km is not None:
        s0 = chord_for_km(cell_km)
    else:
        s0, _ = _spacing_chord(c, "_clat", "_clon", per_cell=2.0, by=by)

    cols = points.columns
    cur = spread_rows(points)  # a distance a candidate costs far more than the bytes of a point
    results: list[DataFrame] = []
    levels = _levels(s0)
    if within_km is not None:
        reach = min(2.0, chord_for_km(within_km) * (2.0 - _SAFETY))
        levels = [s for s in levels if s < reach / 2] + [reach]
    for i, s in enumerate(levels):
        cc = c.select(*by, "_cid", "_clat", "_clon", *_cell_cols(F.col("_clat"), F.col("_clon"), s, "_k"))
        cc = _neighbour_cells(cc, "_k")
        cells = (cc.groupBy(*by, "_kx", "_ky", "_kz")
                 .agg(F.collect_list(F.struct("_cid", "_clat", "_clon")).alias("_cands")))
        p = cur.select("*", *_cell_cols(F.col(lat), F.col(lon), s, "_k"))
        j = p.join(cells, on=[*by, "_kx", "_ky", "_kz"], how="left")
        cands = F.col("_cands")
        if allowed is not None:
            cands = F.filter(cands, lambda e: allowed(e["_clat"], e["_clon"]))
        scored = j.withColumn("_best", F.array_min(F.transform(
            cands,
            lambda e: F.struct(haversine_km(F.col(lat), F.col(lon), e["_clat"], e["_clon"]).alias("d"),
                               e["_cid"].alias("id")))))
        final = i == len(levels) - 1
        if not final:  # read by three jobs
            scored = cut_lineage(scored.select(*cols, "_best"))
        guard = km_for_chord(s) * _SAFETY
        ok = F.lit(True) if final else (F.col("_best.d") <= F.lit(guard))
        best = F.col("_best")
        if final and within_km is not None:
            best = F.when(F.col("_best.d") <= F.lit(float(within_km)), best)
        done = scored.filter(ok).select(*cols, best["id"].alias(out_id), best["d"].alias(out_km))
        results.append(done)
        if final:
            break
        rest = scored.filter(~F.coalesce(ok, F.lit(False))).select(*cols)
        if rest.isEmpty():
            break
        cur = rest
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def _dedupe_locations(df: DataFrame, pid: str, lat: str, lon: str, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Collapse identical coordinates to one location with a multiplicity."""
    loc = (df.groupBy(*by, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
           .agg(F.count(F.lit(1)).alias("_m"), F.min(pid).alias("_loc")))
    members = df.select(pid, *by, F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
    return loc, members


def start_edges(loc: DataFrame, s0: float, by: tuple[str, ...], most: float) -> dict[float, DataFrame]:
    """Cell edge -> the locations whose search begins there: the largest of s0, s0 / 2, s0 / 4, ...
    at which the 27 cells around a location's own hold at most `most` locations.

    An adaptive tree walked level by level: only cells above the bound are split again, until
    none is left or the cells are as small as coordinates can tell apart.  Cells are
    counted first, so what spreads to neighbours is one row a cell and not a location.
    """
    out: dict[float, DataFrame] = {}
    cells = ["_kx", "_ky", "_kz"]
    pending, edge = loc, s0
    while True:
        count = loc.select(*by, *_cell_cols(F.col("_lat"), F.col("_lon"), edge, "_k")).groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("_c"))
        around = _neighbour_cells(count, "_k").groupBy(*by, *cells).agg(F.sum("_c").alias("_around"))
        seen = cut_lineage(pending.select(*loc.columns, *_cell_cols(F.col("_lat"), F.col("_lon"), edge, "_k")).join(around, [*by, *cells], "left"))
        last = edge / 2 < _SAME_PLACE
        dense = F.lit(False) if last else F.coalesce(F.col("_around") > F.lit(most), F.lit(False))
        fits = seen.filter(~dense).select(*loc.columns)
        if not fits.isEmpty():
            out[edge] = fits
        pending = seen.filter(dense).select(*loc.columns)
        if last or pending.isEmpty():
            return out
        edge /= 2


def knn_distances(points: DataFrame, k: int, pid: str = "pdv_id", lat: str = "lat", lon: str = "lon",
                  by: tuple[str, ...] = ()) -> DataFrame:
    """Distances to the k nearest other points (J-09): returns pid, d1 (nearest), dk_mean.

    Identical coordinates are folded into one location with a multiplicity
    first, so a hot spot holding a third of all rows is one row here: for a
    location of multiplicity m, m-1 neighbours sit at distance 0.  The search
    then runs on distinct locations, level by level, from fine to coarse: one join
    to the 27 neighbour cells, the k nearest by a ranked limit (applied before and
    after the shuffle, so no list grows with the neighbourhood), and only locations
    whose k-th distance is not yet proven go on to the next, coarser level.
    A location enters at the level that fits its own surroundings
    (`start_edges`), so a dense district costs no more a location than a
    sparse one.  Each level's per-location result is checkpointed once.
    """
    by = tuple(by)
    loc, members = _dedupe_locations(points, pid, lat, lon, by)
    loc = cut_lineage(loc)
    s0, n = _spacing_chord(loc, "_lat", "_lon", per_cell=float(k + 1), by=by)
    entering = start_edges(loc, s0, by, most=NEIGHBOURHOOD * (k + 1)) or {s0: loc}
    levels = [*sorted(e for e in entering if e < s0), *_levels(s0)]
    cur = None
    results: list[DataFrame] = []
    for i, s in enumerate(levels):
        new = entering.get(s)
        cur = new if cur is None else cur if new is None else cur.unionByName(new)
        if cur is None:
            continue
        q = cur.select(*by, "_loc", "_lat", "_lon", "_m", *_cell_cols(F.col("_lat"), F.col("_lon"), s, "_k"))
        cand = loc.select(*by, F.col("_loc").alias("_oloc"), F.col("_lat").alias("_olat"),
                          F.col("_lon").alias("_olon"), F.col("_m").alias("_om"),
                          *_cell_cols(F.col("_lat"), F.col("_lon"), s, "_k"))
        cand = _neighbour_cells(cand, "_k")
        # A location meets itself too: as no neighbour, which keeps those that meet no other.
        pairs = q.join(cand, on=[*by, "_kx", "_ky", "_kz"], how="left")
        nb = F.when(F.col("_oloc") != F.col("_loc"),
                    F.struct(haversine_km("_lat", "_lon", "_olat", "_olon").alias("d"), F.col("_oloc").alias("o"),
                             F.col("_om").alias("m")))
        # Every neighbour counts once at least, so the k nearest locations are enough.
        first = Window.partitionBy(*by, "_loc", "_lat", "_lon", "_m").orderBy(F.col("_nb1").asc_nulls_last())
        pairs = pairs.select(*by, "_loc", "_lat", "_lon", "_m", nb.alias("_nb1")) \
            .withColumn("_rk", F.row_number().over(first)).filter(F.col("_rk") <= k)
        agg = pairs.groupBy(*by, "_loc", "_lat", "_lon", "_m").agg(F.array_sort(F.collect_list("_nb1")).alias("_nb"))
        # k distances: m-1 zeros (co-located copies), then neighbours by multiplicity.
        zeros = F.least(F.col("_m") - 1, F.lit(k)).cast("int")
        dist_k = F.slice(F.concat(
            F.array_repeat(F.lit(0.0), zeros),
            F.flatten(F.transform("_nb", lambda e: F.array_repeat(e["d"], F.least(e["m"], F.lit(k)).cast("int"))))),
            1, k)
        scored = agg.select(*by, "_loc", "_lat", "_lon", "_m", dist_k.alias("_dk"))
        final = i == len(levels) - 1
        guard = km_for_chord(s) * _SAFETY
        if not final:
            scored = cut_lineage(scored)
        ok = F.lit(True) if final else ((F.size("_dk") >= k) & (F.try_element_at("_dk", F.lit(-1)) <= F.lit(guard)))
        results.append(scored.filter(ok).select(*by, "_lat", "_lon", "_dk"))
        if final:
            break
        rest = scored.filter(~ok).select(*by, "_loc", "_lat", "_lon", "_m")
        waiting = any(e in entering for e in levels[i + 1:])
        if rest.isEmpty():
            if not waiting:
                break
            rest = None
        cur = rest
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    res = members.join(out, on=[*by, "_lat", "_lon"])
    return res.select(pid, *by,
                      F.try_element_at("_dk", F.lit(1)).alias("d1_km"),
                      F.when(F.size("_dk") > 0, F.aggregate("_dk", F.lit(0.0), lambda a, x: a + x)
                             / F.size("_dk")).alias("dk_mean_km"),
                      F.size("_dk").alias("k_found"))


def pairs_within(left: DataFrame, right: DataFrame, radius_km: float, lid: str, rid: str,
                 by: tuple[str, ...] = (), lat: str = "lat", lon: str = "lon",
                 r_lat: str = "lat", r_lon: str = "lon", exclude_same_id: bool = False) -> DataFrame:
    """All (left, right) pairs within `radius_km` (J-08, J-10): one grid level of
    edge = radius, right side exploded to 27 cells, equi-join, exact residual."""
    by = tuple(by)
    s = min(2.0, chord_for_km(radius_km))
    lsel = left.select(*by, F.col(lid).alias("_l"), F.col(lat).alias("_llat"), F.col(lon).alias("_llon"),
                       *_cell_cols(F.col(lat), F.col(lon), s, "_k"))
    rsel = right.select(*by, F.col(rid).alias("_r"), F.col(r_lat).alias("_rlat"), F.col(r_lon).alias("_rlon"),
                        *_cell_cols(F.col(r_lat), F.col(r_lon), s, "_k"))
    rsel = _neighbour_cells(rsel, "_k")
    j = lsel.join(rsel, on=[*by, "_kx", "_ky", "_kz"])
    if exclude_same_id:
        j = j.filter(F.col("_l") != F.col("_r"))
    j = j.withColumn("dist_km", haversine_km("_llat", "_llon", "_rlat", "_rlon"))
    return j.filter(F.col("dist_km") <= F.lit(float(radius_km))).select(
        *by, F.col("_l").alias(lid), F.col("_r").alias(rid if rid != lid else rid + "_2"), "dist_km")
