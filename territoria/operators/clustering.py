"""Territory algorithms built from grouped DataFrame rounds (C-07..C-19).

Every iterative algorithm runs all groups in the same job, returns only a few
scalars to the driver per round, and checkpoints its (small) state to the
shared folder each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import SLOW_MINUTES, haversine_km, km_for_chord, travel_min
from ..session import cut_lineage
from .balance import balance_in_task
from .lloyd import LOCAL_POINTS, MAX_ROUNDS, half_up, kmeans, lloyd_of_group
from .routing import _hav_np, nearest_neighbour_order
from .spatial import _spacing_chord, nearest
from .windows import ranked


# ----------------------------------------------------------------- C-07
def cluster_centres(assigned: DataFrame, key: list[str], weight: str | None = None) -> DataFrame:
    """Centre of each cluster: mean, or weighted mean when a weight column is given (A-04)."""
    if weight:
        w = F.col(weight)
        g = assigned.groupBy(*key, "c").agg(F.sum(w).alias("_sw"), F.sum(w * F.col("lat")).alias("_a"),
                                            F.sum(w * F.col("lon")).alias("_b"), F.avg("lat").alias("_ml"),
                                            F.avg("lon").alias("_mo"), F.count(F.lit(1)).alias("_sz"))
        return g.select(*key, "c", "_sz",
                        F.when(F.col("_sw") > 0, F.col("_a") / F.col("_sw")).otherwise(F.col("_ml")).alias("_clat"),
                        F.when(F.col("_sw") > 0, F.col("_b") / F.col("_sw")).otherwise(F.col("_mo")).alias("_clon"))
    return assigned.groupBy(*key, "c").agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"),
                                           F.count(F.lit(1)).alias("_sz"))


def cluster_fitness(assigned: DataFrame, key: list[str], kmh: float, weight: str | None = None) -> DataFrame:
    """Per (key): largest cluster size and largest centre->point minutes."""
    cen = cluster_centres(assigned, key, weight)
    j = assigned.join(cen, [*key, "c"])
    per_c = j.groupBy(*key, "c").agg(
        F.max(travel_min(haversine_km("lat", "lon", "_clat", "_clon"), kmh)).alias("_tmax"),
        F.first("_sz").alias("_sz"))
    return per_c.groupBy(*key).agg(F.max("_tmax").alias("tempo_max_min"), F.max("_sz").alias("max_pdvs"))


def kmeans_capacity(points: DataFrame, group: list[str], cap: int | None, tempo_max_min: float, kmh: float,
                    max_tries: int = 10, batch: int = 4, lloyd_iter: int = MAX_ROUNDS,
                    pid: str = "pdv_id", k0: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """C-07 (and the k search of C-15): k starts at `k0` (default ceil(n / cap))
    per group and grows by one until the largest cluster fits `cap` (if given)
    and every point is within `tempo_max_min` of its centre (status OK), or k has
    reached the number of points, or `max_tries` values were tried, which is the
    user's limit; then the last one is kept with status EXCEDIDO.

    Candidate k values are evaluated `batch` at a time in one grouped Lloyd
    job, with (group, k) as the Lloyd group.
    """
    n = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    if k0 is None:
        pending = n.select(*group, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(cap)))).cast("int")
                           .alias("_k0"), F.col("_n"))
    else:
        pending = n.join(k0.select(*group, F.col("k").cast("int").alias("_k0")), group)
    chosen = None
    kept_labels = []
    tried = 0
    # many clusters per group: each extra candidate k multiplies the work, so go one at a time
    if (pending.agg(F.max("_k0")).first()[0] or 0) > 64:
        batch = 1
    while tried < max_tries:
        width = min(batch, max_tries - tried)
        cands = (pending.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
                 .withColumn("k", F.least(F.col("_k0") + F.col("_j"), F.col("_n")).cast("int"))
                 .select(*group, "k", F.col("_j")).dropDuplicates([*group, "k"]))
        cands = cut_lineage(cands)
        pts = points.join(cands.select(*group, "k"), group)
        res, _ = kmeans(pts, cands.select(*group, "k"), [*group, "k"], pid=pid, max_iter=lloyd_iter)
        res = cut_lineage(res)
        kept_labels.append(res.select(*group, "k", pid, "c"))
        if weight and weight not in res.columns:
            res = res.join(points.select(pid, weight), pid)
        fit = cluster_fitness(res, [*group, "k"], kmh, weight)
        ok = F.col("tempo_max_min") <= tempo_max_min
        if cap is not None:
            ok = ok & (F.col("max_pdvs") <= cap)
        fit = cut_lineage(fit.withColumn("_ok", ok).join(cands.select(*group, "k"), [*group, "k"]))
        last_round = tried + width >= max_tries
        # one candidate a point is the end of the search as well: no larger k exists
        ends = fit.join(pending, group).select(*group, "k", "_ok", (F.col("k") >= F.col("_n")).alias("_end"))
        fits, last = F.min(F.when(F.col("_ok"), F.col("k"))), F.max(F.when(F.lit(last_round) | F.col("_end"), F.col("k")))
        pick = ends.groupBy(*group).agg(F.coalesce(fits, last).alias("k_final"), F.when(fits.isNotNull(), "OK").otherwise("EXCEDIDO").alias("status"))
        pick = cut_lineage(pick.filter("k_final is not null"))
        chosen = pick if chosen is None else chosen.unionByName(pick)
        pending = cut_lineage(pending.join(pick.select(*group), group, "left_anti")
                              .withColumn("_k0", F.col("_k0") + width))
        tried += width
        if pending.isEmpty():
            break
    k_final = chosen.withColumnRenamed("k_final", "k")
    # the chosen k was already clustered in its round: reuse those labels
    labels = kept_labels[0]
    for more in kept_labels[1:]:
        labels = labels.unionByName(more)
    final = labels.join(k_final, [*group, "k"]).select(pid, F.col("c").alias("cluster_id"), F.col("k").alias("k_final"), "status")
    return points.join(final, pid)


def cluster_ceps_by_time(ceps: DataFrame, group: list[str], tempo_max_min: float, kmh: float,
                         weight: str = "clientes_total", cap: int | None = None, max_tries: int = 10,
                         pid: str = "cep", jitter_duplicates: bool = True) -> DataFrame:
    """C-15: CEPs with positive weight, repeatable jitter when coordinates repeat,
    k from area (bbox diameter circle / time-radius circle, at most n // 3),
    k search on time (and optional size); weighted centres and outlier flags."""
    from ..functions.geo import jitter as _jitter
    # read many times below: worked out once, so that what it is joined from is not read, sent and joined each time
    c = cut_lineage(ceps.filter(F.col(weight) > 0))
    if jitter_duplicates:
        dup = c.groupBy(*group, "lat", "lon").agg(F.count(F.lit(1)).alias("_d"))
        has_dup = dup.filter(F.col("_d") > 1).select(*group).distinct().withColumn("_jit", F.lit(True))
        jl, jo = _jitter(F.col(pid), F.col("lat"), F.col("lon"))
        c = (c.join(has_dup, group, "left")
             .withColumn("lat", F.when(F.col("_jit"), jl).otherwise(F.col("lat")))
             .withColumn("lon", F.when(F.col("_jit"), jo).otherwise(F.col("lon"))).drop("_jit"))
    radius = kmh * tempo_max_min / 60.0
    box = c.groupBy(*group).agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("x"),
                                F.max("lon").alias("y"), F.count(F.lit(1)).alias("_n"))
    diam = haversine_km("a", "x", "b", "y")
    k0 = box.select(*group, F.greatest(F.lit(1), F.least(
        F.floor((F.pow(diam / 2, 2)) / F.lit(radius * radius)), F.floor(F.col("_n") / 3))).cast("int").alias("k"))
    res = kmeans_capacity(c, group, cap, tempo_max_min, kmh, max_tries=max_tries, pid=pid, k0=k0, weight=weight)
    cen = cluster_centres(res.withColumnRenamed("cluster_id", "c"), [*group], weight)
    out = res.join(cen.withColumnRenamed("c", "cluster_id"), [*group, "cluster_id"])
    out = out.withColumn("distancia_km", haversine_km("lat", "lon", "_clat", "_clon")) \
             .withColumn("tempo_min", travel_min(F.col("distancia_km"), kmh)) \
             .withColumn("is_outlier", F.col("tempo_min") > tempo_max_min)
    return out.withColumnRenamed("_clat", "cluster_lat").withColumnRenamed("_clon", "cluster_lon").drop("_sz")


# ----------------------------------------------------------------- C-16 / C-17
BALANCE_POINTS = 1_000_000  # points and centres (about 100 bytes each) whose balancing rounds run in one task; counted before


def balance_points(assign: DataFrame, centres: DataFrame, min_pdv: int, max_pdv: int,
                   tempo_max_min: float, kmh: float, merge_km: float, rounds: int = 10,
                   pid: str = "pdv_id", undersize: str = "drop_if_all_fit", local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C-16: move border points of oversize clusters to feasible neighbour
    centres, then drop undersize centres whose points can all move.

    `assign`: pid, lat, lon, label.  `centres`: label, lat, lon.
    One round: (1) sizes; (2) for every point of an oversize cluster, the best
    neighbour centre (within `merge_km` of its centre, minutes <= limit, free
    capacity) by (minutes, km, label); (3) each source gives at most its
    excess, farthest points first; (4) each target takes proposals in
    (minutes, id) order up to its free capacity.  Rejected points retry next
    round.  Undersize centres are then tried all-or-nothing, in a batch whose
    members do not receive each other's points (`undersize="merge_nearest"`,
    C-17: an undersize centre instead merges whole into its nearest kept
    centre, even above the maximum).  Targets come from a nearest-centre
    search (J-07) among the centres with free capacity.

    Up to `local` (BALANCE_POINTS) points and centres, counted first, all rounds run in one
    task; more of them, and C-17, in jobs, some twenty a round.
    """
    a = cut_lineage(assign.select(pid, "lat", "lon", "label"))
    cen = cut_lineage(centres.select("label", "lat", "lon"))
    if undersize == "drop_if_all_fit" and a.count() + cen.count() <= (BALANCE_POINTS if local is None else local):
        limits = {"min_pdv": min_pdv, "max_pdv": max_pdv, "tempo_max_min": tempo_max_min, "kmh": kmh, "merge_km": merge_km}
        return balance_in_task(a, cen, rounds, pid, limits)
    cell_km = km_for_chord(_spacing_chord(cen, "lat", "lon", per_cell=2.0)[0])  # centres stay where they are: sized once
    for _ in range(rounds):
        moved = 0
        sizes = a.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        c2 = cut_lineage(cen.join(sizes, "label", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
        over = c2.filter(F.col("_n") > max_pdv).select("label", (F.col("_n") - max_pdv).alias("_excess"))
        if not over.isEmpty():
            free = c2.select(F.col("label").alias("dst"), (F.lit(max_pdv) - F.col("_n")).alias("_free"))
            movers = a.join(over, "label").join(cen.select("label", F.col("lat").alias("_slat"),
                                                          F.col("lon").alias("_slon")), "label")
            movers = movers.withColumn("_dsrc", haversine_km("lat", "lon", "_slat", "_slon"))
            cand = _best_target(movers, c2.filter(F.col("_n") < max_pdv), tempo_max_min, kmh, cell_km, merge_km)
            best = cut_lineage(cand.groupBy(pid, "label", "_excess", "_dsrc").agg(
                F.min(F.struct("_min", "_km", "dst")).alias("_b")))
            best = ranked(best, ["label"], [F.col("_dsrc").desc(), pid], out="_srk").filter(F.col("_srk") <= F.col("_excess"))
            best = best.select(pid, "label", F.col("_b.dst").alias("dst"), F.col("_b._min").alias("_min"))
            best = cut_lineage(best.join(free, "dst"))
            acc = ranked(best, ["dst"], ["_min", pid], out="_trk").filter(F.col("_trk") <= F.col("_free"))
            acc = cut_lineage(acc.select(pid, F.col("dst").alias("_new")))
            moved = acc.count()
            if moved:
                a = cut_lineage(a.join(acc, pid, "left")
                                .withColumn("label", F.coalesce("_new", "label")).drop("_new"))
        if undersize == "merge_nearest":
            removed, a, cen = _merge_undersize(a, cen, min_pdv, pid)
        else:
            removed, a, cen = _drop_undersize(a, cen, min_pdv, max_pdv, tempo_max_min, kmh, cell_km, merge_km, pid)
        if moved == 0 and removed == 0:
            break
    return a, cen


def _merge_undersize(a, cen, min_pdv, pid):
    sizes = a.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    c2 = cen.join(sizes, "label", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    under = c2.filter(F.col("_n") < min_pdv).select("label", "lat", "lon")
    keep = c2.join(under.select("label"), "label", "left_anti").select(F.col("label").alias("_dst"), "lat", "lon")
    if under.isEmpty() or keep.isEmpty():
        return 0, a, cen
    m = cut_lineage(nearest(under, keep, "_dst", out_id="_dst").select("label", "_dst"))
    removed = m.count()
    a = cut_lineage(a.join(m, "label", "left").withColumn("label", F.coalesce("_dst", "label")).drop("_dst"))
    cen = cut_lineage(cen.join(m.select("label"), "label", "left_anti"))
    return removed, a, cen


def _best_target(movers, targets, tempo_max_min, kmh, cell_km, merge_km=None):
    """`dst`, `_km`, `_min`: the nearest of `targets` within the minutes, and within `merge_km` of
    the mover's own centre (`_slat`, `_slon`) if given; movers without one are left out.

    A nearest-centre search: a mover meets the centres of the cells around it, level by
    level, and not all that lie within reach, whose number grows with the centres."""
    radius_km = tempo_max_min * kmh / 60.0 * (1 + 1e-9)
    near = None if merge_km is None else lambda lat, lon: haversine_km("_slat", "_slon", lat, lon) <= F.lit(float(merge_km))
    found = nearest(movers, targets.filter(F.col("label").isNotNull()), "label", out_id="dst", out_km="_km", cell_km=cell_km,
                    within_km=radius_km, allowed=near)
    return found.withColumn("_min", travel_min("_km", kmh)).filter(F.col("dst").isNotNull() & (F.col("_min") <= tempo_max_min))


def _drop_undersize(a, cen, min_pdv, max_pdv, tempo_max_min, kmh, cell_km, merge_km, pid):
    sizes = a.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    c2 = cut_lineage(cen.join(sizes, "label", "left").withColumn("_n", F.coalesce("_n", F.lit(0))))
    under = c2.filter(F.col("_n") < min_pdv).select("label", "_n")
    if under.isEmpty() or c2.count() <= 1:
        return 0, a, cen
    keep_targets = c2.join(under.select("label"), "label", "left_anti")
    free = keep_targets.select(F.col("label").alias("dst"), (F.lit(max_pdv) - F.col("_n")).alias("_free"))
    open_targets = keep_targets.filter(F.col("_n") < max_pdv)
    movers = cut_lineage(a.join(under, "label").join(cen.select("label", F.col("lat").alias("_slat"), F.col("lon").alias("_slon")), "label")
                         .select(pid, "lat", "lon", F.col("label").alias("src"), "_slat", "_slon"))
    # near ring first: targets within merge_km of the point's own centre rank ahead
    near = cut_lineage(_best_target(movers, open_targets, tempo_max_min, kmh, cell_km, merge_km))
    far = _best_target(movers.join(near.select(pid, "src"), [pid, "src"], "left_anti"), open_targets, tempo_max_min, kmh, cell_km)
    cand = near.unionByName(far)
    best = cand.groupBy(pid, "src").agg(F.min(F.struct("_min", "_km", "dst")).alias("_b"))
    best = cut_lineage(best.select(pid, "src", F.col("_b.dst").alias("dst"), F.col("_b._min").alias("_min"))
                       .join(free, "dst"))
    acc = ranked(best, ["dst"], ["_min", pid], out="_trk").filter(F.col("_trk") <= F.col("_free"))
    # all-or-nothing per undersize centre
    got = acc.groupBy("src").agg(F.count(F.lit(1)).alias("_got"))
    whole = under.select(F.col("label").alias("src"), "_n").join(got, "src").filter(F.col("_got") == F.col("_n"))
    whole = cut_lineage(whole.select("src"))
    removed = whole.count()
    if removed == 0:
        return 0, a, cen
    moves = acc.join(whole, "src").select(pid, F.col("dst").alias("_new"))
    a = cut_lineage(a.join(moves, pid, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new"))
    cen = cut_lineage(cen.join(whole.withColumnRenamed("src", "label"), "label", "left_anti"))
    return removed, a, cen


# ----------------------------------------------------------------- C-13
KM_PER_DEG = 111.0


# Rule for eps (km) and min_samples from the median distance to the next place.
EPS_PER_MEDIAN = 20.0
SMALL_GROUP, SMALL_MIN, SMALL_MAX = 60, 3, 30
DENSITY_LOW, DENSITY_SPAN = 0.05, 0.1


def adaptive_dbscan_params(points: DataFrame, pid: str = "pdv_id", by: tuple[str, ...] = (),
                           eps_min_km: float = 2.0, eps_max_km: float = 6.0,
                           ms_min: int = 10, ms_max: int = 30) -> DataFrame:
    """Per group: eps_km = EPS_PER_MEDIAN x the median km from a place to the next other one, within
    [eps_min_km, eps_max_km]; min_samples grows from ms_min to ms_max with the density 1 / median,
    and is half the points, 3 to 30, for groups of fewer than SMALL_GROUP points.

    The median is exact: places ranked by distance over all tasks, so a group of any
    size is never gathered.  A group with one place only counts as infinitely dense.
    """
    from .spatial import knn_distances
    if not by:  # one group
        return adaptive_dbscan_params(points.withColumn("_all", F.lit(0)), pid, ("_all",), eps_min_km, eps_max_km, ms_min, ms_max).drop("_all")
    by = list(by)
    places = points.groupBy(*by, "lat", "lon").agg(F.min(pid).alias(pid))
    near = cut_lineage(knn_distances(places, 1, pid=pid, by=tuple(by)).select(*by, pid, "d1_km").filter(F.col("d1_km").isNotNull()))
    sizes = near.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    spots = ranked(near, by, ["d1_km", pid], out="_rk").join(sizes, by)
    middle = F.col("_rk").isin(F.floor((F.col("_m") + 1) / 2), F.floor(F.col("_m") / 2) + 1)
    median = spots.filter(middle).groupBy(*by).agg(F.avg("d1_km").alias("_med"))
    total = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    g = total.join(median, by, "left")
    med = F.coalesce("_med", F.lit(0.0))
    density = F.least(F.greatest((F.lit(1.0) / (med + 1e-6) - DENSITY_LOW) / DENSITY_SPAN, F.lit(0.0)), F.lit(1.0))
    small = F.least(F.greatest(F.floor(F.col("_n") / 2), F.lit(SMALL_MIN)), F.lit(SMALL_MAX))
    ms = F.when(F.col("_n") < SMALL_GROUP, small).otherwise(F.floor(ms_min + density * (ms_max - ms_min)))
    return g.select(*by, F.least(F.greatest(med * EPS_PER_MEDIAN, F.lit(float(eps_min_km))), F.lit(float(eps_max_km))).alias("eps_km"),
                    ms.cast("int").alias("min_samples"))


def _cell_id(a, b):
    return (a.cast("long") * F.lit(4294967296) + (b.cast("long") + F.lit(2147483648)))


def dbscan(points: DataFrame, eps_km: float | None = None, min_samples: int | None = None, pid: str = "pdv_id",
           by: tuple[str, ...] = (), params: DataFrame | None = None) -> DataFrame:
    """C-13: density clusters with eps in degrees (eps_km / 111, planar), every point labelled.

    eps_km and min_samples hold for all groups, or `params` has them for each group
    (columns `by`, eps_km, min_samples); cells then have the size of the group's own eps.

    * fine cells of side eps/sqrt(2): all points of a cell are neighbours, so a
      cell holding >= min_samples points makes all of them core with no pairs;
    * only points of sparse cells count neighbours, against the 5x5 cells
      around them (exact residual);
    * cores of one cell are connected; cells are linked when two of their
      cores are within eps, and components come from min-label propagation
      on the cell graph (checkpointed per round);
    * border points join the component of their nearest core; noise points
      join the nearest cluster mean (haversine); a group without any cluster -> label 0.
    Labels are 0..k-1 in order of each cluster's smallest point id.
    """
    if params is not None and not by:  # one group
        return dbscan(points.withColumn("_all", F.lit(0)), pid=pid, by=("_all",), params=params.withColumn("_all", F.lit(0))).drop("_all")
    by = tuple(by)
    if params is None:
        p = points.withColumn("_eps", F.lit(eps_km / KM_PER_DEG)).withColumn("_ms", F.lit(min_samples))
    else:
        own = params.select(*by, (F.col("eps_km") / KM_PER_DEG).alias("_eps"), F.col("min_samples").alias("_ms"))
        p = points.join(own, list(by))
    side = F.col("_eps") / 2 ** 0.5
    p = p.select(pid, *by, "lat", "lon", "_eps", "_ms",
                 F.floor(F.col("lat") / side).alias("_ca"), F.floor(F.col("lon") / side).alias("_cb"))
    p = cut_lineage(p)
    cnt = p.groupBy(*by, "_ca", "_cb").agg(F.count(F.lit(1)).alias("_cc"))
    p = p.join(cnt, [*by, "_ca", "_cb"])
    offs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    other = p.select(F.col(pid).alias("_o"), *by, F.col("lat").alias("_olat"), F.col("lon").alias("_olon"),
                     "_ca", "_cb", F.col("_cc").alias("_occ"))
    sparse = p.filter(F.col("_cc") < F.col("_ms"))
    reach = F.col("_eps") * F.col("_eps")
    q = (sparse.withColumn("_off", F.explode(offs))
         .withColumn("_na", F.col("_ca") + F.col("_off.i")).withColumn("_nb", F.col("_cb") + F.col("_off.j"))
         .drop("_off"))
    d2 = lambda a, b, c, d: F.pow(F.col(a) - F.col(c), 2) + F.pow(F.col(b) - F.col(d), 2)
    pairs = (q.join(other.withColumnRenamed("_ca", "_na").withColumnRenamed("_cb", "_nb"), [*by, "_na", "_nb"])
             .filter((F.col("_o") != F.col(pid)) & (d2("lat", "lon", "_olat", "_olon") <= reach)))
    pairs = cut_lineage(pairs.select(pid, "_o", "_olat", "_olon", "_occ", "lat", "lon", *by))
    ncount = pairs.groupBy(pid).agg(F.count(F.lit(1)).alias("_nn"))
    p = (p.join(ncount, pid, "left")
         .withColumn("_core", (F.col("_cc") >= F.col("_ms")) | (F.coalesce("_nn", F.lit(0)) + 1 >= F.col("_ms"))))
    p = cut_lineage(p.drop("_nn"))
    cores = p.filter("_core")
    if cores.isEmpty():
        return points.select(*points.columns, F.lit(0).alias("cluster_id"))
    cid = _cell_id(F.col("_ca"), F.col("_cb"))
    core_cells = cores.select(*by, "_ca", "_cb").distinct().withColumn("_cell", cid)
    # edges between cells: a core pair within eps (both ends core)
    cq = (cores.select(pid, *by, "lat", "lon", "_eps", "_ca", "_cb").withColumn("_off", F.explode(offs))
          .withColumn("_na", F.col("_ca") + F.col("_off.i")).withColumn("_nb", F.col("_cb") + F.col("_off.j"))
          .filter((F.col("_off.i") > 0) | ((F.col("_off.i") == 0) & (F.col("_off.j") > 0))).drop("_off"))
    co = cores.select(*by, F.col("lat").alias("_olat"), F.col("lon").alias("_olon"),
                      F.col("_ca").alias("_na"), F.col("_cb").alias("_nb"))
    edges = (cq.join(co, [*by, "_na", "_nb"]).filter(d2("lat", "lon", "_olat", "_olon") <= reach)
             .select(*by, _cell_id(F.col("_ca"), F.col("_cb")).alias("_u"),
                     _cell_id(F.col("_na"), F.col("_nb")).alias("_v")).distinct())
    edges = cut_lineage(edges.unionByName(edges.select(*by, F.col("_v").alias("_u"), F.col("_u").alias("_v"))))
    lab = cut_lineage(core_cells.select(*by, F.col("_cell").alias("_u"), F.col("_cell").alias("_lab")))
    while True:  # until nothing changes; a label's own label is taken over too, so long chains need few rounds
        prop = (edges.join(lab.withColumnRenamed("_u", "_v").withColumnRenamed("_lab", "_vl"), [*by, "_v"])
                .groupBy(*by, "_u").agg(F.min("_vl").alias("_m")))
        new = (lab.join(prop, [*by, "_u"], "left")
               .select(*by, "_u", F.least("_lab", F.coalesce("_m", "_lab")).alias("_lab")))
        new = cut_lineage(new)
        further = new.select(*by, F.col("_u").alias("_lab"), F.col("_lab").alias("_far"))
        new = cut_lineage(new.join(further, [*by, "_lab"]).select(*by, "_u", F.least("_lab", "_far").alias("_lab")))
        changed = new.join(lab.withColumnRenamed("_lab", "_old"), [*by, "_u"]).filter(
            F.col("_lab") != F.col("_old")).limit(1).count()
        lab = new
        if changed == 0:
            break
    core_lab = cores.select(pid, *by, cid.alias("_u")).join(lab, [*by, "_u"]).select(pid, "_lab")
    # border points: nearest core among their neighbour pairs (only sparse points can be border)
    core_ids = core_lab.select(F.col(pid).alias("_o"), F.col("_lab").alias("_olab"))
    border = (pairs.join(core_ids, "_o")
              .withColumn("_d", d2("lat", "lon", "_olat", "_olon"))
              .groupBy(pid).agg(F.min(F.struct("_d", "_olab")).alias("_b"))
              .select(pid, F.col("_b._olab").alias("_blab")))
    lab_all = (p.select(pid, *by, "lat", "lon", "_core").join(core_lab, pid, "left").join(border, pid, "left")
               .withColumn("_lab", F.when(F.col("_core"), F.col("_lab")).otherwise(F.col("_blab"))).drop("_blab"))
    lab_all = cut_lineage(lab_all)
    clustered = lab_all.filter(F.col("_lab").isNotNull())
    noise = lab_all.filter(F.col("_lab").isNull()).drop("_lab")
    means = clustered.groupBy(*by, "_lab").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    if by:  # groups without any cluster have nothing to join
        noise = noise.join(means.select(*by).distinct(), list(by), "left_semi")
    fixed = nearest(noise, means, "_lab", by=by, out_id="_lab", out_km="_nk").drop("_nk")
    everything = clustered.select(pid, *by, "_lab").unionByName(fixed.select(pid, *by, "_lab"))
    order = everything.groupBy(*by, "_lab").agg(F.min(pid).alias("_first"))
    order = ranked(order, list(by), ["_first"], out="_r").withColumn("cluster_id", (F.col("_r") - 1).cast("int"))
    res = everything.join(order.select(*by, "_lab", "cluster_id"), [*by, "_lab"]).select(pid, "cluster_id")
    return points.join(res, pid, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))


# ----------------------------------------------------------------- C-12
def _cell_bounds(pts: DataFrame, group: list[str], side: int) -> DataFrame:
    """Per place: lower/upper bound of its total distance to the group's points (`_w` at each
    place), from side x side cell summaries (count, centroid, radius) by the triangle inequality."""
    box = pts.groupBy(*group).agg(F.min("lat").alias("_la0"), F.max("lat").alias("_la1"),
                                  F.min("lon").alias("_lo0"), F.max("lon").alias("_lo1"))
    h = F.greatest((F.col("_la1") - F.col("_la0")) / side, (F.col("_lo1") - F.col("_lo0")) / side, F.lit(1e-9))
    p = pts.join(box, group).withColumn("_ci", F.floor((F.col("lat") - F.col("_la0")) / h).cast("int")) \
        .withColumn("_cj", F.floor((F.col("lon") - F.col("_lo0")) / h).cast("int"))
    cen = p.groupBy(*group, "_ci", "_cj").agg(F.sum("_w").alias("cnt"), F.avg("lat").alias("clat"),
                                              F.avg("lon").alias("clon"))
    rad = (p.join(cen, [*group, "_ci", "_cj"]).groupBy(*group, "_ci", "_cj", "cnt", "clat", "clon")
           .agg(F.max(haversine_km("lat", "lon", "clat", "clon")).alias("r")))
    arr = rad.groupBy(*group).agg(F.collect_list(F.struct("cnt", "clat", "clon", "r")).alias("_cells"))
    b = pts.join(arr, group)
    lu = F.aggregate("_cells", F.struct(F.lit(0.0).alias("lb"), F.lit(0.0).alias("ub")),
                     lambda acc, c: F.struct(
                         (acc["lb"] + c["cnt"] * F.greatest(F.lit(0.0), haversine_km(F.col("lat"), F.col("lon"), c["clat"], c["clon"]) - c["r"])).alias("lb"),
                         (acc["ub"] + c["cnt"] * (haversine_km(F.col("lat"), F.col("lon"), c["clat"], c["clon"]) + c["r"])).alias("ub")))
    return b.withColumn("_lu", lu).select(*pts.columns, F.col("_lu.lb").alias("_lb"), F.col("_lu.ub").alias("_ub"))


def medoid_of_group(lat: np.ndarray, lon: np.ndarray, w: np.ndarray, ids: np.ndarray, batch: int = 16) -> int:
    """Position of the place with the smallest total distance to all places, ties by id.

    The bounds of `medoids` without the cells: the search begins near the mean place."""
    n, near = w.sum(), 1 + 1e-9
    start = _hav_np(np.average(lat, weights=w), np.average(lon, weights=w), lat, lon)
    bound, left = np.zeros(len(lat)), np.ones(len(lat), bool)
    best = None
    while True:
        rest = np.flatnonzero(left if best is None else left & (bound <= best[0] * near))
        if not len(rest):
            return best[2]
        if len(rest) > batch:
            rest = rest[np.lexsort((start[rest], bound[rest]))[:batch]] if best is None else rest[np.argpartition(bound[rest], batch)[:batch]]
        for i in rest:
            d = _hav_np(lat[i], lon[i], lat, lon)
            total = float((w * d).sum())
            np.maximum(bound, np.abs(total - n * d), out=bound)
            if best is None or (total, ids[i]) < best[:2]:
                best = (total, ids[i], int(i))
        left[rest] = False


def _medoids_local(loc: DataFrame, group: list[str]) -> DataFrame:
    """Medoids of groups of at most LOCAL_POINTS places, a group in a task, the groups spread over the tasks."""
    keys = [f"_g{i}" for i in range(len(group))]
    named = loc.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "_id", F.col("lat").cast("double").alias("_la"),
                       F.col("lon").cast("double").alias("_lo"), F.col("_w"))
    types = {f.name: f.dataType.simpleString() for f in named.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i = medoid_of_group(pdf["_la"].to_numpy(), pdf["_lo"].to_numpy(), pdf["_w"].to_numpy(float), pdf["_id"].to_numpy())
        return pdf.iloc[[i]][[*keys, "_id", "_la", "_lo"]]

    spread = int(loc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number, since adaptive coalescing by bytes would leave few tasks
    found = named.repartition(spread, *keys).groupBy(*keys).applyInPandas(run, schema=", ".join(f"{k} {types[k]}" for k in [*keys, "_id", "_la", "_lo"]))
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], F.col("_id").alias("medoid_id"),
                        F.col("_la").alias("medoid_lat"), F.col("_lo").alias("medoid_lon"))


def medoids(points: DataFrame, group: list[str], pid: str = "pdv_id", side: int = 32, batch: int = 64,
            local: int | None = None) -> DataFrame:
    """Exact medoid (smallest total haversine distance, ties by id) per group.

    Points at one place count as one place with their number.  Groups of at most `local`
    (LOCAL_POINTS) places, counted first, are searched in one task each; larger ones by jobs
    over all tasks.  Cell summaries give every
    place a lower bound and leave out those that cannot win.  Then in rounds: the places
    with the smallest bounds (`batch` a group, twice as many each round) get their exact
    totals, and a total S at distance d from a place raises its bound to |S - n d|, again by
    the triangle inequality.  The search ends when no bound is below the best total, after
    about the square root of n totals on points that spread over an area; nothing is cut off.
    Points without a coordinate and groups without any are left out.
    """
    pts = points.select(*group, pid, "lat", "lon").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    pts = pts.dropna(subset=group)
    loc = cut_lineage(pts.groupBy(*group, "lat", "lon").agg(F.count(F.lit(1)).alias("_w"), F.min(pid).alias("_id")))
    large = cut_lineage(loc.groupBy(*group).count().filter(F.col("count") > (LOCAL_POINTS if local is None else local)).select(*group))
    if large.isEmpty():
        return cut_lineage(_medoids_local(loc, group))
    small = cut_lineage(_medoids_local(loc.join(large, group, "left_anti"), group))
    loc = cut_lineage(loc.join(large, group))
    n = loc.groupBy(*group).agg(F.sum("_w").alias("_n"))
    b = _cell_bounds(loc, group, side)
    t = b.groupBy(*group).agg(F.min("_ub").alias("_t"))
    near = 1 + 1e-9  # totals of equal places differ by rounding
    left = b.join(t, group).filter(F.col("_lb") <= F.col("_t") * near).select(*group, "_id", "lat", "lon", "_lb")
    best = None
    while True:
        left = ranked(left, group, ["_lb", "_id"], out="_rk")
        pick = left.filter(F.col("_rk") <= batch).groupBy(*group).agg(
            F.collect_list(F.struct("_id", "lat", "lon")).alias("_p"))  # at most `batch` a group
        tried = loc.join(pick, group).select(*group, "_w", F.col("lat").alias("_la"), F.col("lon").alias("_lo"), F.explode("_p").alias("p"))
        tried = cut_lineage(tried.groupBy(*group, "p._id", "p.lat", "p.lon")
                            .agg(F.sum(F.col("_w") * haversine_km("p.lat", "p.lon", "_la", "_lo")).alias("_s"))
                            .toDF(*group, "_id", "lat", "lon", "_s"))
        now = tried.groupBy(*group).agg(F.min(F.struct("_s", "_id", "lat", "lon")).alias("_m"))
        if best is not None:
            now = best.unionByName(now).groupBy(*group).agg(F.min("_m").alias("_m"))
        best = cut_lineage(now)
        known = tried.groupBy(*group).agg(F.collect_list(F.struct("lat", "lon", "_s")).alias("_p")).join(n, group).join(best, group)
        bound = F.aggregate("_p", F.col("_lb"), lambda acc, y: F.greatest(acc, F.abs(
            y["_s"] - F.col("_n") * haversine_km(F.col("lat"), F.col("lon"), y["lat"], y["lon"]))))
        left = (left.filter(F.col("_rk") > batch).drop("_rk").join(known, group).withColumn("_lb", bound)
                .filter(F.col("_lb") <= F.col("_m._s") * near).select(*group, "_id", "lat", "lon", "_lb"))
        left = cut_lineage(left)
        if left.isEmpty():
            break
        batch = min(2 * batch, 1024)
    return best.select(*group, F.col("_m._id").alias("medoid_id"), F.col("_m.lat").alias("medoid_lat"), F.col("_m.lon").alias("medoid_lon")).unionByName(small)


def dense_subset(points: DataFrame, cap: int, group: list[str], pid: str = "pdv_id") -> DataFrame:
    """C-12: per group, the `cap` points nearest the medoid (ties by id); groups
    with at most `cap` points are returned whole."""
    n = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    big = points.join(n.filter(F.col("_n") > cap).select(*group), group)
    small = points.join(n.filter(F.col("_n") <= cap).select(*group), group)
    m = medoids(big, group, pid)
    d = big.join(m, group).withColumn("dist_medoide_km", haversine_km("lat", "lon", "medoid_lat", "medoid_lon"))
    r = ranked(d, group, ["dist_medoide_km", pid], out="_rk").filter(F.col("_rk") <= cap)
    out = r.select(*points.columns, "medoid_id", "dist_medoide_km")
    return out.unionByName(small.select(*points.columns, F.lit(None).cast("long").alias("medoid_id"),
                                        F.lit(None).cast("double").alias("dist_medoide_km")))


# ----------------------------------------------------------------- C-08 / C-10
def kmeans_balanced(points: DataFrame, group: list[str], k: DataFrame, cap: int, kmh: float,
                    service_min: float, tempo_max_min: float, pid: str = "pdv_id",
                    lloyd_iter: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """C-08: Lloyd, then every cluster above `cap` is split once into ceil(n/cap)
    (grouped Lloyd keyed by the parent label); a route estimate (nearest-neighbour
    tour from the cluster centre + service) marks each cluster OK or EXCEDIDO.
    Returns (points with cluster_id, clusters with n, route minutes, status)."""
    from .routing import route_legs, leg_costs, route_totals, sequence_stops
    from .windows import dense_relabel
    res, _ = kmeans(points, k, group, pid=pid, max_iter=lloyd_iter)
    res = cut_lineage(res.select(*group, pid, "lat", "lon", F.col("c").alias("_parent")))
    sizes = res.groupBy(*group, "_parent").agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > cap).select(*group, "_parent",
                                                 F.ceil(F.col("_n") / F.lit(float(cap))).cast("int").alias("k"))
    sub_pts = res.join(big.select(*group, "_parent"), [*group, "_parent"])
    sub, _ = kmeans(sub_pts, big, [*group, "_parent"], pid=pid, max_iter=lloyd_iter)
    split = sub.select(*group, pid, "lat", "lon", F.concat_ws(".", F.col("_parent").cast("string"),
                                                             F.col("c").cast("string")).alias("_label"))
    keep = res.join(big.select(*group, "_parent"), [*group, "_parent"], "left_anti").select(
        *group, pid, "lat", "lon", F.lpad(F.col("_parent").cast("string"), 6, "0").alias("_label"))
    allp = split.withColumn("_label", F.concat(F.lpad(F.split_part(F.col("_label"), F.lit("."), F.lit(1)), 6, "0"),
                                               F.lit("."), F.split_part(F.col("_label"), F.lit("."), F.lit(2))))
    allp = cut_lineage(dense_relabel(allp.unionByName(keep), "_label", group))
    route = [*group, "cluster_id"]
    dep = allp.groupBy(*route).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    seq = sequence_stops(allp, dep, route, route, pid=pid).join(allp.select(pid, "lat", "lon"), pid)
    tot = route_totals(leg_costs(route_legs(seq, dep, route, route), None, kmh, 1.0), route, service_min)
    status = tot.select(*route, "n_pdvs", "tempo_total_min",
                        F.when(F.col("tempo_total_min") > tempo_max_min, F.lit("EXCEDIDO")).otherwise(F.lit("OK"))
                        .alias("status"))
    return allp.drop("_label"), status


def mean_of(v: np.ndarray) -> float:
    """The mean of the known values, NaN without any."""
    v = v[~np.isnan(v)]
    return float(v.mean()) if len(v) else np.nan


def _trees(points: DataFrame, roots: list[str], pid: str, tree, out: list[str]) -> DataFrame:
    """`tree` over the points of every root cluster, a root in a task, the roots spread over the tasks.

    `tree` sees the columns of `roots`, _id, _lat and _lon and returns them with `status`."""
    rows = points.select(*roots, F.col(pid).alias("_id"), F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", status string"
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by number, since adaptive coalescing by bytes would leave few tasks
    done = cut_lineage(rows.repartition(max(spread, 64), *roots).groupBy(*roots).applyInPandas(tree, schema=schema))
    return done.select(*out[:-1], F.col("_id").alias(pid), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), out[-1])


def recluster_recursive(points: DataFrame, group: list[str], label: str, cap: int, tempo_max_min: float,
                        kmh: float, pid: str = "pdv_id", local: int | None = None) -> DataFrame:
    """C-10: clusters over the size limit max(4, cap) or the time limit are split
    in two until every cluster fits or cannot be split (one point, or all points
    in one place): clusters of at most `local` (LOCAL_POINTS) points, counted first, in one
    task each, larger ones level by level (all of a level in one job); labels grow hierarchically (`3.1.0`).  Leaves that still fail are
    kept with status EXCEDIDO (Q11), the others are OK."""
    limit = max(4, cap)
    local = LOCAL_POINTS if local is None else local
    key = [*group, "_lab"]
    cur = cut_lineage(points.select(*group, pid, "lat", "lon", F.col(label).cast("string").alias("_lab"),
                                    F.lit(False).alias("_whole")))

    def over(lat: np.ndarray, lon: np.ndarray) -> bool:
        """The verdict of the rounds on one cluster; a missing time is not over the limit."""
        clat, clon = mean_of(lat), mean_of(lon)
        km = _hav_np(lat, lon, clat, clon)
        far = np.nanmax(km) if (~np.isnan(km)).any() else 0.0
        return len(lat) > limit or bool((far / kmh * 60.0 if kmh > 0 else SLOW_MINUTES) > tempo_max_min)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, ids = pdf["_lat"].to_numpy(float), pdf["_lon"].to_numpy(float), pdf["_id"]
        labels, status = np.empty(len(pdf), object), np.empty(len(pdf), object)
        todo = [(np.arange(len(pdf)), pdf["_lab"].iloc[0], bool(pdf["_whole"].iloc[0]))]
        while todo:
            rows, name, whole = todo.pop()
            x, y = lat[rows], lon[rows]
            bad = over(x, y)
            if bad and not whole and len(rows) >= 2:
                c = lloyd_of_group(x, y, None, ids.iloc[rows].reset_index(drop=True), 2, MAX_ROUNDS, False)[0]
                parts = np.unique(c)
                if len(parts) > 1:
                    todo.extend((rows[c == i], f"{name}.{i}", False) for i in parts)
                    continue
            labels[rows], status[rows] = name, "EXCEDIDO" if bad else "OK"
        return pdf.assign(_lab=labels, status=status)

    ended = None
    while True:
        # clusters that a task holds are split to the end there, many at once; larger ones level by level
        sizes = cut_lineage(cur.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > local).select(*key))
        many = not sizes.isEmpty()
        small = cur.join(sizes, key, "left_anti") if many else cur
        done = _trees(small.dropna(subset=key), [*key, "_whole"], pid, tree, [*key, "status"])
        ended = done if ended is None else ended.unionByName(done)
        if not many:
            break
        cur = cur.join(sizes, key)
        cen = cur.groupBy(*key, "_whole").agg(F.avg("lat").alias("_clat"), F.avg("lon").alias("_clon"),
                                              F.count(F.lit(1)).alias("_n"))
        fit = cur.drop("_whole").join(cen, key).groupBy(*key, "_n", "_whole").agg(
            F.max(travel_min(haversine_km("lat", "lon", "_clat", "_clon"), kmh)).alias("_t"))
        fit = cut_lineage(fit.select(*key, "_n", "_whole",
                                     ((F.col("_n") > limit) | (F.col("_t") > tempo_max_min)).alias("_over")))
        bad = fit.filter(F.col("_over") & ~F.col("_whole") & (F.col("_n") >= 2)).select(*key, F.lit(2).alias("k"))
        status = F.when(F.col("_over"), F.lit("EXCEDIDO")).otherwise(F.lit("OK")).alias("status")
        rest = cur.join(bad.select(*key), key, "left_anti").join(fit.select(*key, status), key)
        ended = ended.unionByName(rest.select(*ended.columns))
        if bad.isEmpty():
            break
        res, _ = kmeans(cur.join(bad.select(*key), key), bad, key, pid=pid)
        res = cut_lineage(res.select(*key, pid, "lat", "lon", "c"))
        parts = res.groupBy(*key).agg((F.min("c") == F.max("c")).alias("_whole"))
        split = res.join(parts, key).select(
            *group, pid, "lat", "lon",
            F.when(F.col("_whole"), F.col("_lab")).otherwise(F.concat_ws(".", F.col("_lab"), F.col("c").cast("string"))).alias("_lab"),
            "_whole")
        cur = cut_lineage(split)
    return ended.withColumnRenamed("_lab", "cluster_label")


# ----------------------------------------------------------------- C-09 / C-10 by tours
def _tour_status(points: DataFrame, centres: DataFrame, key: list[str], max_min: float, max_km: float, kmh: float,
                 service_min: float, pid: str) -> DataFrame:
    """key, centre, n_pdvs, dist_km, tempo_min, status of every cluster: its nearest-neighbour tour from the centre and back."""
    from .routing import sequence_stops, tour_costs
    seq = sequence_stops(points, centres, key, key, pid=pid).join(points.select(*key, pid, "lat", "lon"), [*key, pid])
    cost = tour_costs(seq, centres, key, key, kmh, service_min)
    over = (F.col("tempo_min") > max_min) | (F.col("dist_km") > max_km)
    return cost.join(centres.select(*key, F.col("lat").alias("centro_lat"), F.col("lon").alias("centro_lon")), key) \
        .withColumn("status", F.when(over, F.lit("EXCEDIDO")).otherwise(F.lit("OK")))


def _first_macro(keys: list[str], n_sub: int, max_min: float, max_km: float, kmh: float, service_min: float):
    """The first k of a chunk whose sub-clusters' tours all fit, or may, null if each k has one that does not.

    Large macro clusters come first and the service time before the tour, so most k end after one Lloyd run and a small one.
    Tours within rounding of a limit, and those of points without coordinates, are left to the plan."""
    def over(n: int, km: float, minutes: float) -> bool:
        return minutes > max_min + 0.01 or km > max_km + 0.01

    def ruled_out(lat, lon, ids: pd.Series, macro: np.ndarray) -> bool:
        number = ids.to_numpy()
        order = np.argsort(macro, kind="stable")
        parts = sorted(np.split(order, np.flatnonzero(np.diff(macro[order])) + 1), key=len, reverse=True)
        if len(parts[0]) * service_min > n_sub * (max_min + 0.01):
            return True  # one of its sub-clusters has more stops than the minutes allow
        tours = []
        for rows in parts:
            x, y = lat[rows], lon[rows]
            c, _, names, cs = lloyd_of_group(x, y, None, ids.iloc[rows].reset_index(drop=True), min(len(rows), n_sub), MAX_ROUNDS, False)
            at = {int(i): p for i, p in zip(names, cs)}
            for i in np.unique(c):
                own = c == i
                if own.sum() * service_min > max_min + 0.01:
                    return True
                tours.append((rows[own], at[int(i)]))
        for rows, centre in sorted(tours, key=lambda t: len(t[0]), reverse=True):
            if not np.isnan([lat[rows], lon[rows]]).any() and over(*tour_of(lat[rows], lon[rows], number[rows], *centre, kmh, service_min)):
                return True
        return False

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, ids = pdf["_lat"].to_numpy(float), pdf["_lon"].to_numpy(float), pdf["_id"]
        found = None
        for k in range(int(pdf["_from"].iloc[0]), int(pdf["_to"].iloc[0]) + 1):
            if not ruled_out(lat, lon, ids, lloyd_of_group(lat, lon, None, ids, k, MAX_ROUNDS, False)[0]):
                found = k
                break
        res = pdf.iloc[[0]][[*keys]].copy()
        res["_k"] = pd.array([found], dtype="Int64")
        return res

    return first


def least_possible_macro(points: DataFrame, group: list[str], pending: DataFrame, n_sub: int, max_min: float, max_km: float,
                         kmh: float, service_min: float, pid: str, chunk: int = 4, chunks: int = 4) -> DataFrame:
    """group, _n, _k0 with `_k0` raised to the first number of macro clusters, from `_k0` on, that is not ruled out (or n).

    Chunks of a few k, a chunk in a task, all groups at once; groups whose k are all ruled
    out go on, with twice as many chunks each time."""
    keys = [f"_g{i}" for i in range(len(group))]
    spread = max(64, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pts = cut_lineage(points.select(*group, F.col(pid).alias("_id"), F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
                      .join(pending.select(*group), group).repartition(spread))
    test = _first_macro([*keys, "_from"], n_sub, max_min, max_km, kmh, service_min)
    found, left = pending.limit(0), pending
    while not left.isEmpty():
        jobs = left.withColumn("_from", F.explode(F.sequence("_k0", F.least(F.col("_k0") + (chunk * chunks - 1), F.col("_n")), F.lit(chunk).cast("long"))))
        jobs = jobs.select(*group, "_from", F.least(F.col("_from") + (chunk - 1), F.col("_k0") + (chunk * chunks - 1), F.col("_n")).alias("_to"))
        rows = pts.join(jobs, group).select(*[F.col(g).alias(n) for g, n in zip(group, keys)], "_id", "_lat", "_lon", "_from", "_to")
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        # by number, since adaptive coalescing by bytes would leave few tasks
        done = rows.repartition(max(spread, 16 * chunks), *keys, "_from").groupBy(*keys, "_from").applyInPandas(
            test, schema=", ".join(f"{n} {types[n]}" for n in [*keys, "_from"]) + ", _k long")
        best = cut_lineage(done.groupBy(*keys).agg(F.min("_k").alias("_k")).select(*[F.col(n).alias(g) for g, n in zip(group, keys)], "_k"))
        left = left.join(best, group).withColumn("_next", F.coalesce("_k", F.least(F.col("_k0") + chunk * chunks, F.col("_n"))))
        left = cut_lineage(left.withColumn("_end", F.col("_k").isNotNull() | (F.col("_next") >= F.col("_n"))).select(*group, "_n", F.col("_next").alias("_k0"), "_end"))
        found = found.unionByName(left.filter("_end").drop("_end"))
        left = left.filter(~F.col("_end")).drop("_end")
        chunks = min(2 * chunks, 16)
    return cut_lineage(found)


def refine_macro(points: DataFrame, group: list[str], k_start: DataFrame, n_sub: int, max_min: float, max_km: float,
                 kmh: float, service_min: float, pid: str = "pdv_id", batch: int = 2,
                 local: int = LOCAL_POINTS) -> tuple[DataFrame, DataFrame]:
    """C-09: the smallest number k of macro clusters per group, from `k_start` on, for which every
    sub-cluster's tour fits `max_min` and `max_km`; a macro cluster has min(size, `n_sub`)
    sub-clusters.  k ends at the number of points; then tours that still do not fit are
    EXCEDIDO.

    In groups of at most `local` points, counted first, `least_possible_macro` finds the first
    k that is not ruled out, and only that is planned; if its plan does not fit, the search goes
    on behind it.  In larger ones several candidate k are planned at once.
    Planning is two nested grouped Lloyd runs, keyed (group, k) and (group, k, macro), with
    all groups in the same jobs; only groups without a feasible k go on.  Returns (sub-clusters with centre, tour, status and k_final; point -> macro, sub).
    Macro labels are 0.. without gaps, subs count from 1.
    """
    n = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    pending = cut_lineage(n.join(k_start.select(*group, F.col("k").cast("int").alias("_k0")), group)
                          .select(*group, "_n", F.least(F.greatest("_k0", F.lit(1)), F.col("_n")).cast("long").alias("_k0")))
    macro, sub = [*group, "k"], [*group, "k", "macro"]
    routes_out = members_out = None
    while not pending.isEmpty():
        some = least_possible_macro(points, group, pending.filter(F.col("_n") <= local), n_sub, max_min, max_km, kmh, service_min, pid)
        pending = pending.filter(F.col("_n") > local).unionByName(some.select(*pending.columns))
        pending = cut_lineage(pending.withColumn("_several", F.when(F.col("_n") <= local, F.lit(1)).otherwise(F.lit(batch))))
        cands = cut_lineage(pending.withColumn("k", F.explode(F.sequence("_k0", F.least(F.col("_k0") + F.col("_several") - 1, F.col("_n")))))
                            .select(*group, F.col("k").cast("int").alias("k"), "_n"))
        assigned, _ = kmeans(points.select(*group, pid, "lat", "lon").join(cands.select(*macro), group), cands.select(*macro), macro, pid=pid)
        assigned = cut_lineage(assigned.select(*macro, pid, "lat", "lon", F.col("c").alias("macro")))
        parts = assigned.groupBy(*sub).agg(F.least(F.count(F.lit(1)), F.lit(n_sub)).cast("int").alias("_k")).withColumnRenamed("k", "_macro_k")
        own = [*group, "_macro_k", "macro"]
        inner, centres = kmeans(assigned.withColumnRenamed("k", "_macro_k"), parts.withColumnRenamed("_k", "k"), own, pid=pid)
        key = [*sub, "seq"]
        inner = cut_lineage(inner.select(*group, F.col("_macro_k").alias("k"), "macro", (F.col("c") + 1).alias("seq"), pid, "lat", "lon"))
        centres = centres.select(*group, F.col("_macro_k").alias("k"), "macro", (F.col("c") + 1).alias("seq"), "lat", "lon")
        tours = cut_lineage(_tour_status(inner, centres, key, max_min, max_km, kmh, service_min, pid))
        fits = tours.groupBy(*macro).agg(F.bool_and(F.col("status") == "OK").alias("_fits")).join(cands, macro)
        pick = cut_lineage(fits.filter(F.col("_fits") | (F.col("k") >= F.col("_n"))).groupBy(*group).agg(F.min("k").cast("int").alias("k")))
        done, placed = tours.join(pick, macro), inner.join(pick, macro)
        routes_out = done if routes_out is None else routes_out.unionByName(done)
        members_out = placed if members_out is None else members_out.unionByName(placed)
        pending = cut_lineage(pending.join(pick.select(*group), group, "left_anti")
                              .select(*group, "_n", F.least(F.col("_k0") + F.col("_several"), F.col("_n")).alias("_k0")))
        batch *= 2
    # empty macro clusters leave gaps in the labels
    names = routes_out.groupBy(*group).agg(F.sort_array(F.collect_set("macro")).alias("_names"))
    relabel = (F.array_position("_names", F.col("macro")) - 1).cast("int")

    def named(df: DataFrame) -> DataFrame:
        return df.join(names, group).withColumn("macro", relabel).drop("_names").withColumnRenamed("k", "k_final")

    return named(routes_out), named(members_out).select(*group, pid, "k_final", "macro", "seq")


def tour_of(lat: np.ndarray, lon: np.ndarray, ids: np.ndarray, clat: float, clon: float, kmh: float, service_min: float) -> tuple[int, float, float]:
    """Stops, km and minutes (before rounding) of the nearest-neighbour tour from the centre and back, as `_tour_status`
    has them: there the stops of an id that repeats meet each other, and the next, once a pair."""
    order = nearest_neighbour_order(clat, clon, ids, lat, lon)
    _, same, copies = np.unique(ids, return_inverse=True, return_counts=True)
    times = copies[same][order]
    times[:-1] = times[:-1] * times[1:]
    x, y = np.concatenate([[clat], lat[order], [clat]]), np.concatenate([[clon], lon[order], [clon]])
    legs = _hav_np(x[:-1], y[:-1], x[1:], y[1:])
    km, n = float((legs[1:] * times).sum() + legs[0] * times[0]), int(times.sum())
    return n, km, km / kmh * 60.0 + n * service_min


def _route_tree(max_min: float, max_km: float, kmh: float, service_min: float, least: int):
    """`recluster_by_route` of one cluster to its end: its points with label, and, as rows
    without an id, the clusters with centre, tour and status."""
    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, ids = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float), pdf["_id"]
        first = pdf.iloc[0]
        labels, status = np.empty(len(pdf), object), np.empty(len(pdf), object)
        todo = [(np.arange(len(pdf)), first["cluster_label"], int(first["_div"]), first["_clat"], first["_clon"])]
        found = []
        while todo:
            rows, name, div, clat, clon = todo.pop()
            x, y, n = lat[rows], lon[rows], len(rows)
            may = n > least and div > 0
            # the service time alone decides on most clusters that are split
            bad = may and n * service_min > max_min + 0.01
            if not bad:
                stops, km, minutes = tour_of(x, y, ids.to_numpy()[rows], clat, clon, kmh, service_min)
                km, minutes = (float(v) for v in half_up(np.array([km, minutes]), 2))
                over = minutes > max_min or km > max_km
                bad = may and over
            if bad:
                c, _, names, cs = lloyd_of_group(x, y, None, ids.iloc[rows].reset_index(drop=True), div, MAX_ROUNDS, False)
                parts = np.unique(c)
                at = {int(i): p for i, p in zip(names, cs)}
                after = 0 if len(parts) == 1 else div + 1
                todo.extend((rows[c == i], f"{name}.{i + 1}", after, at[i][0], at[i][1]) for i in parts)
                continue
            labels[rows] = name
            status[rows] = "EXCEDIDO" if over else "OK"
            found.append((name, clat, clon, stops, km, minutes, status[rows[0]]))
        members = pdf.assign(cluster_label=labels, status=status, n_pdvs=0, dist_km=np.nan, tempo_min=np.nan, _cluster=False)
        ends = pd.DataFrame(found, columns=["cluster_label", "_clat", "_clon", "n_pdvs", "dist_km", "tempo_min", "status"])
        for c in pdf.columns:
            if c not in ends:
                ends[c] = first[c]
        return pd.concat([members, ends.assign(_cluster=True)[members.columns]], ignore_index=True)

    return cut


def recluster_by_route(points: DataFrame, group: list[str], label: str, cap: int, max_min: float, max_km: float, kmh: float,
                       service_min: float, pid: str = "pdv_id", local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """C-10: clusters whose tour does not fit `max_min` or `max_km` are split in 2, their failing
    parts in 3, and so on: clusters of at most `local` (LOCAL_POINTS) points, counted first,
    to their end in one task each, larger ones with all of a level in one job; labels grow by
    `.1`, `.2`.  A cluster whose service time alone is past `max_min` is split without a tour.  A cluster of max(4, `cap`) points or fewer, or whose points no split
    separates, is not split again and stays with status EXCEDIDO.

    Returns (point -> cluster_label; clusters with centre, tour, divisions and status).
    """
    key = [*group, "cluster_label"]
    cur = cut_lineage(points.select(*group, pid, "lat", "lon", F.col(label).cast("string").alias("cluster_label"), F.lit(2).alias("_div")))
    centres = cur.groupBy(*key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    members, clusters = [], []
    local = LOCAL_POINTS if local is None else local
    tree = _route_tree(max_min, max_km, kmh, service_min, max(4, cap))
    spread = max(64, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        size = cut_lineage(cur.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_div").alias("_div")))
        inside = cur.drop("_div").join(size.filter(F.col("_n") <= local).select(*key, "_div"), key).join(
            centres.select(*key, F.col("lat").alias("_clat"), F.col("lon").alias("_clon")), key)
        inside = inside.select(*key, F.col(pid).alias("_id"), F.col("lat").cast("double"), F.col("lon").cast("double"), "_div", "_clat", "_clon")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inside.schema.fields) \
            + ", status string, n_pdvs long, dist_km double, tempo_min double, _cluster boolean"
        done = cut_lineage(inside.repartition(spread, *key).groupBy(*key).applyInPandas(tree, schema=schema))
        members.append(done.filter(~F.col("_cluster")).select(*group, F.col("_id").alias(pid), "cluster_label", "status"))
        clusters.append(done.filter("_cluster").select(*key, F.col("_clat").alias("centro_lat"), F.col("_clon").alias("centro_lon"),
                                                       "n_pdvs", "dist_km", "tempo_min", "status"))
        size = size.filter(F.col("_n") > local)
        if size.isEmpty():
            break
        cur = cut_lineage(cur.join(size.select(*key), key))
        sure = F.col("_n") * F.lit(float(service_min)) > F.lit(max_min + 0.01)
        split_anyway = sure & (F.col("_n") > max(4, cap)) & (F.col("_div") > 0)
        toured = cur.join(size.filter(~split_anyway).select(*key), key)
        tours = cut_lineage(_tour_status(toured, centres, key, max_min, max_km, kmh, service_min, pid).join(size, key))
        # _div 0: the split that made this cluster did not separate its points
        bad = tours.filter((F.col("status") != "OK") & (F.col("_n") > max(4, cap)) & (F.col("_div") > 0)).select(*key, F.col("_div").alias("k"))
        bad = cut_lineage(bad.unionByName(size.filter(split_anyway).select(*key, F.col("_div").alias("k"))))
        ended = tours.join(bad.select(*key), key, "left_anti")
        clusters.append(ended.select(*key, "centro_lat", "centro_lon", "n_pdvs", "dist_km", "tempo_min", "status"))
        members.append(cur.join(ended.select(*key, "status"), key).select(*group, pid, "cluster_label", "status"))
        if bad.isEmpty():
            break
        split, found = kmeans(cur.join(bad.select(*key), key), bad, key, pid=pid)
        split = cut_lineage(split.select(*key, pid, "lat", "lon", "c").join(bad, key))
        whole = split.groupBy(*key).agg((F.min("c") == F.max("c")).alias("_whole"))
        part = F.concat_ws(".", F.col("cluster_label"), (F.col("c") + 1).cast("string"))
        cur = cut_lineage(split.join(whole, key).select(*group, pid, "lat", "lon", part.alias("cluster_label"),
                                                        F.when(F.col("_whole"), 0).otherwise(F.col("k") + 1).alias("_div")))
        centres = cut_lineage(found.select(*group, part.alias("cluster_label"), "lat", "lon"))
    all_members, all_clusters = members[0], clusters[0]
    for m, c in zip(members[1:], clusters[1:]):
        all_members, all_clusters = all_members.unionByName(m), all_clusters.unionByName(c)
    return all_members, all_clusters


# ----------------------------------------------------------------- C-19
def run_clustering(points: DataFrame, group: list[str], cap: int, tempo_max_min: float, kmh: float,
                   drop_outliers: bool = False, z: float = 1.5, pid: str = "pdv_id",
                   max_tries: int = 10) -> tuple[DataFrame, DataFrame]:
    """C-19: de-duplicate by (lat, lon, cnpj) keeping the last row, flag outliers
    (optionally drop them), capacity k-search, labels 0..k-1 per group, then the
    sectors with centre and metrics.  Returns (sectors, point -> sector)."""
    from .aggregates import cluster_metrics
    from .quality import flag_outliers
    from .windows import dense_relabel, keep_first
    d = keep_first(points.withColumn("_neg", -F.col(pid)), ["lat", "lon", "cnpj"], "_neg").drop("_neg")
    out = flag_outliers(d, z=z, pid=pid, by=tuple(group)).select(pid, "is_outlier")
    d = d.join(out, pid, "left").withColumn("is_outlier", F.coalesce("is_outlier", F.lit(False)))
    if drop_outliers:
        d = d.filter(~F.col("is_outlier"))
    d = cut_lineage(d)
    labeled = kmeans_capacity(d.select(*group, pid, "lat", "lon"), group, cap, tempo_max_min, kmh,
                              max_tries=max_tries, pid=pid)
    # a cluster that Lloyd leaves without a point has no sector, so the labels are numbered anew
    labeled = dense_relabel(labeled.withColumnRenamed("cluster_id", "_c"), "_c", group).drop("_c")
    cen = labeled.groupBy(*group, "cluster_id").agg(F.round(F.avg("lat"), 6).alias("centro_lat"),
                                                    F.round(F.avg("lon"), 6).alias("centro_lon"))
    j = labeled.join(cen, [*group, "cluster_id"]).withColumn(
        "dist_km", haversine_km("lat", "lon", "centro_lat", "centro_lon"))
    metrics = cluster_metrics(j, [*group, "cluster_id"], kmh)
    sectors = metrics.join(cen, [*group, "cluster_id"])
    mapping = labeled.join(d.select(pid, "is_outlier"), pid).select(*group, pid, "cluster_id", "is_outlier")
    return sectors, mapping


# ----------------------------------------------------------------- C-18
def active_balanced(points: DataFrame, centres: DataFrame, min_pdv: int, max_pdv: int, tempo_max_min: float,
                    kmh: float, merge_km: float, rounds: int = 10, pid: str = "pdv_id",
                    centre_id: str = "centro_id") -> tuple[DataFrame, DataFrame]:
    """C-18: fixed centres (already geocoded), one centre per distinct coordinate,
    every point to its nearest centre (J-07), balancing (C-16), labels 0..k-1
    (W-07) and per-sector metrics (A-01).  Returns (sectors, point -> sector)."""
    from .aggregates import cluster_metrics
    from .windows import dense_relabel, keep_first
    uniq = keep_first(centres.select(centre_id, "lat", "lon"), ["lat", "lon"], centre_id)
    cen = uniq.select(F.col(centre_id).alias("label"), "lat", "lon")
    start = nearest(points.select(pid, "lat", "lon"), cen, "label", out_id="label").select(pid, "lat", "lon", "label")
    a, kept = balance_points(start, cen, min_pdv, max_pdv, tempo_max_min, kmh, merge_km, rounds=rounds, pid=pid)
    a = dense_relabel(a, "label")
    j = a.join(kept.select("label", F.col("lat").alias("centro_lat"), F.col("lon").alias("centro_lon")), "label")
    j = j.withColumn("dist_km", haversine_km("lat", "lon", "centro_lat", "centro_lon"))
    sectors = cluster_metrics(j, ["cluster_id"], kmh, tie=pid).join(
        j.select("cluster_id", F.col("label").alias(centre_id), "centro_lat", "centro_lon").distinct(), "cluster_id")
    return sectors, a.select(pid, "cluster_id", F.col("label").alias(centre_id))
