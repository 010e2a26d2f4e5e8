"""Routes: daily route counts (R-01), stop order (R-02/R-03), leg and route cost
(R-04/R-05 with the leg cache J-13), splitting clusters into routes (R-06/R-07)
and the per-cluster summary (A-06)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import EARTH_RADIUS_KM, haversine_km, travel_min
from ..session import cut_lineage
from .windows import ranked

# The stop solver holds one route in memory.  Longer routes are divided into pieces of at
# most PIECE_STOPS stops, solved in parallel and joined (`sequence_long_routes`).
MAX_STOPS_PER_ROUTE = 20_000
PIECE_STOPS = 4_000
SEAM_STOPS = 100
SAME_POINT_DEG = 1e-5
CENTRE_DEG = 1e-4


def route_count(n, dias: int, freq: float, mode: str = "proporcional"):
    """R-01 as a Column over the cluster size `n`.

    proporcional: ceil(n * freq / dias); fixo: max(1, int(dias * freq));
    capacidade: max(1, floor(dias / freq)); never more routes than points.
    """
    n = F.col(n) if isinstance(n, str) else n
    if mode == "fixo":
        k = F.lit(max(1, int(dias * freq)))
    elif mode == "capacidade":
        if freq <= 0:
            raise ValueError("freq must be >= 1")
        k = F.lit(max(1, int(dias // freq)))
    else:
        k = F.greatest(F.lit(1), F.ceil(n * F.lit(float(freq)) / F.lit(float(dias))))
    return F.least(k.cast("long"), n.cast("long")).cast("int")


# ----------------------------------------------------------------- stop order
def _hav_np(lat1, lon1, lat2, lon2):
    dlat = np.radians(lat2 - lat1)
    dlon = np.radians(lon2 - lon1)
    a = np.sin(dlat / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(dlon / 2) ** 2
    return 2 * EARTH_RADIUS_KM * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))


def nearest_neighbour_order(depot_lat: float, depot_lon: float, ids: np.ndarray, lat: np.ndarray,
                            lon: np.ndarray) -> np.ndarray:
    """Greedy tour from the depot; ties (distance at 9 decimals) broken by id."""
    n = len(ids)
    at = np.arange(n)  # positions of the stops looked at: all that are left, and up to as many that are not
    left = np.ones(n, dtype=bool)
    order = np.empty(n, dtype=np.int64)
    cl, co = depot_lat, depot_lon
    for step in range(n):
        if len(at) > 64 and 2 * (n - step) <= len(at):
            at, ids, lat, lon, left = at[left], ids[left], lat[left], lon[left], left[left]
        d = np.round(_hav_np(cl, co, lat, lon), 9)
        d = np.where(left, d, np.inf)
        best = np.flatnonzero(d == d.min())
        pick = best[np.argmin(ids[best])]
        order[step] = at[pick]
        left[pick] = False
        cl, co = lat[pick], lon[pick]
    return order


def _tour_km(depot, pts, order):
    path = np.vstack([depot, pts[order], depot])
    return float(_hav_np(path[:-1, 0], path[:-1, 1], path[1:, 0], path[1:, 1]).sum())


def two_opt(depot: np.ndarray, pts: np.ndarray, order: np.ndarray, eps_km: float = 1e-3,
            end: np.ndarray | None = None) -> np.ndarray:
    """R-03: segment reversals until no move gains more than eps (local optimum, Q13).

    The tour leads from the depot back to it, or to `end`, a fixed last place.

    A reversal changes two edges only, so a move's gain is two old edges less
    two new ones.  For each start the gains of all ends are one vector; the
    best of them is taken.  The tour's coordinates are kept in tour order and
    no distance matrix is built, so memory is linear in the stops.
    """
    tour = np.concatenate([[-1], order, [-1]])
    xy = np.vstack([depot, pts[order], depot if end is None else end]).astype(float)
    stuck = 0
    i, n = 0, len(order)
    while n > 1 and stuck < n:
        a, b = xy[i], xy[i + 1]
        ends, after = xy[i + 2:-1], xy[i + 3:]
        if len(ends):
            gain = (_hav_np(a[0], a[1], b[0], b[1]) + _hav_np(ends[:, 0], ends[:, 1], after[:, 0], after[:, 1])
                    - _hav_np(a[0], a[1], ends[:, 0], ends[:, 1]) - _hav_np(b[0], b[1], after[:, 0], after[:, 1]))
            k = int(np.argmax(gain))
            if gain[k] > eps_km:
                cut = slice(i + 1, i + 3 + k)
                xy[cut], tour[cut] = xy[cut][::-1].copy(), tour[cut][::-1].copy()
                stuck = 0
                continue
        stuck += 1
        i = (i + 1) % n
    return tour[1:-1]


def _schema_of(df: DataFrame, keys: list[str], pid: str) -> str:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return f"{fields}, {pid} long, sequencia_ordem int"


def _order_of(route: list[str], pid: str, improve: bool, own=None):
    """Batches of stops sorted by route to their stop order, one route at a time; a route may go on in the next batch."""
    def solve(pdf: pd.DataFrame, at: np.ndarray, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        first = pdf.iloc[at[0]]
        ids, lat, lon = ids[at], lat[at], lon[at]
        dlat, dlon = float(first["depot_lat"]), float(first["depot_lon"])
        if own is not None:
            order = np.asarray(own((dlat, dlon), ids, np.column_stack([lat, lon])), dtype=np.int64)
            if len(order) != len(ids) or not np.array_equal(np.sort(order), np.arange(len(ids))):
                raise ValueError("a solver must return every position of its stops once")
        else:
            order = nearest_neighbour_order(dlat, dlon, ids, lat, lon)
        if improve and len(order) > 3:
            end = np.array([first["end_lat"], first["end_lon"]], float) if "end_lat" in pdf else None
            order = two_opt(np.array([dlat, dlon]), np.column_stack([lat, lon]), order, end=end)
        return at[order]

    def ordered(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids = pdf[pid].to_numpy(dtype=np.int64)
        lat, lon = pdf["lat"].to_numpy(dtype=float), pdf["lon"].to_numpy(dtype=float)
        runs = np.split(np.arange(len(pdf)), starts[1:])
        way = np.concatenate([solve(pdf, at, ids, lat, lon) for at in runs])
        res = pdf.iloc[way][list(route)].copy()
        res[pid] = ids[way]
        res["sequencia_ordem"] = np.concatenate([np.arange(1, len(at) + 1, dtype=np.int32) for at in runs])
        return res

    def run(batches):
        held = None  # stops of a route that may go on
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            number = pdf.groupby(route, sort=False, dropna=False).ngroup().to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
            done, held = pdf.iloc[:starts[-1]], pdf.iloc[starts[-1]:]
            if len(done):
                yield ordered(done, starts[:-1])
        if held is not None:
            yield ordered(held, np.array([0]))

    return run


def _in_order(stops: DataFrame, route: list[str], pid: str, improve: bool, own=None) -> DataFrame:
    """Stop order of every route, each in one task; from (depot_lat, depot_lon) back to it, or on to (end_lat, end_lon) where given.

    Many short routes share a task, without the cost of a group each."""
    # by number, since adaptive coalescing by bytes would leave few tasks
    parts = max(64, int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = stops.repartition(parts, *route).sortWithinPartitions(*route)
    return dealt.mapInPandas(_order_of(route, pid, improve, own), schema=_schema_of(stops, route, pid))


def sequence_stops(stops: DataFrame, depots: DataFrame, route: list[str], depot_keys: list[str],
                   pid: str = "pdv_id", improve: bool = False, limit: int = MAX_STOPS_PER_ROUTE,
                   piece: int = PIECE_STOPS, solver=None) -> DataFrame:
    """R-02 (+R-03): stop order 1..n of every route, all routes in parallel.

    `solver` (N-03) replaces the nearest neighbour: a function of the depot (lat, lon), the
    stops' ids and their (lat, lon) rows that returns the stops' positions in visiting order.
    It sees one route of at most `limit` stops; longer routes keep the library's own order.

    A task holds one route of at most `limit` stops at a time; sizes are counted
    first, so no route can exceed what a task may hold, and longer routes go through
    `sequence_long_routes`.
    """
    d = depots.select(*depot_keys, F.col("lat").alias("depot_lat"), F.col("lon").alias("depot_lon"))
    s = stops.select(*route, *[k for k in depot_keys if k not in route], pid, "lat", "lon").join(d, depot_keys)
    long = cut_lineage(s.groupBy(*route).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit))
    if long.isEmpty():
        return _in_order(s, route, pid, improve, solver)
    short = s.join(long.select(*route), route, "left_anti")
    done = _in_order(short, route, pid, improve, solver)
    return done.unionByName(sequence_long_routes(s.join(long, route), route, pid, improve, limit, piece))


def _tiles(stops: DataFrame, route: list[str], pid: str, piece: int) -> DataFrame:
    """`_t`: tiles of at most `piece` stops and near-equal size, by strips of longitude cut by latitude.

    Ranks are distributed, so one route with most of the stops is spread as well.
    """
    p = F.ceil(F.col("_n") / F.lit(piece))
    strips = F.ceil(F.sqrt(p))
    s = ranked(stops.withColumns({"_strips": strips, "_cuts": F.ceil(p / strips)}), route, ["lon", "lat", pid], out="_r")
    s = s.withColumn("_strip", F.floor((F.col("_r") - 1) * F.col("_strips") / F.col("_n")))
    m = s.groupBy(*route, "_strip").agg(F.count(F.lit(1)).alias("_m"))
    s = ranked(s.drop("_r").join(m, [*route, "_strip"]), [*route, "_strip"], ["lat", "lon", pid], out="_r")
    # rounding may give a strip a few stops more than its share: cut it so that no tile exceeds the bound
    cuts = F.greatest(F.col("_cuts"), F.ceil(F.col("_m") / F.lit(piece)))
    t = F.col("_strip") * 1_000_000 + F.floor((F.col("_r") - 1) * cuts / F.col("_m"))
    return s.withColumn("_t", t.cast("long")).drop("_r", "_m", "_strip", "_strips", "_cuts")


def sequence_long_routes(stops: DataFrame, route: list[str], pid: str, improve: bool, limit: int, piece: int) -> DataFrame:
    """Stop order of routes that no single task should hold.

    Divide (tiles of at most `piece` stops), order the tiles by a tour over their
    centres from the depot, solve every tile in parallel as a path from the centre of
    the tile before to that of the tile behind, and join them in that order.  The
    seams are mended: the stops around each border are improved by segment
    reversals with the stops outside them fixed, so a seam never gets longer.
    `stops` carries depot_lat, depot_lon and the route's size `_n`.
    """
    tiled = cut_lineage(_tiles(stops.select(*route, pid, "lat", "lon", "depot_lat", "depot_lon", "_n"), route, pid, piece))
    depot = tiled.groupBy(*route).agg(F.min("depot_lat").alias("lat"), F.min("depot_lon").alias("lon"))
    centre = cut_lineage(tiled.groupBy(*route, "_t").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("_m")))
    tour = sequence_stops(centre, depot, route, route, pid="_t", improve=True, limit=limit, piece=piece)
    tour = tour.join(centre, [*route, "_t"])
    w = Window.partitionBy(*route).orderBy("sequencia_ordem")  # one row a tile
    ends = depot.select(*route, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    tour = cut_lineage(tour.join(ends, route).select(
        *route, "_t", F.col("sequencia_ordem").alias("_at"), "_m",
        F.coalesce(F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.coalesce(F.lag("lat").over(w), "_dlat").alias("depot_lat"), F.coalesce(F.lag("lon").over(w), "_dlon").alias("depot_lon"),
        F.coalesce(F.lead("lat").over(w), "_dlat").alias("end_lat"), F.coalesce(F.lead("lon").over(w), "_dlon").alias("end_lon")))
    paths = tiled.select(*route, "_t", pid, "lat", "lon").join(tour.select(*route, "_t", "depot_lat", "depot_lon", "end_lat", "end_lon"), [*route, "_t"])
    key = [*route, "_t"]
    solved = _in_order(paths, key, pid, improve)
    placed = solved.join(tour.select(*key, "_at", "_m", "_before"), key).join(tiled.select(*key, pid, "lat", "lon"), [*key, pid]) \
        .withColumn("_pos", F.col("_before") + F.col("sequencia_ordem"))
    placed = cut_lineage(placed)

    # A seam is the border behind tile _at: its last stops and the first of the next tile, at most
    # a quarter of a tile each, so that no stop is in two seams.  One stop more on each side is fixed.
    near = F.least(F.lit(SEAM_STOPS), F.floor(F.col("_m") / 4))
    tail = placed.filter(F.col("sequencia_ordem") > F.col("_m") - near).withColumn("_seam", F.col("_at"))
    head = placed.filter(F.col("sequencia_ordem") <= near).withColumn("_seam", F.col("_at") - 1)
    seam = tail.unionByName(head).select(*route, "_seam", "_pos", pid, "lat", "lon")

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        inner = pdf.iloc[1:-1]
        res = inner[[*route, pid]].copy()
        res["_new"] = inner["_pos"].to_numpy()
        if len(inner) > 1:
            xy = pdf[["lat", "lon"]].to_numpy(float)
            order = two_opt(xy[0], xy[1:-1], np.arange(len(inner)), end=xy[-1])
            res[pid] = inner[pid].to_numpy()[order]
        return res

    fields = _schema_of(placed, route, pid).rsplit(",", 1)[0]
    mended = seam.groupBy(*route, "_seam").applyInPandas(mend, schema=f"{fields}, _new long")
    out = placed.select(*route, pid, "_pos").join(mended, [*route, pid], "left")
    return out.select(*route, pid, F.coalesce("_new", "_pos").cast("int").alias("sequencia_ordem"))


def tour_costs(seq: DataFrame, depots: DataFrame, route: list[str], depot_keys: list[str], kmh: float,
               service_min: float, order: str = "sequencia_ordem") -> DataFrame:
    """km and minutes of the closed tour depot -> stops in order -> depot, both with 2 decimals.

    Great-circle km at a constant speed plus the service time of every stop.  Each stop
    meets the next by its number, an equi-join, so a long route needs no window.
    """
    d = depots.select(*depot_keys, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    here = seq.select(*route, *[k for k in depot_keys if k not in route], F.col(order).cast("long").alias("_o"), "lat", "lon")
    after = here.select(*route, (F.col("_o") - 1).alias("_o"), F.col("lat").alias("_nlat"), F.col("lon").alias("_nlon"))
    j = here.join(after, [*route, "_o"], "left").join(d, depot_keys)
    leg = haversine_km("lat", "lon", F.coalesce("_nlat", "_dlat"), F.coalesce("_nlon", "_dlon"))
    first = F.when(F.col("_o") == 1, haversine_km("_dlat", "_dlon", "lat", "lon")).otherwise(0.0)
    km = F.sum(leg + first)
    return j.groupBy(*route).agg(F.count(F.lit(1)).alias("n_pdvs"), F.round(km, 2).alias("dist_km"),
                                 F.round(km / F.lit(float(kmh)) * 60.0 + F.count(F.lit(1)) * F.lit(float(service_min)), 2).alias("tempo_min"))


# ----------------------------------------------------------------- leg costs
def route_legs(seq: DataFrame, depots: DataFrame, route: list[str], depot_keys: list[str],
               order: str = "sequencia_ordem") -> DataFrame:
    """Legs depot -> stop 1 -> ... -> stop n -> depot (W-08 `lag` plus a closing leg)."""
    d = depots.select(*depot_keys, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    s = seq.join(d, depot_keys)
    w = Window.partitionBy(*route).orderBy(order)
    legs = s.select(*route, F.col(order).alias("leg"),
                    F.coalesce(F.lag("lat").over(w), F.col("_dlat")).alias("a_lat"),
                    F.coalesce(F.lag("lon").over(w), F.col("_dlon")).alias("a_lon"),
                    F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"),
                    F.lead("lat").over(w).isNull().alias("_last"), "_dlat", "_dlon")
    closing = legs.filter("_last").select(*route, (F.col("leg") + 1).alias("leg"),
                                         F.col("b_lat").alias("a_lat"), F.col("b_lon").alias("a_lon"),
                                         F.col("_dlat").alias("b_lat"), F.col("_dlon").alias("b_lon"))
    return legs.select(*route, "leg", "a_lat", "a_lon", "b_lat", "b_lon").unionByName(closing)


def leg_costs(legs: DataFrame, cache: DataFrame | None, kmh: float, alpha: float) -> DataFrame:
    """J-13: leg km/min from the cache on 6-decimal coordinates, else haversine x alpha;
    identical points cost nothing (service time is added per stop).

    A cache with the column `rota_coord` (array of {lat, lon}) passes on the way of its
    leg as `caminho`, null elsewhere."""
    k = ["_k1", "_k2", "_k3", "_k4"]

    def keys(a, b, c, d):
        return [F.round(F.col(x), 6).alias(n) for x, n in zip((a, b, c, d), k)]

    l2 = legs.select("*", *keys("a_lat", "a_lon", "b_lat", "b_lon"))
    with_path = cache is not None and "rota_coord" in cache.columns
    if cache is not None:
        ways = [F.col("rota_coord").alias("caminho")] if with_path else []
        c = (cache.select(*keys("origem_lat", "origem_lon", "destino_lat", "destino_lon"),
                          F.col("distancia_km").alias("_ckm"), F.col("tempo_min").alias("_cmin"), *ways)
             .groupBy(*k).agg(F.min(F.struct("_ckm", "_cmin", *[F.col("caminho") for _ in ways])).alias("_c"))
             .select(*k, "_c.*"))
        l2 = l2.join(c, k, "left")
    else:
        l2 = l2.withColumn("_ckm", F.lit(None).cast("double")).withColumn("_cmin", F.lit(None).cast("double"))
    same = (F.abs(F.col("a_lat") - F.col("b_lat")) < SAME_POINT_DEG) & (F.abs(F.col("a_lon") - F.col("b_lon")) < SAME_POINT_DEG)
    fb_km = haversine_km("a_lat", "a_lon", "b_lat", "b_lon") * F.lit(float(alpha))
    km = F.when(same, F.lit(0.0)).when(F.col("_ckm").isNotNull(), F.col("_ckm")).otherwise(fb_km)
    mins = (F.when(same, F.lit(0.0)).when(F.col("_cmin").isNotNull(), F.col("_cmin"))
            .otherwise(travel_min(fb_km, kmh)))
    fonte = F.when(same, F.lit("mesmo_ponto")).when(F.col("_ckm").isNotNull(), F.lit("cache")).otherwise(F.lit("haversine"))
    return l2.select(*[c for c in legs.columns], F.round(km, 3).alias("km"), F.round(mins, 1).alias("min"),
                     fonte.alias("fonte"), *([F.when(~same, F.col("caminho")).alias("caminho")] if with_path else []))


def route_paths(costed: DataFrame, depots: DataFrame, route: list[str], depot_keys: list[str]) -> DataFrame:
    """R-04: the way of every route, one row a vertex, numbered from 1 by `ponto`.

    `costed` is the result of `leg_costs`.  A leg gives its stored way, or its two ends where
    it has none; a leg between identical points gives nothing.  The way begins and ends at
    the centre: where its first or last vertex is more than 1e-4 degrees off, the centre is
    put before or after it.  A route all of whose legs are empty goes centre, stops, centre.
    One row a vertex keeps a route of any length out of a single value.
    """
    def at(lat, lon):
        return F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))

    ends = F.array(at("a_lat", "a_lon"), at("b_lat", "b_lon"))
    stored = F.when(F.size("caminho") > 0, F.col("caminho")) if "caminho" in costed.columns else F.lit(None)
    moved = F.col("fonte") != "mesmo_ponto"
    g = costed.groupBy(*route).agg(
        F.count_if(moved).alias("_moved"), F.max("leg").alias("_last"),
        F.min_by(F.coalesce(stored, ends), F.when(moved, F.col("leg"))).alias("_first"),
        F.max_by(F.coalesce(stored, ends), F.when(moved, F.col("leg"))).alias("_final"))
    legs = costed.join(g.select(*route, "_moved"), route)
    way = F.when(moved, F.coalesce(stored, ends)).when(F.col("_moved") == 0, F.array(at("a_lat", "a_lon")))
    v = legs.select(*route, F.col("leg").cast("long").alias("leg"), F.posexplode(way).alias("_i", "_xy"))

    d = depots.select(*depot_keys, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon"))
    centre = at("_dlat", "_dlon")

    def off(p):
        return (F.abs(p["lat"] - F.col("_dlat")) > CENTRE_DEG) | (F.abs(p["lon"] - F.col("_dlon")) > CENTRE_DEG)

    extra = g.join(d, depot_keys).select(*route, F.explode(F.array(
        F.when((F.col("_moved") > 0) & off(F.col("_first")[0]), F.struct(F.lit(0).cast("long").alias("leg"), centre.alias("p"))),
        F.when((F.col("_moved") == 0) | off(F.element_at("_final", -1)),
               F.struct((F.col("_last") + 1).cast("long").alias("leg"), centre.alias("p"))))).alias("_e")).filter(F.col("_e").isNotNull())
    rows = v.select(*route, "leg", "_i", "_xy").unionByName(
        extra.select(*route, F.col("_e.leg").alias("leg"), F.lit(0).alias("_i"), F.col("_e.p").alias("_xy")))
    return (ranked(rows, route, ["leg", "_i"], out="ponto")
            .select(*route, F.col("ponto").cast("long").alias("ponto"), F.col("_xy.lat").alias("lat"), F.col("_xy.lon").alias("lon")))


def route_totals(costed: DataFrame, route: list[str], service_min: float) -> DataFrame:
    """R-04: km (2 dec) and minutes incl. service per stop (1 dec) per route.

    Sums run on integer milli-km / deci-minutes so the totals do not depend
    on summation order; km rounds half-up to 2 decimals.
    """
    g = costed.groupBy(*route).agg(
        F.sum(F.round(F.col("km") * 1000, 0).cast("long")).alias("_mkm"),
        F.sum(F.round(F.col("min") * 10, 0).cast("long")).alias("_dmin"),
        (F.count(F.lit(1)) - 1).alias("n_pdvs"))
    return g.select(*route, "n_pdvs",
                    (F.floor((F.col("_mkm") + 5) / F.lit(10.0)) / F.lit(100.0)).alias("dist_total_km"),
                    ((F.col("_dmin") + F.col("n_pdvs") * F.lit(int(round(service_min * 10)))) / F.lit(10.0))
                    .alias("tempo_total_min"))


def routing_summary(routes: DataFrame, cluster: list[str]) -> DataFrame:
    """A-06: per cluster: routes, points, totals and per-route means (month total = sum)."""
    g = routes.groupBy(*cluster).agg(
        F.count(F.lit(1)).alias("qtd_subclusters"), F.sum("n_pdvs").cast("long").alias("qtd_pdvs"),
        F.sum(F.round(F.col("dist_total_km") * 100, 0).cast("long")).alias("_ckm"),
        F.sum(F.round(F.col("tempo_total_min") * 10, 0).cast("long")).alias("_dmin"))
    km = F.col("_ckm") / F.lit(100.0)
    mn = F.col("_dmin") / F.lit(10.0)
    q = F.col("qtd_subclusters")

    def half_up(units):  # units / q rounded half-up to 3 decimals, in integers
        return F.floor((2 * units + q) / (2 * q).cast("double")) / F.lit(1000.0)
    return g.select(*cluster, "qtd_subclusters", "qtd_pdvs", km.alias("dist_total_km"), mn.alias("tempo_total_min"),
                    half_up(F.col("_ckm") * 10).alias("dist_media_km"),
                    half_up(F.col("_dmin") * 100).alias("tempo_medio_min"),
                    km.alias("dist_total_mes_km"), mn.alias("tempo_total_mes_min"))


# ----------------------------------------------------------------- R-05..R-08
def multi_stop_cost(stops: DataFrame, route: list[str], order: str, cache: DataFrame | None,
                    kmh: float, alpha: float) -> DataFrame:
    """R-05: cost of visiting the stops in order without a depot; fewer than two
    stops cost 0 km and 10 minutes."""
    w = Window.partitionBy(*route).orderBy(order)
    legs = (stops.select(*route, F.col(order).alias("leg"), F.lag("lat").over(w).alias("a_lat"),
                         F.lag("lon").over(w).alias("a_lon"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
            .filter(F.col("a_lat").isNotNull()))
    c = leg_costs(legs, cache, kmh, alpha).groupBy(*route).agg(F.sum("km").alias("_km"), F.sum("min").alias("_min"))
    n = stops.groupBy(*route).agg(F.count(F.lit(1)).alias("_n"))
    j = n.join(c, route, "left")
    return j.select(*route, F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.round("_km", 3)).alias("distancia_km"),
                    F.when(F.col("_n") < 2, F.lit(10.0)).otherwise(F.round("_min", 1)).alias("tempo_min"))


def split_routes(points: DataFrame, cluster: list[str], k: DataFrame, pid: str = "pdv_id",
                 lloyd_iter: int | None = None) -> DataFrame:
    """R-06: every cluster cut into its k routes by grouped Lloyd (all clusters in one job)."""
    from .lloyd import MAX_ROUNDS, kmeans
    res, _ = kmeans(points, k, cluster, pid=pid, max_iter=lloyd_iter or MAX_ROUNDS)
    return res.withColumn("subcluster_seq", (F.col("c") + 1).cast("int")).drop("c", "_d2")


def plan_routes(points: DataFrame, depots: DataFrame, cluster: list[str], dias: int, freq: float,
                kmh: float, service_min: float, alpha: float, cache: DataFrame | None = None,
                mode: str = "proporcional", improve: bool = True, pid: str = "pdv_id",
                k: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """R-08: route counts -> split -> stop order (+2-opt) -> leg costs -> totals.
    Returns (routes with totals, stops with `sequencia_ordem`)."""
    if k is None:
        n = points.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n"))
        k = n.select(*cluster, route_count("_n", dias, freq, mode).alias("k"))
    routes = cut_lineage(split_routes(points, cluster, k, pid))
    route = [*cluster, "subcluster_seq"]
    seq = cut_lineage(sequence_stops(routes, depots, route, cluster, pid=pid, improve=improve)
                      .join(routes.select(*route, pid, "lat", "lon"), [*route, pid]))
    legs = route_legs(seq, depots, route, cluster)
    totals = route_totals(leg_costs(legs, cache, kmh, alpha), route, service_min)
    return totals, seq


def _fits_no_tour(lat, lon, depot, service_min: float, max_min: float, max_km: float, min_km: float, km_km: float, slack: float) -> bool:
    """True when no tour from the depot and back over these stops keeps the minutes and the km: it leads to the
    farthest stop and back at least.  `min_km`, `km_km`: minutes and counted km of a km; `slack` km lost by rounding a leg."""
    n = len(lat)
    out = 2 * float(_hav_np(depot[0], depot[1], lat, lon).max())
    out = max(0.0, out * (1 - 1e-9) - (n + 1) * slack)
    return n * service_min + out * min_km > max_min or out * km_km > max_km


def _first_possible(keys: list[str], max_min: float, max_km: float, kmh: float, service_min: float, alpha: float):
    """The first k of a chunk that Lloyd's routes do not rule out, null if they rule out all.

    A route is ruled out by the way to its farthest stop and its service time, or by its tour;
    what rounding can change (0.05 minutes and 0.0005 km a leg, legs of no length) is left to the plan."""
    from .lloyd import MAX_ROUNDS, lloyd_of_group
    min_km, km_km = alpha * 60.0 / kmh, alpha
    slack = 0.06 / min_km + 0.001 / km_km + 0.003

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        lat, lon, ids = pdf["_lat"].to_numpy(float), pdf["_lon"].to_numpy(float), pdf["_id"]
        number = ids.to_numpy()
        head = pdf.iloc[0]
        depot = (float(head["_dlat"]), float(head["_dlon"]))
        found = None
        for k in range(int(head["_from"]), int(head["_to"]) + 1):
            label = lloyd_of_group(lat, lon, None, ids, k, MAX_ROUNDS, False)[0]
            order = np.argsort(label, kind="stable")
            routes = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
            routes.sort(key=len, reverse=True)
            if any(_fits_no_tour(lat[r], lon[r], depot, service_min, max_min, max_km, min_km, km_km, slack) for r in routes):
                continue
            for r in routes:
                way = nearest_neighbour_order(depot[0], depot[1], number[r], lat[r], lon[r])
                km = max(0.0, _tour_km(np.array(depot), np.column_stack([lat[r], lon[r]]), way) - (len(r) + 1) * slack)
                if len(r) * service_min + km * min_km > max_min or km * km_km > max_km:
                    break
            else:
                found = k
                break
        res = pdf.iloc[[0]][[*keys]].copy()
        res["_k"] = pd.array([found], dtype="Int64")
        return res

    return first


def least_possible_k(points: DataFrame, depots: DataFrame, cluster: list[str], pending: DataFrame, max_min: float, max_km: float,
                     kmh: float, service_min: float, alpha: float, pid: str, chunk: int = 4, chunks: int = 2) -> DataFrame:
    """cluster, _k0, _n with `_k0` raised to the first number of routes, from `_k0` on, that is not ruled out (or n).

    Chunks of a few k, a chunk in a task, all clusters at once; clusters whose k are all ruled
    out go on, with twice as many chunks each time."""
    keys = [f"_g{i}" for i in range(len(cluster))]
    pts = cut_lineage(points.select(*cluster, F.col(pid).alias("_id"), F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon")).join(
        depots.select(*cluster, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon")), cluster))
    spread = max(64, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    test = _first_possible([*keys, "_from"], max_min, max_km, kmh, service_min, alpha)
    found, left = None, pending
    while not left.isEmpty():
        jobs = left.withColumn("_from", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_from", F.col("_k0") + F.col("_from") * chunk) \
            .filter((F.col("_from") == F.col("_k0")) | (F.col("_from") <= F.col("_n")))
        jobs = jobs.select(*cluster, F.col("_from").cast("long"), F.least(F.col("_from") + (chunk - 1), "_n").cast("long").alias("_to"))
        rows = pts.join(jobs, cluster).select(*[F.col(g).alias(n) for g, n in zip(cluster, keys)], "_id", "_lat", "_lon", "_dlat", "_dlon", "_from", "_to")
        types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        # by number, since adaptive coalescing by bytes would leave few tasks
        done = rows.repartition(max(spread, 25 * chunks), *keys, "_from").groupBy(*keys, "_from").applyInPandas(
            test, schema=", ".join(f"{n} {types[n]}" for n in [*keys, "_from"]) + ", _k long")
        best = cut_lineage(done.groupBy(*keys).agg(F.min("_k").alias("_k")).select(*[F.col(n).alias(g) for g, n in zip(cluster, keys)], "_k"))
        left = cut_lineage(left.join(best, cluster).withColumn("_next", F.coalesce("_k", F.least(F.col("_k0") + chunk * chunks, F.col("_n")))))
        ends = left.filter(F.col("_k").isNotNull() | (F.col("_next") >= F.col("_n"))).select(*cluster, F.col("_next").alias("_k0"), "_n")
        found = ends if found is None else found.unionByName(ends)
        left = left.filter(F.col("_k").isNull() & (F.col("_next") < F.col("_n"))).select(*cluster, F.col("_next").alias("_k0"), "_n")
        chunks = min(2 * chunks, 64)
    return pending.limit(0) if found is None else cut_lineage(found)


def split_until_feasible(points: DataFrame, depots: DataFrame, cluster: list[str], max_min: float,
                         max_km: float, kmh: float, service_min: float, alpha: float,
                         pid: str = "pdv_id", k_start: int = 1,
                         batch: int = 4, local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """R-07 (and C-09 with `k_start`): the smallest k >= k_start per cluster whose
    every route fits `max_min` and `max_km`, or k = n; the routes carry `status`
    (OK, or EXCEDIDO where even one stop a route does not fit).

    A route lasts at least its stops' service time, so k below
    n * service_min / max_min is skipped, and so is one below the sum over the stops of
    service_min / (max_min less the minutes to the stop and back), since a route with that
    stop holds no more stops than that.  In clusters of at most `local` (LOCAL_POINTS) points,
    counted first, `least_possible_k` finds the first k that is not ruled out and only that is
    planned; if its plan does not fit, the search goes on behind it.  In larger ones
    several candidate k values are planned in one job, with (cluster, k) as the
    planning key; only clusters
    without a feasible k go on, with twice as many candidates each time.
    """
    from .lloyd import LOCAL_POINTS
    local = LOCAL_POINTS if local is None else local
    n = points.groupBy(*cluster).agg(F.count(F.lit(1)).alias("_n"))
    # one unit less than the bound, so that rounding cannot skip a feasible k
    least = F.greatest(F.lit(k_start).cast("long"), F.ceil(F.col("_n") * F.lit(service_min / max_min)) - 1)
    # a leg's rounding takes up to 0.05 minutes, and legs of up to SAME_POINT_DEG cost nothing
    there = F.greatest(haversine_km("lat", "lon", "_dlat", "_dlon") * F.lit(2 * alpha * 60.0 / kmh * (1 - 1e-9)) - 0.07, F.lit(0.0))
    lone = points.join(depots.select(*cluster, F.col("lat").alias("_dlat"), F.col("lon").alias("_dlon")), cluster)
    room = F.lit(float(max_min)) - there
    share = F.lit(max(service_min - 0.07, 0.0)) / room
    ways = lone.groupBy(*cluster).agg(F.sum(share).alias("_share"), F.max((room < service_min - 0.07).cast("int")).alias("_none"))
    least = F.when(F.col("_none") == 1, F.col("_n")).otherwise(F.greatest(least, F.ceil(F.coalesce("_share", F.lit(0.0)) * (1 - 1e-9))))
    pending = cut_lineage(n.join(ways, cluster, "left").select(*cluster, F.least(least, F.col("_n")).cast("long").alias("_k0"), "_n"))
    key = [*cluster, "k"]
    routes_out, stops_out = None, None
    while not pending.isEmpty():
        small = pending.filter(F.col("_n") <= local)
        some = least_possible_k(points, depots, cluster, small, max_min, max_km, kmh, service_min, alpha, pid)
        pending = cut_lineage(pending.filter(F.col("_n") > local).unionByName(some.select(*pending.columns)))
        several = F.when(F.col("_n") <= local, F.lit(1)).otherwise(F.lit(batch))
        pending = pending.withColumn("_several", several)
        cands = cut_lineage(
            pending.withColumn("k", F.explode(F.sequence("_k0", F.least(F.col("_k0") + F.col("_several") - 1, F.col("_n")))))
            .select(*cluster, F.col("k").cast("int").alias("k"), "_n"))
        pts = points.join(cands.select(*key), cluster)
        dep = depots.join(cands.select(*key), cluster)
        totals, seq = plan_routes(pts, dep, key, 1, 1, kmh, service_min, alpha, improve=False, pid=pid,
                                  k=cands.select(*key))
        totals = cut_lineage(totals)
        fit = (totals.groupBy(*key).agg(F.max("tempo_total_min").alias("_t"), F.max("dist_total_km").alias("_d"))
               .join(cands, key)
               .withColumn("_fits", (F.col("_t") <= max_min) & (F.col("_d") <= max_km)))
        pick = cut_lineage(fit.filter(F.col("_fits") | (F.col("k") >= F.col("_n"))).groupBy(*cluster)
                           .agg(F.min(F.struct("k", "_fits")).alias("_p"))
                           .select(*cluster, "_p.k", F.when(F.col("_p._fits"), F.lit("OK")).otherwise(F.lit("EXCEDIDO")).alias("status")))
        r = totals.join(pick, key).withColumnRenamed("k", "k_final")
        st = seq.join(pick.select(*key), key).withColumnRenamed("k", "k_final")
        routes_out = r if routes_out is None else routes_out.unionByName(r)
        stops_out = st if stops_out is None else stops_out.unionByName(st)
        pending = cut_lineage(pending.join(pick.select(*cluster), cluster, "left_anti")
                              .select(*cluster, F.least(F.col("_k0") + F.col("_several"), F.col("_n")).alias("_k0"), "_n"))
        batch *= 2
    return routes_out, stops_out
