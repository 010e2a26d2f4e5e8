"""Geographic scalar expressions (G-01..G-14) as JVM Column expressions.

No Python runs per row: every builder returns a `Column` that whole-stage
codegen compiles together with the surrounding projection.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
SLOW_MINUTES = 999999.0  # travel time reported when the speed is not positive


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km, R = 6371, atan2 form."""
    la1, lo1, la2, lo2 = map(_c, (lat1, lon1, lat2, lon2))
    dlat = F.radians(la2 - la1)
    dlon = F.radians(lo2 - lo1)
    a = (F.pow(F.sin(dlat / 2), 2)
         + F.cos(F.radians(la1)) * F.cos(F.radians(la2)) * F.pow(F.sin(dlon / 2), 2))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


HAVERSINE_SQL = ("(2 * 6371.0 * atan2(sqrt(power(sin(radians({la2} - {la1}) / 2), 2) + cos(radians({la1})) * "
                 "cos(radians({la2})) * power(sin(radians({lo2} - {lo1}) / 2), 2)), sqrt(1.0 - (power(sin(radians("
                 "{la2} - {la1}) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * power(sin(radians({lo2} - "
                 "{lo1}) / 2), 2)))))")


def haversine_sql(la1: str, lo1: str, la2: str, lo2: str) -> str:
    """The same formula as SQL text (oracle side and SQL-function registration)."""
    return HAVERSINE_SQL.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2)


def travel_min(km, kmh) -> Column:
    """Minutes to cover `km` at `kmh`; a non-positive speed gives 999999."""
    k, v = _c(km), (F.lit(float(kmh)) if isinstance(kmh, (int, float)) else _c(kmh))
    return F.when(v <= 0, F.lit(SLOW_MINUTES)).otherwise(k / v * F.lit(60.0))


def route_time_min(km, n_stops, service_min, kmh) -> Column:
    """Driving minutes plus service minutes per stop (G-03)."""
    return travel_min(km, kmh) + _c(n_stops) * F.lit(float(service_min))


def polar_angle(lat, lon, lat_ref, lon_ref) -> Column:
    """Initial bearing from the reference point, in [0, 2*pi) (G-04)."""
    la, lo, lr, lor = map(_c, (lat, lon, lat_ref, lon_ref))
    dlon = F.radians(lo - lor)
    y = F.sin(dlon) * F.cos(F.radians(la))
    x = (F.cos(F.radians(lr)) * F.sin(F.radians(la))
         - F.sin(F.radians(lr)) * F.cos(F.radians(la)) * F.cos(dlon))
    ang = F.atan2(y, x)
    return F.when(ang >= 0, ang).otherwise(ang + F.lit(2 * math.pi))


def valid_coord(lat, lon) -> Column:
    """Not null, not NaN, inside [-90, 90] x [-180, 180] (G-05)."""
    la, lo = _c(lat), _c(lon)
    return (la.isNotNull() & lo.isNotNull() & ~F.isnan(la) & ~F.isnan(lo)
            & la.between(-90.0, 90.0) & lo.between(-180.0, 180.0))


# Fallback points a geocoder returns when it found nothing
# (lat, lon, radius km).
GENERIC_FALLBACKS = [(-22.563, -47.401, 5.0), (-14.235004, -51.92528, 10.0)]

# City-centre points returned for a bare city (lat, lon).
CAPITAL_DEFAULT_POINTS = [(-23.5506507, -46.6333824), (-22.908333, -43.196388),
                          (-15.7801, -47.9292), (-19.9167, -43.9345)]


def generic_coord(lat, lon) -> Column:
    """True when a coordinate is missing, ~(0,0), out of range or a geocoder fallback (G-06)."""
    la, lo = _c(lat), _c(lon)
    cond = la.isNull() | lo.isNull() | ((F.abs(la) < 0.0001) & (F.abs(lo) < 0.0001))
    cond = cond | ~(la.between(-90.0, 90.0) & lo.between(-180.0, 180.0))
    for flat, flon, rkm in GENERIC_FALLBACKS:
        cond = cond | (haversine_km(la, lo, F.lit(flat), F.lit(flon)) < rkm)
    return F.coalesce(cond, F.lit(True))


def capital_default_point(lat, lon) -> Column:
    """Within 0.0005 degrees of one of the known city-centre points (G-07)."""
    la, lo = _c(lat), _c(lon)
    pts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CAPITAL_DEFAULT_POINTS])
    return F.exists(pts, lambda p: (F.abs(la - p["a"]) < 0.0005) & (F.abs(lo - p["b"]) < 0.0005))


def fix_swapped(lat, lon) -> tuple[Column, Column]:
    """Swap when |lat| > |lon| (true only for Brazil-like extents) (G-11)."""
    la, lo = _c(lat), _c(lon)
    swap = F.abs(la) > F.abs(lo)
    return F.when(swap, lo).otherwise(la), F.when(swap, la).otherwise(lo)


def fix_scaled(v, limit: float = 90.0) -> Column:
    """Decimal comma accepted; |x| > limit means micro-degrees; 6 decimals (G-12)."""
    x = F.translate(F.trim(_c(v).cast("string")), ",", ".").try_cast("double")
    return F.round(F.when(F.abs(x) > limit, x / F.lit(1e6)).otherwise(x), 6)


def squared_degree_distance(lat1, lon1, lat2, lon2) -> Column:
    la1, lo1, la2, lo2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.pow(la1 - la2, 2) + F.pow(lo1 - lo2, 2)


def jitter(key, lat, lon, amplitude: float = 0.002) -> tuple[Column, Column]:
    """Repeatable +-amplitude offset derived from a hash of the key (G-13)."""
    k = _c(key)
    u = (F.pmod(F.xxhash64(k), F.lit(2001)) - 1000) / F.lit(1000.0)
    v = (F.pmod(F.xxhash64(k, F.lit("lon")), F.lit(2001)) - 1000) / F.lit(1000.0)
    return _c(lat) + u * amplitude, _c(lon) + v * amplitude


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Unit-sphere coordinates; chord distance is monotone in great-circle distance."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord_for_km(km: float) -> float:
    return 2.0 * math.sin(min(math.pi / 2, km / (2 * EARTH_RADIUS_KM)))


def km_for_chord(chord: float) -> float:
    return 2.0 * EARTH_RADIUS_KM * math.asin(min(1.0, chord / 2.0))
