"""N-01: the scalar functions as SQL functions (`CREATE TEMPORARY FUNCTION ... RETURN`).

SQL functions are inlined by the analyzer, so `spark.sql` users get the same
JVM expressions as the Column builders, with no Python at run time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import HAVERSINE_SQL
from .text import _FOLD_DST, _FOLD_SRC


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


FUNCTIONS = {
    "haversine_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                     HAVERSINE_SQL.format(la1="lat1", lo1="lon1", la2="lat2", lo2="lon2")),
    "travel_min": ("km DOUBLE, kmh DOUBLE", "DOUBLE",
                   "CASE WHEN kmh <= 0 THEN CAST(999999.0 AS DOUBLE) ELSE km / kmh * 60.0 END"),
    "valid_coord": ("lat DOUBLE, lon DOUBLE", "BOOLEAN",
                    "lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) "
                    "AND lat BETWEEN -90.0 AND 90.0 AND lon BETWEEN -180.0 AND 180.0"),
    "fold_accents": ("s STRING", "STRING",
                     f"regexp_replace(translate(s, {_q(_FOLD_SRC)}, {_q(_FOLD_DST)}), '[^\\\\x00-\\\\x7F]', '')"),
    "city_key": ("s STRING", "STRING",
                 "nullif(regexp_replace(upper(fold_accents(s)), '^\\\\s+|\\\\s+$', ''), '')"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    for name, (args, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return list(FUNCTIONS)
