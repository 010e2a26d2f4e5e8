"""Small fixed dimensions: state boxes, postal-code ranges, capitals.

These are bounded, constant-size tables (27 / 25 / 27 rows), so they are the
only sides this library broadcasts without a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Bounding box per state (uf, lat_min, lat_max, lon_min, lon_max).
STATE_BOUNDS = [
    ("AC", -11.0, -7.1, -74.0, -66.0), ("AL", -10.5, -8.5, -38.5, -35.0),
    ("AM", -9.8, 2.0, -73.8, -56.0), ("AP", -1.6, 3.9, -54.5, -49.8),
    ("BA", -18.0, -8.6, -46.5, -37.0), ("CE", -7.9, -2.7, -41.5, -37.0),
    ("DF", -16.1, -15.4, -48.3, -47.3), ("ES", -21.3, -17.8, -41.5, -39.0),
    ("GO", -19.0, -12.4, -53.0, -46.0), ("MA", -10.4, -1.0, -48.0, -41.5),
    ("MG", -22.5, -14.0, -51.0, -39.8), ("MS", -23.0, -17.3, -58.5, -50.8),
    ("MT", -18.5, -7.0, -61.4, -50.1), ("PA", -9.7, 2.3, -58.8, -46.5),
    ("PB", -8.5, -6.0, -38.0, -34.7), ("PE", -9.6, -7.0, -41.5, -34.8),
    ("PI", -10.0, -2.8, -45.8, -40.5), ("PR", -26.7, -22.5, -54.8, -48.0),
    ("RJ", -23.5, -20.7, -44.8, -40.9), ("RN", -6.6, -4.8, -38.9, -35.9),
    ("RO", -13.7, -8.5, -65.0, -59.8), ("RR", 0.5, 5.3, -61.5, -58.0),
    ("RS", -33.8, -27.0, -57.8, -49.7), ("SC", -29.4, -25.9, -53.9, -48.3),
    ("SE", -11.6, -9.4, -38.2, -36.0), ("SP", -25.3, -19.7, -53.1, -44.0),
    ("TO", -13.0, -5.0, -50.8, -45.5),
]

# Postal-code range per state (uf, lo, hi); AC and BA have none,
# DF and GO overlap.
CEP_RANGES = [
    ("SP", "01000000", "19999999"), ("RJ", "20000000", "28999999"), ("MG", "30000000", "39999999"),
    ("ES", "29000000", "29999999"), ("PR", "80000000", "87999999"), ("SC", "88000000", "89999999"),
    ("RS", "90000000", "99999999"), ("DF", "70000000", "73699999"), ("GO", "72800000", "76799999"),
    ("MT", "78000000", "78899999"), ("MS", "79000000", "79999999"), ("AL", "57000000", "57999999"),
    ("PE", "50000000", "56999999"), ("PB", "58000000", "58999999"), ("RN", "59000000", "59999999"),
    ("CE", "60000000", "63999999"), ("PI", "64000000", "64999999"), ("MA", "65000000", "65999999"),
    ("PA", "66000000", "68899999"), ("AP", "68900000", "68999999"), ("AM", "69000000", "69299999"),
    ("RR", "69300000", "69389999"), ("RO", "76800000", "76999999"), ("SE", "49000000", "49999999"),
    ("TO", "77000000", "77999999"),
]

# State capitals (city, uf).
CAPITALS = [
    ("RIO BRANCO", "AC"), ("MACEIO", "AL"), ("MANAUS", "AM"), ("MACAPA", "AP"),
    ("SALVADOR", "BA"), ("FORTALEZA", "CE"), ("BRASILIA", "DF"), ("VITORIA", "ES"),
    ("GOIANIA", "GO"), ("SAO LUIS", "MA"), ("BELO HORIZONTE", "MG"),
    ("CAMPO GRANDE", "MS"), ("CUIABA", "MT"), ("BELEM", "PA"),
    ("JOAO PESSOA", "PB"), ("RECIFE", "PE"), ("TERESINA", "PI"),
    ("CURITIBA", "PR"), ("RIO DE JANEIRO", "RJ"), ("NATAL", "RN"),
    ("PORTO VELHO", "RO"), ("BOA VISTA", "RR"), ("PORTO ALEGRE", "RS"),
    ("FLORIANOPOLIS", "SC"), ("ARACAJU", "SE"), ("SAO PAULO", "SP"),
    ("PALMAS", "TO"),
]


def state_bounds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATE_BOUNDS, "uf string, lat_min double, lat_max double, "
                                               "lon_min double, lon_max double")


def cep_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CEP_RANGES, "uf string, lo string, hi string")


def capitals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPITALS, "cidade string, uf string")


def values_sql(rows, cols: list[str]) -> str:
    """The same rows as a SQL VALUES list (oracle side)."""
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"cast({v!r} as double)"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) as t({', '.join(cols)}))"


STATE_BOUNDS_SQL = values_sql(STATE_BOUNDS, ["uf", "lat_min", "lat_max", "lon_min", "lon_max"])
CEP_RANGES_SQL = values_sql(CEP_RANGES, ["uf", "lo", "hi"])
CAPITALS_SQL = values_sql(CAPITALS, ["cidade", "uf"])
