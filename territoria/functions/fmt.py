"""Formatting and semi-structured helpers (P-29..P-35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .text import strip_ws


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def address_fallback(stored, logradouro, numero, bairro, cidade, uf) -> Column:
    """P-29: the stored full address, else `log, num - bairro, cidade/uf` with empty parts skipped."""
    def part(x, sep):
        v = _c(x)
        return F.when(v.isNotNull() & (v != ""), F.concat(F.lit(sep), v)).otherwise(F.lit(""))
    built = F.concat(F.coalesce(_c(logradouro), F.lit("")), part(numero, ", "), part(bairro, " - "),
                     part(cidade, ", "), part(uf, "/"))
    return F.coalesce(F.nullif(_c(stored), F.lit("")), built)


# Fixed value: a street and its number, letters allowed.
CENTRE_NUMBER = r"(.*?)[, ]+(\d+[A-Za-z\-/]*)$"


def centre_address(logradouro, numero, bairro, cidade, uf, cep) -> Column:
    """P-30: number split from the street tail when missing; parts joined by ` - `;
    '' when street, city or state is missing."""
    clean = [F.regexp_replace(strip_ws(F.coalesce(_c(x).cast("string"), F.lit(""))), r"\s+", " ")
             for x in (logradouro, numero, bairro, cidade, uf, cep)]
    log, num, bai, cid, u, cp = clean
    hit = (num == "") & log.rlike(CENTRE_NUMBER)
    log2 = F.when(hit, strip_ws(F.regexp_extract(log, CENTRE_NUMBER, 1))).otherwise(log)
    num2 = F.when(hit, strip_ws(F.regexp_extract(log, CENTRE_NUMBER, 2))).otherwise(num)
    parts = [F.nullif(p, F.lit("")) for p in (log2, num2, bai, cid, u, cp)]
    full = F.concat_ws(" - ", *parts)
    return F.when((log2 == "") | (cid == "") | (u == ""), F.lit("")).otherwise(strip_ws(full))


def null_nan_inf(df: DataFrame) -> DataFrame:
    """P-31: NaN and +-Inf -> null in every floating column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.col(f.name)
            out.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(f.dataType))
                       .otherwise(c).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def number_ptbr(x, decimals: int = 1) -> Column:
    """P-32: `1.234,5` (thousands dot, decimal comma); null -> ''."""
    return F.coalesce(F.translate(F.format_number(_c(x), decimals), ",.", ".,"), F.lit(""))


def json_field(c, key: str, as_double: bool = False) -> Column:
    """P-33: `doc->>'key'` (and `::float`)."""
    v = F.get_json_object(_c(c), f"$.{key}")
    return v.try_cast("double") if as_double else v


ROUTE_COORDS = "array<struct<lat:double,lon:double>>"


def parse_route_coords(c) -> Column:
    """P-34: tolerant list of {lat, lon}; single quotes accepted; one object wrapped; bad points dropped."""
    s = strip_ws(F.translate(_c(c), "'", '"'))
    s = F.when(s.startswith("{"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(s)
    arr = F.from_json(s, ROUTE_COORDS)
    return F.filter(arr, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def safe_ratio(a, b, digits: int) -> Column:
    """P-35: round(a / nullif(b, 0), digits)."""
    return F.round(_c(a) / F.nullif(_c(b), F.lit(0)), digits)
