"""Identifiers, money and dates (P-21..P-28) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fix_encoding, strip_ws


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_cnpj(c) -> Column:
    """P-21: `1,23E+13` -> `12300000000000`; digits only ('' when nothing is left).

    Pass the stripped, encoding-fixed cell as a column reference.
    """
    v = F.regexp_replace(_c(c), r"^(\d+),(\d+E\+\d+)$", "$1.$2")
    sci = F.when(v.rlike(r"[Ee]\+"), v.try_cast("double").cast("decimal(38,0)").cast("string"))
    return F.regexp_replace(F.coalesce(sci, v), r"[^0-9]", "")


def valid_cnpj14(c) -> Column:
    """P-22: digits only, exactly 14, else null."""
    d = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"[^0-9]", "")
    return F.when(F.length(d) == 14, d)


def valid_cep(c) -> Column:
    """P-22: digits only; 5 or 8 digits zero-filled to 8, else null."""
    d = F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"[^0-9]", "")
    return F.when(F.length(d).isin(5, 8), F.lpad(d, 8, "0"))


def format_cnpj(c) -> Column:
    """P-23: `NN.NNN.NNN/NNNN-NN`; float text / exponent tolerant; shorter input zero-filled."""
    s = F.regexp_replace(strip_ws(_c(c).cast("string")), ",", ".")
    num = s.try_cast("double")
    s = F.when(F.upper(s).contains("E") & num.isNotNull(), F.format_string("%.0f", num)).otherwise(s)
    d = F.regexp_replace(s, r"[^0-9]", "")
    d = F.when(F.length(d) < 14, F.lpad(d, 14, "0")).otherwise(d)
    return F.when(F.length(d) == 14,
                  F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")).otherwise(d)


def bad_cep(c) -> Column:
    """P-24: empty, non-digit, length != 8 or all zeros."""
    s = strip_ws(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "-", ""))
    return (s == "") | ~s.rlike(r"^[0-9]+$") | (F.length(s) != 8) | (s == "00000000")


def parse_money_br(c) -> Column:
    """P-25: strip `R$`; `1.234,56` -> 1234.56; > 1e9 or unparsable -> null.

    Pass the encoding-fixed cell as a column reference.
    """
    v = strip_ws(F.replace(F.replace(_c(c), F.lit("R$"), F.lit("")), F.lit("r$"), F.lit("")))
    br = F.regexp_replace(F.translate(F.replace(v, F.lit("."), F.lit("")), ",", "."), r"[^0-9.]", "")
    num = F.when(F.instr(v, ",") > 0, br).otherwise(v).try_cast("double")
    return F.when(num <= 1e9, num)


UUID_RE = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def canonical_uuid(c) -> Column:
    """P-27: drop whitespace and non-hex characters; canonical lower-case 8-4-4-4-12 or null.

    32 bare hex digits are accepted and hyphenated, as a UUID parser does.
    """
    v = F.regexp_replace(F.regexp_replace(_c(c), r"\s+", ""), r"[^0-9a-fA-F-]", "")
    v = F.lower(v)
    bare = F.regexp_replace(v, "-", "")
    hyph = F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4),
                       F.substring(bare, 17, 4), F.substring(bare, 21, 12))
    ok_shape = v.rlike(UUID_RE) | v.rlike(r"^[0-9a-f]{32}$")
    return F.when(ok_shape, hyph)


def parse_date_br(c) -> Column:
    """P-28: `dd/MM/yyyy` or ISO `yyyy-MM-dd` -> date."""
    s = strip_ws(_c(c))
    return F.coalesce(F.try_to_timestamp(s, F.lit("dd/MM/yyyy")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))).cast("date")
