"""SQL-text builders for the DuckDB oracle side (tests and the driver's check only).

DuckDB's regex engine (RE2) has no look-around, so whole-word rules pad the
text with spaces and match the separator characters explicitly.
"""

from __future__ import annotations

from ..functions.text import (ABBREVIATIONS, NO_NUMBER, SAFE_EXPANSIONS, STREET_PREFIX,
                              TRUNCATION_FIXES, UNIT_WORDS)

W = r"[^\pL\pN_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(e: str, pat: str, rep: str, flags: str = "g") -> str:
    return f"regexp_replace({e}, {q(pat)}, {q(rep)}, {q(flags)})"


def strip(e: str) -> str:
    return rr(e, r"^\s+|\s+$", "")


def fold(e: str) -> str:
    return rr(f"strip_accents({e})", r"[^\x00-\x7F]", "")


def normalize_base(e: str) -> str:
    s = strip(e)
    s = rr(s, r"\s+", " ")
    s = rr(s, r"\s*,\s*", ", ")
    s = rr(s, r"(?i),?\s*Brasil$", "")
    return f"coalesce({strip(s)}, '')"


def tidy(e: str) -> str:
    s = strip(e)
    s = rr(s, r"\s{2,}", " ")
    s = rr(s, r",\s*,", ", ")
    return rr(s, r"^\s*,|\s*,\s*$", "")


def normalize_for_cache(e: str) -> str:
    s = f"upper({fold(normalize_base(e))})"
    return tidy(rr(s, r"[^A-Z0-9 ,\-]", ""))


def fix_truncated(e: str) -> str:
    s = f"lower({e})"
    for a, b in TRUNCATION_FIXES:
        s = f"replace({s}, {q(a)}, {q(b)})"
    return s


def pad(e: str) -> str:
    return f"(' ' || {e} || ' ')"


def word_replace(padded: str, pat: str, rep: str, flags: str = "g") -> str:
    """Whole-word replace on space-padded text; two passes cover adjacent matches.
    The text stays padded (strip once at the end of a chain)."""
    s = padded
    for _ in range(2):
        s = rr(s, f"({W})(?:{pat})({W})", "\\1" + rep + "\\2", flags)
    return s


def expand_abbreviations(e: str) -> str:
    s = pad(e)
    for a, b in ABBREVIATIONS:
        s = word_replace(s, a, b)
    return strip(s)


def title_case(e: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({e}, {q(r'(\pL+|[^\pL]+)')}, 1), "
            f"lambda x: upper(x[1]) || lower(x[2:])), '')")


def normalize_for_geocoding(e: str) -> str:
    s = pad(title_case(fix_truncated(normalize_base(e))))
    for a, b in SAFE_EXPANSIONS:
        s = word_replace(s, a, b)
    s = rr(strip(s), "(?i)" + STREET_PREFIX, "", "")
    lead = f"(' ' || {s})"
    s = f"substring({rr(lead, '(?i)(' + W + ')' + UNIT_WORDS + '(' + W + '.*)?$', chr(92) + '1', '')}, 2)"
    return tidy(s)


def normalize_full_address(e: str) -> str:
    s = fold(f"lower({strip(e)})")
    s = expand_abbreviations(fix_truncated(s))
    return f"coalesce({strip(rr(s, r'\s+', ' '))}, '')"


TRAILING_NUMBER = r"^(.*?)(?:\s*,?\s*)(\d{1,6})$"


def split_trailing_number(e: str) -> tuple[str, str]:
    s = strip(f"coalesce({e}, '')")
    hit = f"regexp_matches({s}, {q(TRAILING_NUMBER)})"
    street = f"(case when {hit} then {strip(f'regexp_extract({s}, {q(TRAILING_NUMBER)}, 1)')} else {s} end)"
    number = f"(case when {hit} then regexp_extract({s}, {q(TRAILING_NUMBER)}, 2) else '' end)"
    return street, number


def clean_street(e: str) -> str:
    s = strip(f"split_part(coalesce({e}, ''), ',', 1)")
    return strip(rr(s, r"\s+", " "))


def clean_number(e: str) -> str:
    s = "upper(" + strip(f"coalesce({e}, '')") + ")"
    vals = ", ".join(q(v) for v in NO_NUMBER)
    return f"(case when {s} in ({vals}) then '' else {s} end)"


def clean_district(b: str, c: str) -> str:
    bb = strip(f"coalesce({b}, '')")
    cc = strip(f"coalesce({c}, '')")
    return (f"(case when length({cc}) > 0 and ends_with(upper({bb}), ' ' || upper({cc})) "
            f"then {strip(f'substring({bb}, 1, length({bb}) - length({cc}) - 1)')} else {bb} end)")


def compose_address(log, num, bai, cid, uf, cep) -> str:
    log, num, bai, cid, uf, cep = (strip(f"coalesce({x}, '')") for x in (log, num, bai, cid, uf, cep))
    head = f"(case when length({num}) > 0 then {log} || ' ' || {num} else {log} end)"
    base = f"{head} || ', ' || {bai} || ', ' || {cid} || ' - ' || {uf}"
    cep_fmt = (f"(case when length({cep}) = 8 then ', ' || substring({cep}, 1, 5) || '-' || "
               f"substring({cep}, 6, 3) else '' end)")
    return f"({base} || {cep_fmt} || ', Brasil')"


def cache_key(e: str) -> str:
    a = f"coalesce({e}, '')"
    return f"(case when {a} = '' then '' else {normalize_for_cache(normalize_base(a))} end)"


def fix_encoding(e: str) -> str:
    # Inputs on the oracle side never carry Latin-1 mojibake or control characters.
    return strip(rr(e, r"[\x00-\x1F]", ""))


def clean_cnpj(e: str) -> str:
    v = rr(e, r"^(\d+),(\d+E\+\d+)$", "\\1.\\2", "")
    sci = (f"(case when regexp_matches({v}, {q('[Ee][+]')}) "
           f"then cast(cast(try_cast({v} as double) as decimal(38,0)) as varchar) end)")
    return rr(f"coalesce({sci}, {v})", "[^0-9]", "")


def parse_money_br(e: str) -> str:
    v = strip(f"replace(replace({e}, 'R$', ''), 'r$', '')")
    br = rr(f"replace(replace({v}, '.', ''), ',', '.')", r"[^0-9.]", "")
    num = f"try_cast((case when contains({v}, ',') then {br} else {v} end) as double)"
    return f"(case when {num} <= 1e9 then {num} end)"
