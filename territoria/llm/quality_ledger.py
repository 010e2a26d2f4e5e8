"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and
one failure bit per rule.  Versioned policies are bit masks over the ledger, so a
new policy or an ablation never reads a text again: `kept` is one bitwise AND, and
`ablations` counts from the at most 2^rules distinct masks.

Defined cases: a null or empty text has no words, fails `few_words` and is not
kept; repeated rows are judged alike; extra columns of the input are ignored by
`ledger` and untouched by `apply_policy`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import text_udf, with_struct

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Bit order is part of the ledger format: append, never reorder.  True means the rule fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "2 * word_chars < 3 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 50 * n_letters",
}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeat_words"),
    "prose-2": tuple(RULES),
}

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = a[:-2] * v + a[1:-1]
    if v > 2_000_000:  # the product of three would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    at = order[np.append(same, False) | np.insert(same, 0, False)]
    hit = np.zeros(n, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def _measure(texts: list) -> list:
    out = []
    for t in texts:
        t = t or ""
        b = t.encode()
        words = b.split()  # bytes split at \x09-\x0D and space only
        lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
        out.append({
            "n_words": len(words),
            "word_chars": len(t) - (len(b) - len(b.translate(None, _SPACE))),
            "n_symbols": len(b) - len(b.translate(None, _SYMBOLS)),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": _repeat_words(words),
            "n_lines": len(lines),
            "n_upper": len(b) - len(b.translate(None, _UPPER)),
            "n_letters": len(b) - len(b.translate(None, _LETTERS)),
        })
    return out


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits + F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, measurements, failure_bits."""
    fields = ", ".join(f"{m}: bigint" for m in MEASURES)
    rows = with_struct(docs, text_udf(_measure, f"struct<{fields}>")(docs[text]), [key])
    return rows.withColumn("failure_bits", _bits())


def kept(policy: str) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def apply_policy(docs: DataFrame, policy: str = "prose-2", text: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, all their columns unchanged; no shuffle."""
    fields = ", ".join(f"{m}: bigint" for m in MEASURES)
    tmp = "_ledger"
    while tmp in docs.columns:
        tmp += "_"
    m = docs.withColumn(tmp, text_udf(_measure, f"struct<{fields}>")(docs[text]))
    rejected = F.lit(False)
    for r in POLICIES[policy]:
        rule = RULES[r]
        for name in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(name, f"`{tmp}`.{name}")
        rejected = rejected | F.expr(rule)
    return m.where(~rejected).drop(tmp)


def ablations(rows: DataFrame, policy: str = "prose-2") -> DataFrame:
    """Per rule of the policy: documents failing it, and documents rejected by it alone."""
    by_mask = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    mask = mask_of(POLICIES[policy])
    names = list(RULES)
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    x = by_mask.select("failure_bits", "n", rule.alias("r")).select("failure_bits", "n", "r.rule", "r.bit")
    hit = F.col("failure_bits").bitwiseAND(mask)
    return x.groupBy("rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"))
