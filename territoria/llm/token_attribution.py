"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole.  The tokens' character spans are interval-joined
with the spans of its sections: both lists are sorted, so the join is a merge (two
binary searches per token, vectorised).  Rule for a token that crosses a boundary:
it goes to the section that holds most of its characters, to the earlier one on a
tie.  Each token is counted exactly once, so section counts add up to the document's.
A token that holds only part of a character's bytes is taken to span that character.

Sections are the text's lines (a line owns its line feed), or the fields of a record.

Defined cases: null and empty texts have no tokens and one empty section; null fields
are empty sections; texts are encoded whole whatever their length.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import encode_text, text_udf, with_struct

RESULT = "struct<n_tokens: bigint, n_sections: bigint, n_crossing: bigint, section_tokens: array<int>>"


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return enc, lengths


def token_spans(text: str, ids: list[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character span [start, end) of every token."""
    stop = np.cumsum(lengths[np.asarray(ids, np.int64)])
    begin = np.concatenate(([0], stop[:-1])) if len(stop) else stop
    if text.isascii():
        return begin, stop
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    seen = np.concatenate(([0], np.cumsum(lead)))  # characters begun before each byte
    return seen[begin] - ~lead[begin], seen[stop]


def attribute(start: np.ndarray, end: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, given the sections' ends (ascending); and how many tokens crossed."""
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, end - 1, "right")
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for i in crossing:
        cuts = np.concatenate(([start[i]], ends[first[i]:last[i]], [end[i]]))
        owner[i] = first[i] + int(np.argmax(np.diff(cuts)))  # argmax takes the earlier of equals
    return np.bincount(owner, minlength=len(ends)), len(crossing)


def _count(text: str, ends: np.ndarray, path: str, pattern: str) -> dict:
    enc, lengths = _encoding(path, pattern)
    ids = encode_text(enc, text)
    start, end = token_spans(text, ids, lengths)
    counts, crossing = attribute(start, end, ends)
    return {"n_tokens": len(ids), "n_sections": len(ends), "n_crossing": crossing, "section_tokens": counts.tolist()}


def _line_ends(text: str) -> np.ndarray:
    sizes = [len(x) + 1 for x in text.split("\n")]
    sizes[-1] -= 1
    return np.cumsum(sizes)


def line_token_counts(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_sections, n_crossing, section_tokens (one count per line)."""
    def run(texts: list) -> list:
        return [_count(t or "", _line_ends(t or ""), path, pattern) for t in texts]

    return with_struct(docs, text_udf(run, RESULT)(docs[text]), [key])


def field_token_counts(docs: DataFrame, fields: list[str], path: str, pattern: str, key: str = "doc_id", joiner: str = "\n\n") -> DataFrame:
    """The record is its fields with joiner after each but the last; a joiner belongs to the field before it."""
    def run(records: list) -> list:
        out = []
        for r in records:
            parts = [(x or "") + joiner for x in r[:-1]] + [r[-1] or ""]
            out.append(_count("".join(parts), np.cumsum([len(x) for x in parts]), path, pattern))
        return out

    record = F.array(*[docs[f].cast("string") for f in fields])
    return with_struct(docs, text_udf(run, RESULT)(record), [key])
