"""Line dedup by a log-template tree.

A line is parsed to a fixed depth: token count, then its LEADING first tokens (digits
masked) name its leaf.  Lines of a leaf are compared field by field, a field being one
token, or for lines of more than FIELDS tokens an equal run of them.  A field value that
fewer than min_docs documents of the leaf have at that place is variable and becomes a
wildcard; lines with the same remaining fields share a template, provided that at least
`similarity` of the fields are constant and the wildcards stand for variable_words tokens
at most: a line with more words of its own is no variant of the others.  A template found
in min_docs documents or more recurs: its lines are dropped, but for those in the document
with the smallest doc_id that has it.  What leaves the corpus altogether is thus what wildcards
and masked digits stand for, variable_words tokens a line at most.  Lines of LONG tokens or more
recur from long_docs documents on, whole or as templates, since no such line stands in two
documents by chance.

A passage inside lines of LONG tokens or more, whatever surrounds it, is found by pieces in
the lines that are left: runs of PIECE tokens at content-defined places, the least
hash of every SPREAD runs in a row.  PIECE + SPREAD - 1 = LONG, so texts that share LONG
tokens in a row within such lines share a piece.  A piece of two documents or more recurs
and is cut out of all but the one with the smallest doc_id.  The tokens of a shared passage
before its first and behind its last common piece, at most SPREAD - 1 each, stay.

A text is parsed once, for lines and pieces; the tables of both are written, and texts
are read again only to be edited.  The tree is never held in one place: its leaves and field counts are grouped rows, equal
lines meet before the first shuffle, and per line a fixed number of hashes is moved, not
its text.  A document that holds two forms of one template counts for both.

Defined cases: null and empty texts pass unchanged; lines of fewer than min_tokens tokens
are never dropped (lines of fewer than min_generalised are compared as a whole); a null
doc_id is never the smallest where there is another (and keeps its pieces where all are null); repeated rows share an id and so
keep or lose the same lines; other columns, whatever their names, are untouched.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import IdFilter, skew_join, text_udf, written

LEADING = 3
FIELDS = 16
LONG = 50
PIECE, SPREAD = 26, 25
HELD_POWERS = 1 << 16
PARSED = ("struct<lines: array<struct<line_no: int, is_first: boolean, n: int, leaf: bigint, line: bigint, fields: array<int>>>, "
          "pieces: struct<piece: array<bigint>, line_no: array<int>, at: array<int>>>")

_DIGITS = bytes(48 if 48 <= c <= 57 else c for c in range(256))
_SIGNED = 1 << 63
_TOKEN = re.compile(rb"[^ \t\r\x0b\x0c]+[ \t\r\x0b\x0c]*")  # what split() takes for a token, and the white space behind it
_ODD = 0x9E3779B97F4A7C15  # any odd number does
_MIX = np.uint64(0xBF58476D1CE4E5B9)

def parse_tokens(tokens: list[bytes], min_generalised: int = 8) -> tuple[int, int, int, list[int]]:
    """(token count, leaf, whole masked line, hash of each field)."""
    n, digest = len(tokens), xxhash.xxh64_intdigest
    whole = digest(b" ".join(tokens)) - _SIGNED
    leaf = digest(b" ".join(tokens[:LEADING]), n) - _SIGNED
    if n < min_generalised:
        return n, leaf, whole, []
    if n <= FIELDS:
        parts = tokens
    else:
        cut = [i * n // FIELDS for i in range(FIELDS + 1)]
        parts = [b" ".join(tokens[a:b]) for a, b in zip(cut, cut[1:])]
    return n, leaf, whole, [xxhash.xxh32_intdigest(p) - (1 << 31) for p in parts]


def masked_lines(text: str | None) -> list[list[bytes]]:
    """The tokens of each line, digits masked."""
    return [line.split() for line in (text or "").encode().translate(_DIGITS).split(b"\n")]


def parse_line(line: str, min_generalised: int = 8) -> tuple[int, int, int, list[int]]:
    return parse_tokens(line.encode().translate(_DIGITS).split(), min_generalised)


def parsed(docs: DataFrame, text: str, key: str, row: str, min_tokens: int, min_generalised: int) -> DataFrame:
    """_key, _row, lines (line_no, is_first within the document, n, leaf, line, fields; of at least min_tokens tokens), pieces (piece, line_no, at)."""
    def run(texts: list) -> pa.Array:
        # Column by column: as many rows of lines would be slow as Python objects.
        no, first, count, leaf_of, line_of, fields_of, places = [], [], [], [], [], [], []
        line_ends, field_ends, piece_ends = [0], [0], [0]
        for t in texts:
            seen, lines = set(), masked_lines(t)
            for i, tokens in enumerate(lines):
                if len(tokens) >= min_tokens:
                    n, leaf, whole, fields = parse_tokens(tokens, min_generalised)
                    no.append(i)
                    first.append(whole not in seen)
                    count.append(n)
                    leaf_of.append(leaf)
                    line_of.append(whole)
                    fields_of += fields
                    field_ends.append(len(fields_of))
                    seen.add(whole)
            line_ends.append(len(no))
            places.append(pieces_of(lines))
            piece_ends.append(piece_ends[-1] + len(places[-1][0]))

        def lists(ends: list, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

        names = ["line_no", "is_first", "n", "leaf", "line", "fields"]
        columns = [pa.array(no, pa.int32()), pa.array(first, pa.bool_()), pa.array(count, pa.int32()), pa.array(leaf_of, pa.int64()),
                   pa.array(line_of, pa.int64()), lists(field_ends, pa.array(fields_of, pa.int32()))]
        piece, line_no, at = (np.concatenate([p[x] for p in places]) for x in range(3))
        pieces = [lists(piece_ends, pa.array(x.astype(kind))) for x, kind in ((piece, np.int64), (line_no, np.int32), (at, np.int32))]
        return pa.StructArray.from_arrays([lists(line_ends, pa.StructArray.from_arrays(columns, names)),
                                           pa.StructArray.from_arrays(pieces, ["piece", "line_no", "at"])], ["lines", "pieces"])

    return docs.select(docs[key].alias("_key"), docs[row].alias("_row"), text_udf(run, PARSED, rows=1024)(docs[text]).alias("_p")).select("_key", "_row", "_p.*")


def recurring_lines(lines: DataFrame, key: str, min_docs: int, similarity: float, long_docs: int = 2, variable_words: int = 8) -> DataFrame:
    """line, owner: every masked line whose template recurs, and the document that keeps it."""
    least = F.when(F.col("n") >= LONG, long_docs).otherwise(min_docs)
    forms = written(lines.where("is_first").groupBy("leaf", "n", "line", "fields").agg(F.count(F.lit(1)).alias("docs"), F.min(key).alias("owner")), "forms")
    exact = forms.where(F.col("docs") >= least).select("line", "owner")
    # The token count n is part of the leaf.
    several = forms.where(F.size("fields") > 0).groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("forms"), F.sum("docs").alias("d")) \
        .where((F.col("forms") > 1) & (F.col("d") >= least)).select("leaf", "n")
    busy = skew_join(forms.where(F.size("fields") > 0), several, ["leaf", "n"])
    fields = busy.select("leaf", "n", "line", "docs", "owner", F.size("fields").alias("n_fields"), F.posexplode("fields").alias("at", "field"))
    fields = written(fields, "fields")
    constant = fields.groupBy("leaf", "n", "at", "field").agg(F.sum("docs").alias("d")).where(F.col("d") >= least).select("leaf", "n", "at", "field")
    words = F.when(F.col("n") <= FIELDS, 1).otherwise(F.floor((F.col("at") + 1) * F.col("n") / FIELDS) - F.floor(F.col("at") * F.col("n") / FIELDS))
    # At most FIELDS rows for each line meet here; variable fields are simply missing.
    shape = skew_join(fields, constant, ["leaf", "n", "at", "field"]).groupBy("leaf", "n", "line", "docs", "owner", "n_fields") \
        .agg(F.sort_array(F.collect_list(F.struct("at", "field"))).alias("shape"), F.sum(words).alias("fixed"))
    shape = shape.where((F.size("shape") >= similarity * F.col("n_fields")) & (F.col("n") - F.col("fixed") <= variable_words)) \
        .select("line", "n", "docs", "owner", F.xxhash64("leaf", "shape").alias("template"))
    shape = written(shape, "shape")
    templates = shape.groupBy("template", "n").agg(F.sum("docs").alias("d"), F.min("owner").alias("first")).where(F.col("d") >= least)
    general = skew_join(shape, templates.select("template", "n", "first"), ["template", "n"]).select("line", F.col("first").alias("owner"))
    return exact.unionByName(general).groupBy("line").agg(F.min("owner").alias("owner"))


_held: list[tuple[np.ndarray, np.ndarray]] = []  # powers for the texts of usual length, worked out once a worker


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD and of its inverse modulo 2^64."""
    if n <= HELD_POWERS:
        if not _held:
            _held.append(_count_powers(HELD_POWERS))
        return _held[0][0][:n], _held[0][1][:n]
    return _count_powers(n)


def _count_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= _MIX
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word: a polynomial over its bytes, all words in one pass over them."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    power, back = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * power[:-1], out=sums[1:])  # no byte counts as 0, so no word equals a longer one
    starts = np.concatenate([[0], ends[:-1]])
    return _mixed((sums[ends] - sums[starts]) * back[starts])


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its least one, the first of equals; the width is reached by doubling."""
    least, place, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        keep = least[:-step] <= least[step:]
        least, place = np.where(keep, least[:-step], least[step:]), np.where(keep, place[:-step], place[step:])
        have += step
    return place


def pieces_of(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, line number, first token) of every piece of the long ones of a text's masked lines."""
    words, numbers, sizes = [], [], []
    for i, tokens in enumerate(lines):
        if len(tokens) >= LONG:
            words += tokens
            numbers.append(i)
            sizes.append(len(tokens))
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    power, back = _powers(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * power[:-1], dtype=np.uint64)])
    runs = _mixed((sums[PIECE:] - sums[:-PIECE]) * back[:len(words) - PIECE + 1])
    line = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(line[:len(words) - LONG + 1] == line[LONG - 1:])  # LONG tokens from here on are of one line
    chosen = first_least(runs, SPREAD)[inside]
    at = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])] if len(chosen) else chosen  # places never go back
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return runs[at].view(np.int64), np.array(numbers)[line[at]], at - start[line[at]]


def pieces(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pieces_of(masked_lines(text))


def edited(text: str, gone: list | None, spans: list | None) -> tuple[str, int]:
    """The text without the lines `gone` and the pieces that begin at (line number, token), and how many lines these are; lines cut empty go."""
    cuts: dict[int, list[int]] = {}
    for s in spans or ():
        cuts.setdefault(s["line_no"], []).append(s["at"])
    out, drop = [], set(gone or ())
    for i, line in enumerate(text.split("\n")):
        if i in drop:
            continue
        if i in cuts:
            raw = line.encode()
            places = [(m.start(), m.end()) for m in _TOKEN.finditer(raw)]
            stay = np.ones(len(places), bool)
            for at in cuts[i]:
                stay[at:at + PIECE] = False
            if not stay.any():
                continue
            line = (raw[:places[0][0]] + b"".join(raw[a:b] for (a, b), s in zip(places, stay) if s)).decode()
        out.append(line)
    return "\n".join(out), len(drop) + len(cuts)


def recurring_pieces(table: DataFrame, drops: DataFrame) -> DataFrame:
    """_row, spans: the pieces (line_no, at) that another document keeps, of the lines that stay."""
    own = table.where(F.size("pieces.piece") > 0).select("_key", "_row", "pieces.*") \
        .select("_key", "_row", F.arrays_zip("piece", "line_no", "at").alias("_all")).join(drops, "_row", "left")
    left = F.filter("_all", lambda p: ~F.coalesce(F.array_contains(F.col("gone"), p["line_no"]), F.lit(False)))
    found = written(own.select("_key", "_row", F.explode(left).alias("_p")).select("_key", "_row", "_p.*"), "pieces")
    keys = found.groupBy("piece").agg(F.min("_key").alias("owner"), F.max("_key").alias("last"), F.max(F.col("_key").isNull()).alias("unnamed")) \
        .where("owner is not null and (owner != last or unnamed)").select("piece", "owner")
    keys = written(keys, "owners")
    at = IdFilter(keys, "piece").marked(found, "piece", "_maybe").where("_maybe")
    hit = skew_join(at, keys, ["piece"]).where(~F.col("_key").eqNullSafe(F.col("owner")))
    return hit.groupBy("_row").agg(F.collect_set(F.struct("line_no", "at")).alias("spans"))


def drop_recurring(docs: DataFrame, min_docs: int = 3, similarity: float = 0.5, min_tokens: int = 4, min_generalised: int = 8,
                   text: str = "text", key: str = "doc_id", long_docs: int = 2, variable_words: int = 8) -> DataFrame:
    """All columns of docs, text without the recurring lines, without pieces of long lines that recur, and n_lines, n_dropped (which replace columns of these names; lines cut count)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    tag = uuid.uuid4().hex[:8]  # names of our own cannot clash with columns
    row, maybe, edit = f"_row_{tag}", f"_maybe_{tag}", f"_edit_{tag}"
    # A row is named by two hashes, 128 bits: equal only for equal keys and texts.
    docs = docs.select(*[docs[c] for c in own], F.struct(F.xxhash64(docs[key], docs[text]).alias("a"), F.xxhash64(F.lit(tag), docs[text], docs[key]).alias("b")).alias(row))
    table = written(parsed(docs, text, key, row, min_tokens, min_generalised), "parsed")
    lines = table.select("_key", "_row", F.explode("lines").alias("_l")).select("_key", "_row", "_l.*")
    keys = recurring_lines(lines, "_key", min_docs, similarity, long_docs, variable_words)
    hit = skew_join(lines.select("_key", "_row", "line_no", "line"), keys, ["line"]).where(~F.col("_key").eqNullSafe(F.col("owner")))
    drops = written(hit.groupBy("_row").agg(F.collect_set("line_no").alias("gone")), "drops")
    edits = written(drops.join(recurring_pieces(table, drops), "_row", "full").withColumnRenamed("_row", row), "edits")
    # Only documents that may lose something are shuffled.
    marked = IdFilter(edits, row).marked(docs, row, maybe)
    joined = marked.where(F.col(maybe)).join(edits.select(row, F.struct("gone", "spans").alias(edit)), row, "left")

    def run(rows: list) -> list:
        out = []
        for r in rows:
            left, n = edited(r["t"], r["e"]["gone"], r["e"]["spans"])
            out.append({"t": left, "n": n})
        return out

    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1))).cast("long").alias("n_lines")
    whole = [F.col(f"`{c}`") for c in own]

    def same(df: DataFrame) -> DataFrame:
        return df.select(*whole, n_lines, F.lit(0).cast("long").alias("n_dropped"))

    less = joined.where(F.col(edit).isNotNull()) \
        .select(*whole, n_lines, text_udf(run, "struct<t: string, n: int>")(F.struct(F.col(text).alias("t"), F.col(edit).alias("e"))).alias(edit)) \
        .select(*[F.col(f"{edit}.t").alias(c) if c == text else F.col(f"`{c}`") for c in own], "n_lines", F.col(f"{edit}.n").cast("long").alias("n_dropped"))
    return same(marked.where(~F.col(maybe))).unionByName(same(joined.where(F.col(edit).isNull()))).unionByName(less)
