"""SimHash near-duplicates by a segment-popcount embedding.

A document's fingerprint has bit b set where more than half of the XXH64 values (seed 42) of
its 3-word shingles, repeats included, have it set.  Fingerprints link at RADIUS or fewer
differing bits; classes are the connected components.

1. Embedding: a fingerprint is cut in 32 segments of two bits and mapped to the bits set in
   each, a point of the grid {0, 1, 2} ** 32, which is 64 bits again (`segment_counts`).  One
   flipped bit moves one count by one, so the Manhattan distance of two points is at most the
   Hamming distance of their fingerprints: a range join at RADIUS loses no link.
2. Grid range join: two points at Manhattan distance 2 or less have a grid point at distance 1
   or less from both.  So every different fingerprint is sent to its own point and to the
   points one step from it (65 at most, 49 on average), and those that meet in a point are
   the candidates; a point with a single one is left out as it streams by.
3. Verification: the candidates of a point are compared by XOR and bit count.  Points with
   more than CROWD fingerprints are not compared in pairs: their fingerprints are sent to
   themselves and to the 64 fingerprints one flip away.  Two fingerprints meet there exactly
   if at most two bits differ, so each links to the smallest it meets, and that is a
   spanning tree instead of all pairs.  The links are the same as with all pairs.
Fingerprints are joined once each, however many documents have them.

Defined cases: null texts and texts without words have the fingerprint zero, which links like
any other; fewer than three words are one shingle; rows that share a doc_id count as equal to
each other (their classes are one); rows with a null doc_id have a fingerprint, a null
component and link nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import skew_join, text_udf, with_struct, written
from territoria.llm.ngram_jaccard import components

SHINGLE = 3
SEED = 42
RADIUS = 2
CROWD = 32
_ODD_BITS = 0x5555555555555555  # the lower bit of each segment
_HASHES = 1 << 14


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    return np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    after = np.cumsum(length)
    starts, ends = (after - length)[:len(words) - k + 1], after[k - 1:] - 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(starts), _HASHES):
        at = zip(starts[lo:lo + _HASHES].tolist(), ends[lo:lo + _HASHES].tolist())
        ones += _bit_counts([digest(joined[a:b], SEED) for a, b in at])
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    def run(texts: list) -> list:
        return [{"fp": _signed(fingerprint(t))} for t in texts]

    return with_struct(docs, text_udf(run, "struct<fp: bigint>")(docs["text"]), ["doc_id"])


def segment_counts(fp: Column) -> Column:
    """The bits set in each two-bit segment, in the two bits of that segment."""
    low, high = fp.bitwiseAND(F.lit(_ODD_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD_BITS))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def near_points(point: Column) -> Column:
    """The point and those one step from it, as an array."""
    steps = []
    for j in range(0, 64, 2):
        count = F.shiftrightunsigned(point, j).bitwiseAND(F.lit(3))
        # 0 and 1 turn into each other by the lower bit, 1 and 2 by both.
        steps += [F.when(count < 2, point.bitwiseXOR(F.lit(_signed(1 << j)))), F.when(count > 0, point.bitwiseXOR(F.lit(_signed(3 << j))))]
    return F.array_compact(F.array(point, *steps))


def one_flip(fp: Column) -> Column:
    """The fingerprint and the 64 that differ in one bit, as an array."""
    return F.array(fp, *[fp.bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)])


def _points(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(_ODD_BITS), (fp >> np.uint64(1)) & np.uint64(_ODD_BITS)
    return ((low & high) << np.uint64(1)) | (low ^ high)


_MET = "a long, b long, crowded boolean"
_MET_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("crowded", pa.bool_())])


def _verified(point: np.ndarray, fp: np.ndarray):
    """Links (a, b) among the fingerprints of whole, uncrowded points, in order of point and fingerprint."""
    own = _points(fp) == point
    for d in range(1, CROWD):
        x, y = slice(None, len(fp) - d), slice(d, None)
        at = np.flatnonzero(point[x] == point[y])
        if not len(at):
            return
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= RADIUS]
        # Pairs meet in several points: equal counts are taken at their own point, counts one
        # step apart at that of the smaller fingerprint, others wherever they meet.
        a, b = own[at], own[at + d]
        at = at[a | (~b & (_points(fp[at]) != _points(fp[at + d])))]
        if len(at):
            yield fp[at], fp[at + d]


def _meet(batches):
    """Links of the points of a partition, which is sorted by point and fingerprint; members of crowded points as (a, null, true)."""
    def out(a, b=None):
        a = a.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64)),
                                           pa.array(np.full(len(a), b is None))], schema=_MET_SCHEMA)

    def settle(point, fp):
        if not len(point):
            return
        first = np.flatnonzero(np.concatenate(([True], point[1:] != point[:-1])))
        size = np.repeat(np.diff(np.append(first, len(point))), np.diff(np.append(first, len(point))))
        crowd = size > CROWD
        if crowd.any():
            yield out(np.unique(fp[crowd]))
        live = ~crowd & (size > 1)
        for a, b in _verified(point[live], fp[live]):
            yield out(a, b)

    # What is held is the last point of a batch, until it ends or is crowded.
    point, fp, crowded = np.empty(0, np.uint64), np.empty(0, np.uint64), None
    for batch in batches:
        p, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
        if not len(p):
            continue
        if crowded is not None:  # the rest of a crowded point
            n = len(p) if p[-1] == crowded else int(np.argmax(p != crowded))
            if n:
                yield out(f[:n])
                p, f = p[n:], f[n:]
            if not len(p):
                continue
            crowded = None
        point, fp = np.concatenate((point, p)), np.concatenate((fp, f))
        last = int(np.argmax(point == point[-1]))
        yield from settle(point[:last], fp[:last])
        point, fp = point[last:], fp[last:]
        if len(point) > CROWD:
            yield out(fp)
            crowded = point[-1]
            point, fp = point[:0], fp[:0]
    yield from settle(point, fp)


def links(prints: DataFrame) -> DataFrame:
    """a, b: links that connect all that links, for different fingerprints fp."""
    near = prints.select("fp", F.explode(near_points(segment_counts(F.col("fp")))).alias("point"))
    met = near.repartition("point").sortWithinPartitions("point", "fp").select("point", "fp").mapInArrow(_meet, _MET)
    met = written(met, "met")
    crowd = met.where("crowded").select(F.col("a").alias("fp")).distinct()
    flips = crowd.select("fp", F.explode(one_flip(F.col("fp"))).alias("at"))
    # At most 65 fingerprints are one flip from any; a group is small, its smallest is enough.
    least = flips.groupBy("at").agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    tree = least.select("b", F.explode("all").alias("a")).where("a != b")
    return met.where("not crowded").select("a", "b").unionByName(tree.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = written(fingerprints(docs), "prints")
    live = signed.where("doc_id is not null")
    prints = written(live.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = links(prints.select("fp"))
    # Rows of one doc_id with several fingerprints join these.
    twice = live.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a != z").select("doc_id", "a")
    same = live.join(twice, "doc_id").where("fp != a").select("a", F.col("fp").alias("b"))
    named = written(components(found.unionByName(same)), "named").withColumnRenamed("node", "fp")
    label = prints.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = label.groupBy("component").agg(F.min("least").alias("component_id"))
    label = written(skew_join(label, least, ["component"]).select("fp", "component_id"), "label")
    out = skew_join(signed, label, ["fp"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
