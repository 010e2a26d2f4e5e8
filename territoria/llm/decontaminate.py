"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap check.

The index holds the items: postings per term with BM25 weights, each item's weights
divided by the score the item would get from its own text, so 1 is the whole item and
one threshold fits all.  Every document is read whole, in passages of twice the longest
item's words that overlap by half, so any item lies inside some passage; each passage is
a query and all items above the threshold are retrieved (no top-k).  WAND with block
maxima skips: a passage whose terms' maxima do not reach the threshold together holds no
hit, a block of items whose block maxima do not reach it is passed over (this bound is
summed for all passages of a document at once), and only the rest is scored.  A retrieved item counts when both its question and its answer (the last
sentence; the last quarter of the words where there is one sentence only) overlap with
the passage in three-word runs.

The index is broadcast in blocks of at most `block_chars` characters of item text: their
number grows with the benchmark, what is broadcast at once does not.  Documents are never
shuffled.

Defined cases: null or empty documents and items have no hits; items without words are
ignored; repeated items each report; ties need no rule as all hits are returned; tables
may be empty; extra columns of the documents are untouched by `clean`.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import text_udf

HITS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"

_KEEP = bytes(range(128, 256)) + b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEEP else 32 for c in range(256))
MAX_BLOCKS = 64  # per index; a block has four items at least
K1, B = 1.2, 0.75


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, ASCII letters in lower case."""
    return text.encode().translate(_TABLE).split()


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for s in text.replace("\n", ". ").split(". ") if (w := words_of(s))]
    if len(parts) > 1 and len(parts[-1]) >= 3:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = [w for p in parts for w in p]
    cut = max(1, len(words) - max(1, len(words) // 4))
    return words[:cut], words[cut:]


def _runs(words: list[bytes], n: int = 3) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def _overlap(part: list[bytes], passage: list[bytes], runs: set) -> float:
    own = _runs(part)
    if not own:
        return 1.0
    if len(part) < 3:
        runs = _runs(passage, len(part))
    return len(own & runs) / len(own)


@dataclass
class ItemIndex:
    """Postings of one block of items, in item order, with maxima per posting list and per block of items."""

    items: list[tuple[int, list[bytes], list[bytes]]]
    terms: dict[bytes, int]
    starts: np.ndarray
    where: np.ndarray
    weight: np.ndarray
    block_top: np.ndarray
    span: int
    per_block: int
    _lists: dict = field(default_factory=dict, repr=False)

    def postings(self, term: int) -> tuple[list[int], list[float]]:
        got = self._lists.get(term)
        if got is None:
            lo, hi = self.starts[term], self.starts[term + 1]
            got = self._lists[term] = (self.where[lo:hi].tolist(), self.weight[lo:hi].tolist())
        return got

    def retrieve(self, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items of the blocks whose score for the set of terms reaches the threshold: WAND with each block's maxima."""
        lists = [self.postings(t) for t in terms.tolist()]
        out = []
        for blk in blocks.tolist():
            lo, hi = blk * self.per_block, (blk + 1) * self.per_block
            cursors = []
            for (where, weight), top in zip(lists, self.block_top[terms, blk].tolist(), strict=True):
                if not top:
                    continue
                at = _seek(where, lo)
                if at < len(where) and where[at] < hi:
                    cursors.append([where[at], at, where, weight, top])
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[4]
                    if bound >= threshold:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                if cursors[0][0] == pivot:
                    total = sum(c[3][c[1]] for c in cursors if c[0] == pivot)
                    if total >= threshold:
                        out.append((pivot, total))
                    goal = pivot + 1
                else:
                    goal = pivot
                for c in cursors:
                    if c[0] < goal:
                        c[1] = _seek(c[2], goal, c[1])
                        c[0] = c[2][c[1]] if c[1] < len(c[2]) else hi
                cursors = [c for c in cursors if c[0] < hi]
        return out

    def _sums(self, ids: np.ndarray, k: np.ndarray, counted: np.ndarray, n: int) -> np.ndarray:
        """Per stretch k of the document, the sum of the counted terms' block maxima."""
        out = np.zeros((n, self.block_top.shape[1]), np.float32)
        ids, k = ids[counted], k[counted]
        if len(ids):
            first = np.flatnonzero(np.concatenate(([True], np.diff(k) != 0)))
            out[k[first]] = np.add.reduceat(self.block_top[ids], first, axis=0) * np.float32(1 + 1e-5)  # rounding stays above
        return out

    def search(self, text: str, threshold: float, overlap: float) -> list[dict]:
        words = words_of(text)
        get = self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        ids = ids[at]
        step = max(1, self.span)
        n = max(1, -(-len(words) // step))
        # Of a term that recurs in a passage only the first place counts towards the passage's bound.
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1, np.int64)
        same = np.flatnonzero(np.diff(ids[order]) == 0)
        before[order[same + 1]] = at[order[same]]
        k = at // step
        own = self._sums(ids, k, before < k * step, n)
        own[:-1] += self._sums(ids, k, before < (k - 1) * step, n)[1:]
        best: dict[int, dict] = {}
        for p in np.flatnonzero((own >= threshold).any(1)).tolist():
            lo, hi = np.searchsorted(at, (p * step, (p + 2) * step))
            found = self.retrieve(np.unique(ids[lo:hi]), np.flatnonzero(own[p] >= threshold), threshold)
            if not found:
                continue
            passage = words[p * step:(p + 2) * step]
            runs = _runs(passage)
            for i, score in found:
                item, question, answer = self.items[i]
                q, a = _overlap(question, passage, runs), _overlap(answer, passage, runs)
                if q >= overlap and a >= overlap and (i not in best or (score, q, a) > best[i]["_rank"]):
                    best[i] = {"item_id": item, "score": min(score, 1.0), "question_overlap": q, "answer_overlap": a, "_rank": (score, q, a)}
        return [{k: v for k, v in best[i].items() if k != "_rank"} for i in sorted(best)]


def _seek(where: list[int], goal: int, at: int = 0) -> int:
    from bisect import bisect_left

    return bisect_left(where, goal, at)


def build_index(rows: list[tuple[int, str]], df: dict[bytes, int], n_items: int, mean_length: float) -> ItemIndex:
    """Index of one block; document frequencies, item count and mean length are those of the whole benchmark."""
    kept = [(i, t, w) for i, t in rows if (w := words_of(t or ""))]
    terms: dict[bytes, int] = {}
    lists: list[list[tuple[int, float]]] = []
    for at, (_, _, words) in enumerate(kept):
        raw = {}
        for w, tf in Counter(words).items():
            idf = np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
            raw[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
        whole = sum(raw.values())
        for w, x in raw.items():
            t = terms.setdefault(w, len(terms))
            if t == len(lists):
                lists.append([])
            lists[t].append((at, x / whole))
    per_block = max(4, -(-len(kept) // MAX_BLOCKS))
    n_blocks = max(1, -(-len(kept) // per_block))
    block_top = np.zeros((len(lists), n_blocks), np.float32)
    for t, l in enumerate(lists):
        for at, x in l:
            block_top[t, at // per_block] = max(block_top[t, at // per_block], np.nextafter(np.float32(x), np.float32(2)))
    return ItemIndex([(i, *question_answer(t)) for i, t, _ in kept], terms, np.cumsum([0, *map(len, lists)]),
                     np.array([at for l in lists for at, _ in l], np.int64), np.array([x for l in lists for _, x in l]),
                     block_top, max((len(w) for *_, w in kept), default=1), per_block)


def index_blocks(benchmark: DataFrame, block_chars: int = 500_000) -> list:
    """Broadcast indexes, one per block of items; a block's text is bounded by block_chars on average of the hash deal."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")) \
        .where("item_id is not null and text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-chars // block_chars))
    split = text_udf(lambda ts: [[w.decode("utf-8", "replace") for w in words_of(t)] for t in ts], "array<string>")
    counted = items.select(split(F.col("text")).alias("w"))
    mean = counted.where(F.size("w") > 0).agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    blocks = []
    for k in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        rows = sorted((r["item_id"], r["text"]) for r in own.collect())
        vocabulary = {w.decode("utf-8", "replace") for _, t in rows for w in words_of(t)}
        words = counted.select(F.explode(F.array_distinct("w")).alias("w"))
        if n_blocks > 1:
            words = words.join(F.broadcast(benchmark.sparkSession.createDataFrame([(w,) for w in sorted(vocabulary)], "w string")), "w")
        df = {r["w"].encode(): r["n"] for r in words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()} if rows else {}
        blocks.append(benchmark.sparkSession.sparkContext.broadcast(build_index(rows, df, mean[0], mean[1] or 1.0)))
    return blocks


def _hits(text: Column, block, threshold: float, overlap: float) -> Column:
    def run(texts: list) -> list:
        return [block.value.search(t, threshold, overlap) if t else [] for t in texts]

    return text_udf(run, HITS)(text)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document and item it holds: key, item_id, score, question_overlap, answer_overlap."""
    parts = []
    for block in index_blocks(benchmark):
        found = docs.select(docs[key], _hits(docs[text], block, threshold, overlap).alias("_h"))
        parts.append(found.select(key, F.explode("_h").alias("_h")).select(key, "_h.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.6, text: str = "text") -> DataFrame:
    """The rows of docs that hold no item; all columns unchanged."""
    tmp = "_hits"
    while tmp in docs.columns:
        tmp += "_"
    for block in index_blocks(benchmark):
        docs = docs.withColumn(tmp, _hits(docs[text], block, threshold, overlap)).where(F.size(tmp) == 0).drop(tmp)
    return docs
