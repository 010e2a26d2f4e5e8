"""Toxicity by a support vector machine on a gapped subsequence string kernel.

Units are lower-cased words without outer punctuation, the same with inner separators
taken out, and runs of single-letter words put together; units longer than WINDOW are
read through overlapping windows.  The kernel of two units counts their common
three-character subsequences, each occurrence weighted DECAY ** (its span), normalised
to 1 for equal units, so gaps and inserted characters lower the similarity only
gradually.  Nystroem features are the kernel values to a set of landmark units, whitened
by their own kernel matrix; a squared-hinge linear machine is trained on them.  The
machine's value is linear in the subsequences of a unit, so all landmarks fold into one
weight per subsequence and a unit is scored in one pass over its subsequences.

A sentence is as toxic as its worst unit and a document as its worst sentence.
Training sentences come from documents with one label for the whole: of a document
labelled toxic, the sentence with the highest-valued unit is the witness (chosen anew in
each round); every unit of a clean document's sentences is negative.

The training sample is bounded: at most `per_class` documents of each label with at most
`max_chars` characters, by a hash of the id among rows that may be learnt from.

Defined cases: null or empty text, and texts without units of three characters, get the
score of the bias alone; without labelled rows of both classes every score is 0; texts
of any length are scored whole; equal texts score equally.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import TwoGenerationCache, held_out, text_udf, with_struct
from territoria.llm.quality_crf import training_ids

DECAY = 0.6
WINDOW = 14
ALPHABET = 64

_OUTER = ".,;:!?\"'()[]{}<>*_-~#$%&|/\\`«»“”‘’¿¡…+=@^"
_INNER = regex.compile(r"[^\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")


def word_units(word: str) -> list[str]:
    """The units of one lower-cased word."""
    core = word.strip(_OUTER)
    if core.isalnum() or not core:
        return [core] if core else []
    joined = _INNER.sub("", core)
    return [core, joined] if joined and joined != core else [core]


def letter_runs(words: list[str]) -> list[str]:
    """Runs of three or more single-letter words, put together."""
    out, run = [], []
    for w in words:
        c = w.strip(_OUTER) if len(w) < 4 else w
        if len(c) == 1 and c.isalnum():
            run.append(c)
            continue
        if len(run) >= 3:
            out.append("".join(run))
        run = []
    if len(run) >= 3:
        out.append("".join(run))
    return out


def units(text: str) -> set[str]:
    words = text.lower().split()
    return {u for w in set(words) for u in word_units(w)} | set(letter_runs(words))


@lru_cache(maxsize=32)
def _places(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = np.array(list(combinations(range(n), 3)))
    return c[:, 0], c[:, 1], c[:, 2], (DECAY ** (c[:, 2] - c[:, 0] + 1)).astype(np.float32)


def _windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    step = WINDOW // 2
    return [unit[i:i + WINDOW] for i in range(0, len(unit) - WINDOW + step, step)]


class Subsequences:
    """Explicit kernel features of units, in blocks of equal length."""

    def __init__(self, alphabet: dict[str, int]):
        self.alphabet = alphabet

    def blocks(self, items: list[str]):
        """(positions in items, feature ids, weights normalised to unit length) for windows of three characters or more."""
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, u in enumerate(items):
            for w in _windows(u):
                if len(w) >= 3:
                    by_length.setdefault(len(w), []).append((i, w))
        get = self.alphabet.get
        for n, own in by_length.items():
            a, b, c, weight = _places(n)
            for lo in range(0, len(own), 1024):
                part = own[lo:lo + 1024]
                codes = np.array([[get(ch, 0) for ch in w] for _, w in part], np.int64)
                ids = (codes[:, a] * ALPHABET + codes[:, b]) * ALPHABET + codes[:, c]
                row = np.arange(len(part), dtype=np.int64)[:, None] * ALPHABET ** 3
                key = (row + ids).ravel()
                order = np.argsort(key, kind="stable")
                sorted_key = key[order]
                first = np.flatnonzero(np.concatenate(([True], np.diff(sorted_key) != 0)))
                total = np.add.reduceat(np.broadcast_to(weight, ids.shape).ravel()[order], first)
                norm = np.sqrt(np.bincount(sorted_key[first] // ALPHABET ** 3, total * total, len(part)))
                yield np.array([i for i, _ in part]), ids, (weight / norm[:, None]).astype(np.float32)

    def values(self, items: list[str], table: np.ndarray) -> np.ndarray:
        """Highest value of each item's windows under one weight per subsequence; 0 for items without any."""
        out = np.full(len(items), -np.inf)
        for at, ids, weight in self.blocks(items):
            np.maximum.at(out, at, (table[ids] * weight).sum(1))
        out[np.isneginf(out)] = 0.0
        return out

    def table(self, unit: str) -> np.ndarray:
        """The normalised features of one unit (its first window), spread out."""
        out = np.zeros(ALPHABET ** 3, np.float32)
        for _, ids, weight in self.blocks([unit[:WINDOW]]):
            np.add.at(out, ids[0], weight[0])
        return out


@dataclass
class SubsequenceMachine:
    alphabet: dict[str, int]
    table: np.ndarray
    bias: float
    slope: float
    offset: float

    def __post_init__(self):
        self._cache = TwoGenerationCache(200_000)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def margins(self, items: list[str]) -> np.ndarray:
        return Subsequences(self.alphabet).values(items, self.table) + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))

    def score_batch(self, texts: list[str]) -> list[tuple[float, str]]:
        """(score, worst word) of each text.  Words new to the worker are valued together."""
        parts, new = [], {}
        for t in texts:
            words = t.lower().split()
            own = set(words)
            runs = letter_runs(words)
            parts.append((own, runs))
            for w in own:
                if w not in new and self._cache.get(w) is None:
                    new[w] = word_units(w)
            for w in runs:
                if w not in new and self._cache.get(w) is None:
                    new[w] = [w]
        local: dict[str, float] = {}
        if new:
            flat = [u for us in new.values() for u in us]
            values = iter(self.margins(flat).tolist())
            for w, us in new.items():
                local[w] = max([next(values) for _ in us], default=self.bias)
                self._cache.put(w, local[w])
        out = []
        for own, runs in parts:
            best, worst = self.bias, ""
            for w in (*own, *runs):
                v = local.get(w)
                if v is None:
                    v = self._cache.get(w)
                    if v is None:  # left the cache meanwhile
                        v = max(self.margins(word_units(w) or [w]).tolist())
                if v > best or v == best and worst and w < worst:
                    best, worst = v, w
            out.append((self.probability(best), worst))
        return out


def _machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 4.0) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps on its active set; last feature is the bias."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.ones(len(z), bool)
    for _ in range(30):
        a, s = z[active], (c * weight)[active]
        w = np.linalg.solve(ridge + a.T @ (a * s[:, None]), a.T @ (s * y[active]))
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)

    def loss(a: float, b: float) -> float:
        s = a * margin + b
        return float((np.logaddexp(0, s) - t * s).sum() + 5e-3 * a * a)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = x.T @ (t - p) - 1e-2 * np.array([a, 0])
        h = x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-2, 1e-6])
        da, db = np.linalg.solve(h, g)
        size = 1.0
        while size > 1e-6 and loss(a + size * da, b + size * db) > loss(a, b):
            size /= 2
        a, b = a + size * da, b + size * db
        if abs(size * da) + abs(size * db) < 1e-6:
            break
    return float(a), float(b)


def fit(rows: list[tuple[str, int]], landmarks: int = 128, rounds: int = 3, negatives: int = 2500, pool: int = 30_000, seed: int = 7) -> SubsequenceMachine:
    """rows: (text, label)."""
    rng = np.random.default_rng(seed)
    bags = [(sorted({u for s in _SENTENCE.split(t) for u in units(s) if len(u) >= 3}), y) for t, y in rows]
    pos, neg = [b for b, y in bags if y == 1 and b], [b for b, y in bags if y == 0 and b]
    if not pos or not neg:
        return SubsequenceMachine({}, np.zeros(ALPHABET ** 3, np.float32), -1.0, 30.0, 0.0)
    in_pos, in_neg = Counter(u for b in pos for u in b), Counter(u for b in neg for u in b)
    letters = Counter(ch for u in (*in_pos, *in_neg) for ch in u)
    alphabet = {ch: i + 1 for i, (ch, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET - 1])}
    kernel = Subsequences(alphabet)
    clean = sorted(in_neg)
    if len(clean) > pool:
        clean = [clean[i] for i in np.sort(rng.choice(len(clean), pool, replace=False))]
    vocabulary = sorted({*in_pos, *clean})
    place = {u: i for i, u in enumerate(vocabulary)}
    # To begin with, a witness is a unit that several toxic documents share and clean ones hardly have.
    value = np.array([in_pos[u] / len(pos) - 20 * in_neg[u] / len(neg) for u in vocabulary])
    table, bias, least = None, 0.0, 1.5 / len(pos)
    for _ in range(rounds):
        best = [max(b, key=lambda u: (value[place[u]], u)) for b in pos]
        witness = Counter([u for u in best if value[place[u]] > least] or best)
        least = 0.0
        known = [u for u, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))]
        odd = []
        for u in known[:200]:  # the same with a character put in
            for _ in range(2):
                at, ch = int(rng.integers(1, len(u))), list(alphabet)[int(rng.integers(len(alphabet)))]
                odd.append(u[:at] + ch + u[at:])
        hard = sorted(clean, key=lambda u: (-value[place[u]], u))[:negatives]
        drawn = [clean[i] for i in rng.choice(len(clean), min(negatives, len(clean)), replace=False)]
        wrong = sorted({*hard, *drawn})
        marks = known[:landmarks * 3 // 4]
        marks += [wrong[i] for i in rng.choice(len(wrong), min(landmarks - len(marks), len(wrong)), replace=False)]
        marks = list(dict.fromkeys(u[:WINDOW] for u in marks))
        spread = np.stack([kernel.table(u) for u in marks])
        items = known + odd + wrong
        k = np.stack([kernel.values(items, s) for s in spread], 1)
        own = np.stack([kernel.values(marks, s) for s in spread], 1)
        e, q = np.linalg.eigh((own + own.T) / 2)
        live = e > 1e-4
        whiten = q[:, live] / np.sqrt(e[live])
        y = np.array([1.0] * (len(known) + len(odd)) + [-1.0] * len(wrong))
        many = np.array([float(witness[u]) for u in known] + [1.0] * len(odd) + [1.0] * len(wrong))
        at, n = len(known), len(known) + len(odd)
        many[:at] /= many[:at].sum()
        many[at:n] /= 2 * max(len(odd), 1)
        many[n:] /= len(wrong)
        w = _machine(k @ whiten, y, many * 500)
        table, bias = ((whiten @ w[:-1]) @ spread).astype(np.float32), float(w[-1])
        value = kernel.values(vocabulary, table) + bias
    machine = SubsequenceMachine(alphabet, table, bias, 1.0, 0.0)
    top = np.array([machine.margins(b).max() for b, _ in bags if b])
    slope, offset = _calibrate(top, np.array([y for b, y in bags if b], float))
    return SubsequenceMachine(alphabet, table, bias, slope, offset)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_chars: int = 4000) -> SubsequenceMachine:
    ids = F.broadcast(training_ids(labels, "toxic", per_class))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").where(F.length("text") <= max_chars).select("doc_id", "text", "y").collect()
    return fit([(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))])


def score(docs: DataFrame, model: SubsequenceMachine, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """key, held_out, score, predicted, worst_word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one weight per three-character subsequence: 1 MB, whatever the data

    def run(texts: list) -> list:
        return [{"score": s, "worst_word": w} for s, w in shared.value.score_batch([t or "" for t in texts])]

    rows = with_struct(docs, text_udf(run, "struct<score: double, worst_word: string>")(docs[text]), [key])
    return rows.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_word")
