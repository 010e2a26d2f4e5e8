"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features, its neighbours' features
and the labels next to it.  A document's score is the length-weighted mean of the
lines' marginal probability of being good (scaled forward-backward).

The model is fitted on the driver from line features (never texts) of a bounded
sample of labelled documents: at most `per_class` of each label with at most
`max_lines` lines, chosen by a hash of the id among rows that may be learnt from
(crc32 of the id modulo 3 is not 1).  Lines inherit their document's label.

Defined cases: null or empty text is one empty line and gets the score of its
features; a document without line feeds is one line; without any labelled rows every
score is 0.5; documents of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import held_out, text_udf, with_struct

OWN = ("bias", "upper", "symbols", "shouts", "bars", "echo", "repeated", "log_words", "word_length", "stops", "digits", "seen_before", "short")
NEIGHBOUR = tuple(OWN.index(f) for f in ("upper", "symbols", "shouts", "bars", "echo", "repeated", "seen_before"))
N_FEATURES = len(OWN) + 2 * len(NEIGHBOUR) + 2

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def own_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Per line: its own features and its length in characters (1 at least)."""
    lines = text.split("\n")
    x = np.zeros((len(lines), len(OWN)), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        b = line.encode()
        words = b.split()
        n = len(words)
        row = x[i]
        row[0] = 1
        if n:
            letters = len(b) - len(b.translate(None, _LETTERS))
            row[1] = (len(b) - len(b.translate(None, _UPPER))) / max(letters, 1)
            row[2] = min((len(b) - len(b.translate(None, b"#*$%&<>"))) / n, 3) / 3
            row[3] = min(b.count(b"!") / n, 2) / 2
            row[4] = min(b.count(b"|") / n, 1)
            row[5] = sum(map(bytes.__eq__, words, words[1:])) / n
            row[6] = 1 - len(set(words)) / n
            row[7] = np.log1p(n) / 5
            row[8] = min((len(b) - n + 1) / n / 10, 3)
            row[9] = min((b.count(b".") + b.count(b",")) / n, 1)
            row[10] = (len(b) - len(b.translate(None, b"0123456789"))) / len(b)
            row[11] = line in seen
            seen.add(line)
        row[12] = n < 3
    return x, np.array([max(len(line), 1) for line in lines], np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, the neighbouring lines' features, and whether there is a line before and after."""
    near = own[:, NEIGHBOUR]
    edge = np.zeros((1, near.shape[1]), np.float32)
    ones = np.ones((len(own), 2), np.float32)
    ones[0, 0] = ones[-1, 1] = 0
    return np.hstack([own, np.vstack([edge, near[:-1]]), np.vstack([near[1:], edge]), ones])


@dataclass(frozen=True)
class LineField:
    """weights: log odds of good against bad by feature; follow[a, b]: score of label b after label a."""

    weights: np.ndarray
    follow: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for every line of one document."""
        odds = np.clip(x @ self.weights, -30, 30)
        if len(x) == 1:
            return 1 / (1 + np.exp(-odds))
        p1 = (1 / (1 + np.exp(-odds))).tolist()
        (a, b), (c, d) = np.exp(self.follow).tolist()
        forward, g, h = [], 0.0, 0.0
        for t, p in enumerate(p1):
            if t:
                g, h = (1 - p) * (g * a + h * c), p * (g * b + h * d)
            else:
                g, h = 1 - p, p
            z = g + h
            g, h = g / z, h / z
            forward.append((g, h))
        out = [0.0] * len(p1)
        u = v = 1.0
        for t in range(len(p1) - 1, -1, -1):
            g, h = forward[t]
            out[t] = h * v / (g * u + h * v)
            p = p1[t]
            u, v = a * (1 - p) * u + b * p * v, c * (1 - p) * u + d * p * v
            z = u + v
            u, v = u / z, v / z
        return np.array(out)

    def score(self, text: str) -> float:
        own, length = own_features(text)
        return float(self.marginals(with_neighbours(own)) @ length / length.sum())


def fit(documents: list[tuple[np.ndarray, int]], steps: int = 200, l2: float = 1e-3, rate: float = 0.15) -> LineField:
    """Maximum conditional likelihood by Adam, all documents at once, line by line."""
    if not documents:
        return LineField(np.zeros(N_FEATURES), np.zeros((2, 2)))
    documents = sorted(documents, key=lambda d: -len(d[0]))  # the documents alive at a line are then a prefix
    xs = [with_neighbours(o) for o, _ in documents]
    size = np.array([len(d) for d in xs])
    longest = int(size[0])
    live = [int((size > t).sum()) for t in range(longest)]
    x = [np.stack([d[t] for d in xs[:live[t]]]).astype(np.float64) for t in range(longest)]
    y = np.array([label for _, label in documents], np.float64)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # either class counts half
    share = share / size  # and every document of a class alike
    w, f = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = (share * (size - 1))[y == label].sum()
    for step in range(1, steps + 1):
        move = np.exp(f)
        p, fwd = [], []
        for t in range(longest):
            p1 = 1 / (1 + np.exp(-np.clip(x[t] @ w, -30, 30)))
            p.append(np.stack([1 - p1, p1], -1))
            a = p[t] * (fwd[t - 1][:live[t]] @ move) if t else p[t]
            fwd.append(a / a.sum(-1, keepdims=True))
        back = np.ones((live[-1], 2))
        grad_w, expected = np.zeros(N_FEATURES), np.zeros((2, 2))
        for t in range(longest - 1, -1, -1):
            n = live[t]
            back = np.vstack([back, np.ones((n - len(back), 2))])  # documents that end at this line
            q = fwd[t] * back
            q /= q.sum(-1, keepdims=True)
            grad_w += x[t].T @ ((y[:n] - q[:, 1]) * share[:n])
            if t:
                inner = p[t] * back
                pair = fwd[t - 1][:n, :, None] * move * inner[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                expected += (pair * share[:n, None, None]).sum(0)
                back = inner @ move.T
                back /= back.sum(-1, keepdims=True)
        g = np.concatenate([grad_w - l2 * w, (seen - expected - l2 * f).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move_by = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, f = w + move_by[:N_FEATURES], f + move_by[N_FEATURES:].reshape(2, 2)
    return LineField(w, f)


def training_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class ids of each label 0 and 1, by a hash of the id; held-out rows never."""
    clean = labels.select(labels["doc_id"], labels[label].cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    clean = clean.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = [clean.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return pick[0].unionByName(pick[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, max_lines: int = 60) -> LineField:
    # At most 2 * per_class ids: their size is bound, so they are broadcast to the scan of the documents.
    ids = F.broadcast(training_ids(labels, "quality", per_class))
    pick = docs.select("doc_id", "text").join(ids, "doc_id").where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= max_lines)

    def run(texts: list) -> list:
        return [own_features(t or "")[0].tobytes() for t in texts]

    rows = pick.select("doc_id", "y", text_udf(run, "binary")(F.col("text")).alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    return fit([(np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, len(OWN)), r["y"]) for r in rows])


def score(docs: DataFrame, model: LineField, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """key, held_out, score, predicted."""
    def run(texts: list) -> list:
        return [{"score": model.score(t or "")} for t in texts]

    rows = with_struct(docs, text_udf(run, "struct<score: double>")(docs[text]), [key])
    return rows.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def label_lines(docs: DataFrame, model: LineField, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and, per line, the marginal probability of being good."""
    def run(texts: list) -> list:
        return [{"p_good": model.marginals(with_neighbours(own_features(t or "")[0])).tolist()} for t in texts]

    return with_struct(docs, text_udf(run, "struct<p_good: array<double>>")(docs[text]), [key])
