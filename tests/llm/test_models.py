"""Held-out accuracy and edge cases of the two classifiers."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from territoria.llm import quality_crf, toxicity

DOCS = "doc_id long, text string, score double"


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("module, label, least", [(quality_crf, "quality", 0.97), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, tables, module, label, least):
    docs, labels = tables
    rows = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").where("held_out")
    right, n = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count(F.lit(1))).first()
    assert n > 500 and right >= least


@pytest.mark.parametrize("module", [quality_crf, toxicity])
def test_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "word " * 50_000, 0.0), (4, "same", 1.0), (4, "same", 2.0), (None, "x\n\n\ny", 0.0)], DOCS)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = module.train(docs, given)
        rows = module.score(docs, model).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert module.score(docs.limit(0), model).count() == 0


def test_gapped_insults():
    rows = [(f"you {w} there friend", 1) for w in ("idiot", "moron", "loser") for _ in range(20)] + [(f"you word{i} walks there my friend now", 0) for i in range(80)]
    model = toxicity.fit(rows)
    (plain, _), (spaced, _), (dotted, _), (clean, _) = model.score_batch(["an idiot", "an i d i o t", "an i.d.i.o.t", "walks there now"])
    assert min(plain, spaced, dotted) >= 0.7 and clean < 0.3


def test_line_marginals_see_their_neighbours(spark, tables):
    docs, labels = tables
    model = quality_crf.train(docs, labels)
    assert model.follow[0, 0] + model.follow[1, 1] > model.follow[0, 1] + model.follow[1, 0]


def test_line_marginals_equal_enumeration_of_all_labelings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 6, 9):
        for _ in range(10):
            field = quality_crf.LineField(rng.normal(0, 1.5, quality_crf.N_FEATURES), rng.normal(0, 1.5, (2, 2)))
            x = rng.normal(0, 1, (n, quality_crf.N_FEATURES))
            odds = np.clip(x @ field.weights, -30, 30)
            weight = {y: np.exp(sum(o for o, b in zip(odds, y) if b) + sum(field.follow[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=n)}
            plain = [sum(w for y, w in weight.items() if y[t]) / sum(weight.values()) for t in range(n)]
            assert np.allclose(field.marginals(x), plain, rtol=1e-9, atol=1e-12)


def test_document_quality_is_the_length_weighted_mean(spark, tables):
    """score against marginals enumerated over the lines of short texts of the table"""
    docs, labels = tables
    model = quality_crf.train(docs, labels)
    texts = [r["text"] for r in docs.where("size(split(text, '\\n')) between 2 and 9").orderBy("doc_id").limit(40).collect()]
    assert texts
    for text in texts:
        own, _ = quality_crf.own_features(text)
        x = quality_crf.with_neighbours(own)
        odds = np.clip(x @ model.weights, -30, 30)
        lines = text.split("\n")
        total, good = 0.0, 0.0
        for y in product((0, 1), repeat=len(lines)):
            w = np.exp(sum(o for o, b in zip(odds, y) if b) + sum(model.follow[a, b] for a, b in zip(y, y[1:])))
            total += w
            good += w * sum(max(len(line), 1) for line, b in zip(lines, y) if b)
        assert model.score(text) == pytest.approx(good / total / sum(max(len(line), 1) for line in lines), rel=1e-6)


def _features(unit: str) -> dict:
    """All subsequences of three characters, each occurrence weighted by its span, at unit length."""
    out: dict = {}
    for i, j, k in combinations(range(len(unit)), 3):
        key = unit[i] + unit[j] + unit[k]
        out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {key: v / norm for key, v in out.items()}


def _kernel(a: str, b: str) -> float:
    fa, fb = _features(a), _features(b)
    return sum(v * fb.get(key, 0.0) for key, v in fa.items())


def test_kernel_equals_its_definition():
    rng = np.random.default_rng(5)
    letters = "abcdeé日"
    kernel = toxicity.Subsequences({ch: i + 1 for i, ch in enumerate(letters)})
    words = ["".join(rng.choice(list(letters), rng.integers(3, toxicity.WINDOW + 1))) for _ in range(60)] + ["aaa", "aaaa", "aba"]
    for mark in words[:12]:
        got = kernel.values(words, kernel.table(mark))
        assert np.allclose(got, [_kernel(w, mark) for w in words], atol=2e-6)
    long = "".join(rng.choice(list(letters), 40))
    step = toxicity.WINDOW // 2
    windows = [long[i:i + toxicity.WINDOW] for i in range(0, len(long) - toxicity.WINDOW + step, step)]
    assert set(long) <= set("".join(windows)) and windows[-1].endswith(long[-1])
    assert kernel.values([long], kernel.table(words[0]))[0] == pytest.approx(max(_kernel(w, words[0]) for w in windows if len(w) >= 3), abs=2e-6)


def test_scores_equal_the_worst_unit_worked_out_plainly(spark, tables):
    docs, labels = tables
    model = toxicity.train(docs, labels)
    back = {v: k for k, v in model.alphabet.items()}
    a = toxicity.ALPHABET

    def value(unit: str) -> float:
        best = None
        for w in toxicity._windows(unit):
            if len(w) < 3:
                continue
            known = "".join(ch if ch in model.alphabet else "\0" for ch in w)
            codes = {"\0": 0, **model.alphabet}
            v = sum(x * model.table[(codes[key[0]] * a + codes[key[1]]) * a + codes[key[2]]] for key, x in _features(known).items())
            best = v if best is None else max(best, v)
        return (0.0 if best is None else best) + model.bias

    assert len(back) == len(model.alphabet)
    texts = [r["text"] for r in docs.where("length(text) between 1 and 600").orderBy("doc_id").limit(60).collect()]
    texts += ["", "hi", "y o u i d i o t", "st-up.id!", "word " * 3 + "x" * 50]
    for text, (score, _) in zip(texts, model.score_batch(texts)):
        margin = max([model.bias] + [value(u) for u in toxicity.units(text)])
        assert score == pytest.approx(model.probability(margin), abs=1e-4)
