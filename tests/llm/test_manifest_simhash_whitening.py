"""Merkle manifest, SimHash classes and whitening against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from territoria.llm import merkle_manifest as mm
from territoria.llm import queries, simhash_segments, whitening

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, hash int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def plain_tree(leaves):
    """(root, siblings of each leaf, their place among the run) level by level."""
    level, at, proof = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
            proof[k].append((i % 3, [level[j] for j in run if j != i]))
        level = [sha(*level[j:j + 3]) for j in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], proof


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees[s] = own, *plain_tree([plain_leaf(r, r["text"]) for r in own])
    root, upper = plain_tree([trees[s][1] for s in order]) if order else (None, [])
    for s, above in zip(order, upper):
        own, sub, proof = trees[s]
        for r, below in zip(own, proof):
            path = below + above
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = plain_leaf(r, text)
            for at, others in path:
                h = sha(*others[:at], h, *others[at:])
            yield (r["doc_id"], plain_leaf(r, r["text"]), sub, root, sha(*[x for _, o in path for x in o]), h, h == root)


def manifest_rows(monkeypatch, spark, docs):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op11_merkle_manifest(spark, "")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=str)


def test_postorder_places():
    for n in range(1, 100):
        h = mm.height_of(n)
        for height in {h, h + 2}:
            log = mm.append_log([bytes([i]) for i in range(n)], height)
            counts = [-(-n // 3 ** t) for t in range(height + 1)]
            places = {(t, k): mm.position(t, k, n, height) for t in range(height + 1) for k in range(counts[t])}
            assert sorted(places.values()) == list(range(len(log)))
            seen = [0] * (height + 1)
            for p, (level, _) in enumerate(log):
                assert places[level, seen[level]] == p
                seen[level] += 1
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(50)]
    log = mm.append_log(leaves, 4)
    for i, leaf in enumerate(leaves):
        assert mm.fold_path(leaf, mm.path_of([d for _, d in log], i, 50, 4)) == log[-1][1]


def test_manifest_equals_plain_version(spark, monkeypatch):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = manifest_rows(monkeypatch, spark, docs)
    assert got == sorted(plain_manifest(docs.collect()), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("span", [1, 2])
def test_manifest_of_several_rounds(spark, monkeypatch, span):
    """Segments of 3 and 9 leaves, so that the log takes many rounds; odd rows."""
    whole = mm.manifest
    monkeypatch.setattr(mm, "manifest", lambda docs: whole(docs, depth=span))
    rng = random.Random(span)
    rows = [(i, f"text {i}\n" * rng.randint(0, 2), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "ä", "z", "Z"]), i, "p", 1) for i in range(90)]
    rows += [(None, "x", None, None, None, "p", 1), (None, None, None, None, None, None, None), (5, "same", "en", "hot", 4, "p", 1), (5, "same", "en", "hot", 4, "p", 1),
             (7, None, "en", "", 0, "p", 1), (8, "", "en", "one", 0, "p", 1), (-9, "long\n" * 200_000, "en", "z", 1, "p", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert manifest_rows(monkeypatch, spark, docs) == sorted(plain_manifest(docs.collect()), key=str)


def test_manifest_of_little(spark, monkeypatch):
    assert manifest_rows(monkeypatch, spark, spark.createDataFrame([], DOCS)) == []
    one = spark.createDataFrame([(3, "a\nb", "en", "s", 3, "p", 1)], DOCS)
    got = manifest_rows(monkeypatch, spark, one)
    assert got == list(plain_manifest(one.collect())) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha()


def plain_print(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """prints: (doc_id, fingerprint); the smallest reachable doc_id of each."""
    distinct = sorted({f for _, f in prints})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    by_id = {}
    for i, f in prints:
        if i in by_id:
            root[find(by_id[i])] = find(f)
        by_id[i] = f
    least = {}
    for i, f in prints:
        least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least[find(f)] for i, f in prints}


def test_simhash_equals_plain_version(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    prints = [(r["doc_id"], plain_print(r["text"])) for r in docs.collect()]
    expected = plain_classes(prints)
    got = simhash_segments.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((i, f"{f:016x}", expected[i, f]) for i, f in prints)
    assert len(set(expected.values())) < len(prints)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 4999}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + " x"), (None, "one"), (9, "one two three\x1c"), (4, "other words"), (10, "other  WORDS")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    prints = [(i, plain_print(t)) for i, t in rows if i is not None]
    expected = plain_classes(prints)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_segments.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(i, f"{f:016x}", expected[i, f]) for i, f in prints] + [(None, f"{plain_print('one'):016x}", None)], key=str)
    assert simhash_segments.near_duplicates(docs.limit(0)).collect() == []


def test_simhash_links_of_crowded_points(spark):
    """Families of fingerprints a few bits apart, far more than CROWD in a point, and lone ones."""
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(400)}
    for bits in (8, 13, 20):
        centre = rng.getrandbits(64)
        spots = rng.sample(range(64), bits)
        prints |= {centre ^ sum(1 << b for b in rng.sample(spots, rng.randint(0, 4))) for _ in range(700)}
    prints |= {0, (1 << 64) - 1, (1 << 64) - 2, 1 << 63, 3 << 62}
    df = spark.createDataFrame([(simhash_segments._signed(f),) for f in prints], "fp long").repartition(6)
    met = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash_segments.links(df).collect()]
    assert all((a ^ b).bit_count() <= 2 and a != b for a, b in met)
    expected = plain_classes([(f, f) for f in prints])
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in met:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for f in prints:
        groups[find(f)].add(expected[f, f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(expected.values()))
    assert len(met) < 40 * len(prints)  # no pairs of a whole family


def test_segment_counts_bound_the_distance():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5)))
        x, y = (int(p) for p in simhash_segments._points(np.array([a, b], np.uint64)))
        manhattan = sum(abs((x >> j & 3) - (y >> j & 3)) for j in range(0, 64, 2))
        assert manhattan <= (a ^ b).bit_count() and all((x >> j & 3) == (a >> j & 3).bit_count() for j in range(0, 64, 2))


def check_whitened(got, vectors, count=4):
    """vectors: (vec_id, list of float) of the rows that remain."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for _, v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=float)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = fit - fit.mean(0)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    k = min(count, int((value > 1e-12 * value.sum()).sum()))
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == len(vectors) * k
    for c in range(k):
        white = (x.astype(float) - fit.mean(0)) @ vector[:, c] / np.sqrt(value[c])
        mine = np.array([rows[i, c + 1]["whitened"] for i, _ in vectors])
        sign = np.sign(mine @ white)
        assert np.abs(mine - sign * white).max() < 1e-8
    for (i, _), r in zip(vectors, x):
        row = rows[i, 1]
        assert row["n"] == n and row["deviation"] == sum((n * int(a) - s) ** 2 for a, s in zip(r, sums))
        assert abs(row["explained"] - value[0] / value.sum()) < 1e-10 and row["identity_error"] < 1e-9


@pytest.mark.parametrize("folder", [SMALL, MEDIUM, "/root/testdata/sf0.1"])
def test_whitening_equals_full_decomposition(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    check_whitened(queries.op13_whitening(spark, folder).collect(), [(r["vec_id"], r["embedding"]) for r in rows])


EMB = "vec_id long, embedding array<float>, x int, n string"


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(v) for v in rng.normal(size=30).astype(np.float32)]) for i in range(80)]
    good += [(100 + i, list(good[3][1])) for i in range(20)] + [(3, list(good[5][1])), (3000, [-0.001] * 30)]
    bad = [(200, None), (201, []), (202, [float("nan")] + [0.5] * 29), (203, [float("inf")] * 30), (204, [None] + [0.5] * 29), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], EMB).repartition(4)
    got = whitening.whiten(df).collect()
    unique = [(i, v) for i, v in good if i != 3]
    assert {r["vec_id"] for r in got} == {i for i, _ in good} and len(got) == 4 * len(good)
    check_whitened([r for r in got if r["vec_id"] != 3], unique + [])


def test_whitening_of_little(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], EMB)).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    check_whitened(run([(1, [1.0, 0.0]), (2, [0.0, 2.0])]), [(1, [1.0, 0.0]), (2, [0.0, 2.0])])
    check_whitened(run([(1, [1.0]), (2, [4.0]), (3, [-2.5])]), [(1, [1.0]), (2, [4.0]), (3, [-2.5])])
    big = [(1, [3e15, 0.0]), (2, [-3e15, 1.0])]
    assert all(r["deviation"] is None for r in run(big)) and len(run(big)) == 2


def test_filter_on_a_narrow_gap():
    """The filtered iteration on a matrix whose wanted values stand close to the rest."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    value = np.concatenate([[1.05, 1.04, 1.03, 1.0201], np.linspace(0.5, 1.02, 196)[::-1]])
    v = (q * value) @ q.T

    class Plain:
        dims = 200

        def times(self, x):
            return v @ x

        def trace(self):
            return float(np.trace(v))

    got, vectors, _ = whitening.leading_components(Plain())
    assert np.abs(got - value[:4]).max() < 1e-12 and np.abs(np.abs(np.sum(vectors * q[:, :4], 0)) - 1).max() < 1e-9
