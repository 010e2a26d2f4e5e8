"""Brute-force versions, exact round trips and edge cases of the document operators."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from territoria.llm import (bpe_automaton, chat_format, decontaminate, line_templates, ngram_jaccard, quality_ledger,
                            token_attribution, warc)
from territoria.llm.queries import BYTE_BPE, WORD_BPE

import public_tokenizers

SMALL = "/root/testdata/sf0.001"
OWN = 1_000_000  # ids of the odd documents lie above the tables' own
DOCS = "doc_id long, text string, n_words int"


def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "two words"), (6, "two words"), (6, "two words"), (None, "two words"),
            (7, "Ein Text\nmit Zeilen\n\n"), (8, "İΣ 日本 ́ \x1c x​ <|endoftext|> 's"), (9, "no\x00null")]
    return spark.createDataFrame([(None if i is None else OWN + i, t, 0) for i, t in rows], DOCS)


def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    for r in bpe_automaton.encode(docs, WORD_BPE, keep=("doc_id", "text")).collect():
        e = tok.encode(r["text"] or "", add_special_tokens=False)
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (e.ids, len(e.ids), tok.decode(e.ids, skip_special_tokens=False))
    one = bpe_automaton.encode_digests(docs, WORD_BPE).where(f"doc_id = {OWN + 2}").first()
    assert one["ids_sha256"] == hashlib.sha256(b"").hexdigest() and one["n_tokens"] == 0


def test_gadgets_give_the_merge_order():
    """Random small vocabularies against merging pair by pair."""
    rng = random.Random(3)
    for _ in range(60):
        symbols = ["a", "b", "a</w>", "b</w>"]
        vocab, merges = {s: i for i, s in enumerate(symbols)}, []
        while len(merges) < 12:
            x, y = rng.choice([s for s in vocab if not s.endswith("</w>")]), rng.choice(list(vocab))
            if x + y not in vocab:
                vocab[x + y] = len(vocab)
                merges.append((x, y))
        automaton = bpe_automaton.MergeAutomaton(vocab, merges, "</w>")
        for _ in range(40):
            word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
            parts = [*word[:-1], word[-1] + "</w>"]
            for x, y in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == x and parts[i + 1] == y:
                        parts[i:i + 2] = [x + y]
                    i += 1
            assert [automaton.label[t] for t in automaton.encode(word)] == parts


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(120)]
    rows = [(i, t) for i, t in texts(spark).items()]
    for i in range(80):  # near copies of one text with 0 to 6 words changed, and of its parts
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(30)}"
        rows.append((10_000 + i, " ".join(w)))
    long = [f"v{i % 4001}" for i in range(9000)]
    rows += [(20_000, " ".join(long)), (20_001, " ".join([*long[:8990], "x"])), (20_002, " ".join(long[:5000]))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS).unionByName(odd_docs(spark))
    ids, sets = zip(*[(r["doc_id"], set(ngram_jaccard.shingles(r["text"]).tolist())) for r in docs.collect() if r["doc_id"] is not None])
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    for chunk in (1500, 7):
        got = ngram_jaccard.near_duplicates(docs, chunk=chunk).collect()
        assert len(got) == docs.count()
        assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, find(i)) for i in ids}
        assert {r["n_shingles"] for r in got if r["doc_id"] in (OWN + 1, OWN + 2, OWN + 3)} == {0}
    assert ngram_jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g" if i < 4 else f"other {i}", 0) for i in range(8)] + [(None, "a b c d e f g", 0)], DOCS)
    left = ngram_jaccard.one_of_each(docs, ngram_jaccard.near_duplicates(docs)).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [0, 4, 5, 6, 7] and len(left) == 6


def test_line_templates(spark):
    rows = [(i, f"alpha beta gamma own words of document {i}\nThis page was last changed on {i} May by user{'xyzuvw'[i % 6]} and it stays here\nshort line\nunlike {'qwe' * (i + 1)} all others") for i in range(6)]
    rows += [(6, "Only here stands a sentence of eight words now"), (7, None), (8, ""), (None, "short line")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    assert "last changed" in got[0]["text"] and not any("last changed" in got[i]["text"] for i in range(1, 6))
    assert all("short line" in got[i]["text"] and "unlike" in got[i]["text"] for i in range(6))
    assert got[6]["text"] == rows[6][1] and got[7]["text"] is None and got[8]["text"] == "" and got[0]["n_words"] == 0
    assert line_templates.drop_recurring(docs.limit(0)).count() == 0


def plain_dedup(rows):
    """The rule over dictionaries; rows: (doc_id, text), unique ids."""
    lines = {i: [(*line_templates.parse_line(x), x) for x in (t or "").split("\n")] for i, t in rows}
    forms, parsed = defaultdict(set), {}
    for i, own in lines.items():
        for n, leaf, whole, f, _ in own:
            if n >= 4:
                forms[whole].add(i)
                parsed[whole] = (leaf, n, f)

    def least(n):
        return 2 if n >= line_templates.LONG else 3

    owner = defaultdict(list)
    for whole, ids in forms.items():
        if len(ids) >= least(parsed[whole][1]):
            owner[whole].append(min(ids))
    count, leaves = Counter(), Counter()
    for whole, (leaf, n, f) in parsed.items():
        leaves[leaf] += bool(f)
        for at, x in enumerate(f):
            count[leaf, at, x] += len(forms[whole])
    shapes = defaultdict(list)
    for whole, (leaf, n, f) in parsed.items():
        if f and leaves[leaf] > 1:
            shape = tuple((at, x) for at, x in enumerate(f) if count[leaf, at, x] >= least(n))
            size = [1] * n if n <= 16 else [(at + 1) * n // 16 - at * n // 16 for at in range(16)]
            wild = n - sum(size[at] for at, _ in shape)
            if shape and len(shape) >= 0.5 * len(f) and wild <= 8:
                shapes[leaf, shape].append(whole)
    for (leaf, _), whole in shapes.items():
        if sum(len(forms[w]) for w in whole) >= least(parsed[whole[0]][1]):
            for w in whole:
                owner[w].append(min(min(forms[x]) for x in whole))
    gone = {i: {k for k, (n, _, whole, _, _) in enumerate(own) if n >= 4 and whole in owner and min(owner[whole]) != i} for i, own in lines.items()}
    found, holders = {}, defaultdict(set)
    for i, t in rows:
        found[i] = [(p, k, at) for p, k, at in zip(*(x.tolist() for x in line_templates.pieces(t))) if k not in gone[i]]
        for p, _, _ in found[i]:
            holders[p].add(i)
    out = {}
    for i, own in lines.items():
        cuts = defaultdict(set)
        for p, k, at in found[i]:
            if len(holders[p]) > 1 and min(holders[p]) != i:
                cuts[k] |= set(range(at, at + line_templates.PIECE))
        kept = []
        for k, (_, _, _, _, x) in enumerate(own):
            if k in gone[i]:
                continue
            if k in cuts:
                tokens = re.findall(r"[^ \t\r\x0b\x0c]+[ \t\r\x0b\x0c]*", x)
                stay = [w for j, w in enumerate(tokens) if j not in cuts[k]]
                if not stay:
                    continue
                x = x[:x.index(tokens[0])] + "".join(stay)
            kept.append(x)
        out[i] = ("\n".join(kept), len(gone[i]) + len(cuts))
    return out


def test_line_templates_equal_brute_force(spark):
    """The same rule, long lines and pieces included, over dictionaries."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.drop_recurring(docs).collect()}
    assert got == plain_dedup(rows)
    assert any(n for _, n in got.values()) and any(t != o and t for (t, _), (_, o) in zip((got[i] for i, _ in rows), rows))


def test_line_templates_keep_what_stands_nowhere_else(spark):
    """Lines that share a half with others lose that half only; short variable words are what a template may lose."""
    rng = random.Random(8)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))

    half, rows = words(32), []
    for i in range(4):
        rows.append((i, f"{half} {words(32)}", 1, "x", 0))
    short = words(10)
    rows += [(10 + i, f"{short} {words(10)}", 1, "x", 0) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, _maybe string, _key int")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    for i, text, *_ in rows:
        kept, own = got[i]["text"].split(), text.split()
        assert set(own[32:] if i < 10 else own[10:]) <= set(kept)
        assert (got[i]["_row"], got[i]["_maybe"], got[i]["_key"]) == (1, "x", 0)
    assert half in got[0]["text"] and half not in got[1]["text"]


def test_decontamination_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    item = items.first()
    partial = " ".join(item["text"].split()[: len(item["text"].split()) // 3])
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x " * 300 + item["text"].upper().replace(" ", "  ") + " y" * 300), (-4, partial), (-3, "again")], "doc_id long, text string")
    docs = docs.unionByName(odd)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, items).collect()}
    index = decontaminate.index_blocks(items)[0].value
    expected = set()
    for r in docs.collect():
        words = decontaminate.words_of(r["text"] or "")
        for p in range(0, max(len(words), 1), index.span):
            passage = words[p:p + 2 * index.span]
            runs = decontaminate._runs(passage)
            score = Counter()
            for w in set(passage):
                if w in index.terms:
                    for at, x in zip(*index.postings(index.terms[w])):
                        score[at] += x
            for at, x in score.items():
                i, q, a = index.items[at]
                if x >= 0.6 - 1e-9 and decontaminate._overlap(q, passage, runs) >= 0.6 and decontaminate._overlap(a, passage, runs) >= 0.6:
                    expected.add((r["doc_id"], i))
    assert got == expected and (-3, item["item_id"]) in got and not any(d in (-1, -2, -4) for d, _ in got)
    blocks = decontaminate.index_blocks(items, block_chars=2000)
    assert len(blocks) > 2
    left = decontaminate.clean(docs.withColumn("_hits", F.lit(1)), items)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in docs.collect()} - ({d for d, _ in got} - {-3}) and left.columns[-1] == "_hits"
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0 and decontaminate.contamination(docs.limit(0), items).count() == 0


def test_token_attribution(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_docs(spark).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit(0).alias("n_words")))
    rows = token_attribution.line_token_counts(docs.dropDuplicates(["doc_id"]), BYTE_BPE, public_tokenizers.PATTERN).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        text = r["text"] or ""
        line_of = [0] * (len(text) + 1)
        for i, c in enumerate(text):
            line_of[i + 1] = line_of[i] + (c == "\n")
        raw, at, expected = text.encode(), 0, Counter()
        for t in enc.encode_ordinary(text):
            size = len(enc.decode_single_token_bytes(t))
            first, last = len(raw[:at].decode(errors="ignore")), len(raw[:at + size].decode(errors="ignore"))
            chars = range(first, max(last, first + 1)) if raw[:at + size].decode(errors="ignore").encode() == raw[:at + size] else range(first, last + 1)
            at += size
            share = Counter(line_of[c] for c in chars)
            expected[min(share, key=lambda s: (-share[s], s))] += 1
        assert r["section_tokens"] == [expected[i] for i in range(text.count("\n") + 1)]
        assert sum(r["section_tokens"]) == r["n_tokens"] == len(enc.encode_ordinary(text))


def test_chat_round_trip(spark):
    own = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", own), (-1, 1, "assistant", own), (2, 1, "assistant", None), (2, 0, "to<s>ol", "<\\s> [\\\\INST] <\\/s>"), (2, 2, None, "[ROLE]"),
            (3, 0, "assistant", "a" * 30_000), (3, 0, "assistant", "a" * 30_000), (None, 5, "system", "")]
    turns = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    formatted = chat_format.assemble(turns, BYTE_BPE, public_tokenizers.PATTERN)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted, BYTE_BPE, public_tokenizers.PATTERN).collect()}
    assert set(got) == {-1, 2, 3, None}
    for key in got:
        own_rows = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        assert got[key]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own_rows).encode()).hexdigest()
        said = "".join(r[3] or "" for r in own_rows if r[2] == "assistant")
        assert (got[key]["loss_chars"], got[key]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-1]["formatted_chars"] == len("[INST]<\\/s>[\\INST] ok [\\/INST][/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>")
    assert chat_format.read_back(formatted.limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_warc_round_trip(spark, tmp_path):
    import gzip

    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(32, 500)) for _ in range(60_000))
    rows = [(1, "http://a", "<p>x</p>", 0), (2, None, "<p>x</p>", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", noise, 0), (None, "u", "<p>x</p>", 0), (6, "u", "é\r\n\r\n", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "a").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\n") == len(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("128m", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            got = {r["page_id"]: r for r in warc.read_archive(spark, path).collect()}
            assert set(got) == {1, 2, 3, 4, 5, 6, None} and all(r["digest_ok"] for r in got.values())
            assert {k for k, r in got.items() if r["record_type"] == "revisit"} == {2, 4, None}
            assert (got[2]["refers_to"], got[4]["refers_to"], got[None]["refers_to"], got[5]["refers_to"]) == (1, 3, 1, None)
            assert bytes(got[5]["payload"]).decode() == noise and got[2]["payload_bytes"] == 8 and got[2]["payload_digest"] == got[1]["payload_digest"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    warc.write_archive(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archive(spark, str(tmp_path / "b")).count() == 0


def test_warc_pieces_across_ranges():
    """A chance magic inside a member, cut at any place, is put together again."""
    member = warc._member(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    rng = warc._Range()
    assert rng.piece(member[3:20]) is None and rng.pending and not rng.found
    assert warc._decode(member)[0] == "whole" and warc._decode(member[:20])[0] == "part" and warc._decode(b"\x1f\x8b\x08junk" * 9)[0] == "bad"


def test_quality_ledger(spark):
    docs = odd_docs(spark)
    rows = {r["doc_id"] - OWN: r for r in quality_ledger.ledger(docs).collect() if r["doc_id"]}
    assert rows[1]["n_words"] == rows[2]["n_words"] == 0 and rows[4]["n_words"] == 40_000 and rows[7]["n_lines"] == 2
    assert rows[4]["n_repeat_words"] == 40_000 and rows[5]["failure_bits"] == quality_ledger.mask_of(("few_words",))
    kept = quality_ledger.apply_policy(docs, "base-1")
    assert kept.columns == docs.columns and kept.count() == 0 and quality_ledger.apply_policy(docs.limit(0)).count() == 0
    full = quality_ledger.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    alone = {r["rule"]: r["failed_alone"] for r in quality_ledger.ablations(full).collect()}
    for rule in quality_ledger.RULES:
        mask = quality_ledger.mask_of(quality_ledger.POLICIES["prose-2"])
        assert alone[rule] == full.where((F.col("failure_bits").bitwiseAND(mask)) == quality_ledger.mask_of((rule,))).count()


def test_a_linked_pair_does_not_keep_its_whole_block():
    import numpy as np
    from territoria.llm import ngram_jaccard as nj

    word = lambda i: f"w{i * 7919 % 10007}"
    twin = " ".join(word(i) for i in range(300))
    texts = [twin, twin + " more", *(" ".join(word(i + 400 * k) for i in range(301)) for k in range(1, 9))]
    sets = sorted(map(nj.shingles, texts), key=len)
    stay = nj._ruled_in(np.array([len(s) for s in sets]), [np.frombuffer(nj.sketch(s), np.uint8) for s in sets])
    linked = [any(nj.linked(len(np.intersect1d(a, b)), len(a), len(b)) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    assert sum(linked) == 2 and stay.tolist() == linked


def test_long_lines_recur_from_two_documents(spark):
    long = " ".join(f"l{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(50))
    form = [" ".join([f"m{'abcdefghij'[i % 10] * (i // 10 + 1)}" for i in range(63)] + [last]) for last in ("one", "two")]
    short = " ".join(long.split()[:49])
    rows = [(i, f"{long}\n{form[i - 1]}\n{short}\nown {'xy'[i - 1]} words here", 0) for i in (1, 2)]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in line_templates.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == (f"{short}\nown y words here", 2)


def test_pieces_meet_whatever_surrounds_them():
    rng = random.Random(11)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.choice('klmnop') * rng.randint(1, 4)}{rng.choice('xyz')}{''.join(rng.choices('qrstuv', k=4))}" for _ in range(n)]
    for _ in range(200):
        shared = words(50)
        a, b = (" ".join([*words(rng.randint(0, 60)), *shared, *words(rng.randint(0, 60))]) for _ in range(2))
        common = set(line_templates.pieces(f"x y\n{a}")[0].tolist()) & set(line_templates.pieces(f"{b}\n{' '.join(words(70))}")[0].tolist())
        assert common
    assert [len(x) for x in line_templates.pieces(" ".join(words(49)) + "\n" + " ".join(words(49)))] == [0, 0, 0] == [len(x) for x in line_templates.pieces(None)]


def test_passages_inside_long_lines(spark):
    word = lambda d, i: f"{d}{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 16 % 10]}{'abcdefghij'[i // 160]}"
    shared = [word("s", i) for i in range(120)]
    rows = [(d, " ".join([*(word(f"p{'xyz'[d]}", i) for i in range(10 + 7 * d)), *shared, *(word(f"q{'xyz'[d]}", i) for i in range(30))]) + f"\n\nown {'xyz'[d]} end", 0)
            for d in range(3)]
    rows += [(None, rows[0][1], 0), (9, "a  b\tc", 0)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0]["text"] == rows[0][1] and got[9]["text"] == "a  b\tc"
    for d in (1, 2):
        left = got[d]["text"].split("\n")[0].split()
        assert [w for w in left if w not in shared] == [w for w in rows[d][1].split("\n")[0].split() if w not in shared]
        assert sum(w in shared for w in left) <= 48 and got[d]["text"].endswith(f"\n\nown {'xyz'[d]} end") and got[d]["n_dropped"] == 1
    again = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame([(1, None, 0), (2, "", 0)], DOCS)).collect()}
    assert again == {1: None, 2: ""}


def test_second_pass_holds_two_chunks_at_most(spark, monkeypatch, tmp_path):
    rng = random.Random(23)
    head = [f"h{i}" for i in range(84)]  # shared by all: 80 of 100 shingles, less than a link but part of every prefix
    rows = [(i, " ".join(head + [f"w{i}x{rng.randrange(10**9)}" for _ in range(20)]), 0) for i in range(240)]
    rows += [(1000 + i, rows[i][1] + " more", 0) for i in range(0, 240, 8)]
    real, folder = ngram_jaccard._verify_apart, str(tmp_path)

    def watched(batches):
        import collections
        import uuid

        held = collections.Counter()

        def seen():
            for b in batches:
                held.update(zip(b.column("leader").to_pylist(), b.column("chunk").to_pylist()))
                yield b

        yield from real(seen())
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(map(str, held.values())))

    monkeypatch.setattr(ngram_jaccard, "_verify_apart", watched)
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), chunk=20, sketch_block=10).collect()}
    assert got == {i: i - 1000 if i >= 1000 else i for i, _, _ in rows}
    sizes = [int(n) for p in tmp_path.iterdir() for n in p.read_text().split()]
    assert sizes and max(sizes) <= 100  # 270 texts in 14 chunks dealt by hash


def _near(spark, rows, **bounds):
    return {r["doc_id"]: r["component_id"] for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), **bounds).collect()}


def test_texts_with_a_phrase_in_common_by_chance_do_not_meet(spark, monkeypatch):
    """Each pair of neighbours shares one or two shingles that no other text has; every ninth text has a near copy."""
    rng, sizes = random.Random(31), {}
    phrase = [[f"p{i}x{j}" for j in range(6)] for i in range(200)]
    rows = [(i, " ".join(phrase[i - 1] + [f"w{i}x{rng.randrange(10**9)}" for _ in range(30)] + phrase[i]), 0) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more", 0) for i in range(0, 200, 9)]
    real = ngram_jaccard.written

    def counted(df, name):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counted)
    assert _near(spark, rows) == {i: i - 1000 if i >= 1000 else i for i, _, _ in rows}
    assert sizes["block"] <= 2 * len(range(0, 200, 9))  # the texts and their copies, no others


def test_jaccard_does_not_depend_on_the_sample(spark, monkeypatch):
    """Pairs, groups of eight, nine and thirty near copies, short texts, whatever is taken for frequent."""
    rng = random.Random(37)
    rows = []
    for family, size in enumerate((2, 2, 3, 8, 9, 30, 5)):
        words = [f"f{family}x{rng.randrange(10**6)}" for _ in range(6 if family == 6 else 90)] + [f"common{i}" for i in range(12)]
        for _ in range(size):
            w = list(words)
            for _ in range(rng.randint(0, 3) if len(w) > 50 else 0):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[:rng.randint(len(w) - 2, len(w))]), 0))
    rows += [(1000 + i, " ".join(f"common{j}" for j in range(i)), 0) for i in range(1, 13)]
    ids, sets = [r[0] for r in rows], [set(ngram_jaccard.shingles(r[1]).tolist()) for r in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    expected = {i: find(i) for i in ids}
    assert len(set(expected.values())) < len(ids) - 40
    for sample_docs, every, most in ((20_000, 12, 1_000_000), (1, 12, 1_000_000), (1, 10**9, 1_000_000), (20_000, 12, 3)):
        monkeypatch.setattr(ngram_jaccard, "SAMPLE_EVERY", every)
        monkeypatch.setattr(ngram_jaccard, "MOST_FREQUENT", most)
        assert _near(spark, rows, sample_docs=sample_docs) == expected


def test_jaccard_of_rows_that_share_an_id(spark):
    """Random tables in which ids stand for several texts: rows of an id are of one class, links are all found."""
    rng = random.Random(11)
    for _ in range(3):
        base = [[f"{rng.choice('abcdef')}{rng.randint(0, 40)}" for _ in range(30)] for _ in range(4)]
        rows = []
        for _ in range(16):
            words = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(30)] = f"z{rng.randint(0, 5)}"
            rows.append((rng.randint(1, 9), " ".join(words)))
        sets = [set(ngram_jaccard.shingles(t).tolist()) for _, t in rows]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for i, (x, _) in enumerate(rows):
            for j in range(i):
                if x == rows[j][0] or 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[find(i)] = find(j)
        least = {}
        for i, (x, _) in enumerate(rows):
            least[find(i)] = min(x, least.get(find(i), x))
        expected = sorted((x, least[find(i)]) for i, (x, _) in enumerate(rows))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for bounds in ({}, {"chunk": 2}, {"chunk_shingles": 60, "sketch_shingles": 50}):
            got = ngram_jaccard.near_duplicates(docs, **bounds)
            assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == expected


def test_very_long_runs_are_encoded_whole():
    from territoria.llm.common import encode_text

    enc, _ = token_attribution._encoding(BYTE_BPE, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for run in (" ", "\n", "\t", " \u3000\n", "a"):
        for n in (9_999, 10_000, 40_003):
            for before, after in (("", ""), ("word", "next"), ("word", ""), ("", "\u00e9 x"), ("a.", " 's")):
                text = before + "".join(rng.choice(run) for _ in range(n)) + after
                assert encode_text(enc, text) == enc.encode_ordinary(text)


def test_five_million_spaces(spark):
    n = 5_000_000
    rows = [(1, f"a{' ' * n}b\nc"), (2, "\n" * n), (3, "\t" * n + "x"), (4, "a" * n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_attribution.line_token_counts(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()}
    assert got[1]["n_sections"] == 2 and got[2]["n_sections"] == n + 1
    assert all(sum(r["section_tokens"]) == r["n_tokens"] > 0 for r in got.values())
    turns = spark.createDataFrame([(1, 0, "user", rows[0][1]), (1, 1, "assistant", " " * n)], "conv_id long, turn long, role string, text string")
    back = chat_format.read_back(chat_format.assemble(turns, BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE, public_tokenizers.PATTERN).first()
    assert (back["n_turns"], back["loss_chars"], back["loss_sha256"]) == (2, n, hashlib.sha256(b" " * n).hexdigest())


def test_bpe_words_as_the_pattern_cuts_them():
    """Letters with signs behind them are cut without the pattern: the same words."""
    tok = bpe_automaton.tokenizer(WORD_BPE)
    for chunk in ("It's", "they'll,", "'s", "abc", "Abc...", "été!?", "a-b", "x1", "12", "--", "''", "é'd", "don't.", "µª", "ɐa,", "a\x7f,", "日本!"):
        low = chunk.lower()
        assert [w for w in tok._words(chunk) if w] == tok.split.findall(low) and all(tok._words(chunk))
