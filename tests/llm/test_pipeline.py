"""The pipeline against the same stages worked out plainly, and its edge cases."""

import shutil

import pytest
from pyspark.sql import functions as F

from territoria.llm import decontaminate, line_templates, ngram_jaccard, quality_ledger
from territoria.llm.queries import WORD_BPE

import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_pipeline_equals_its_parts(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ledger = quality_ledger.ledger(docs).where(quality_ledger.kept("prose-2")).select("doc_id")
    docs = docs.join(ledger, "doc_id", "left_semi")
    rows = [(r["doc_id"], r["text"]) for r in line_templates.drop_recurring(docs).collect() if r["n_dropped"] == 0 or r["text"].strip()]
    rows.sort()
    sets, stay = {}, []
    root = {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        sets[i], root[i] = set(ngram_jaccard.shingles(t).tolist()), i
        for j, _ in rows:
            if j == i:
                break
            a, b = sets[i], sets[j]
            if a and min(len(a), len(b)) * 4 >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    items = [w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (w := decontaminate.words_of(r["text"]))]
    for i, t in rows:
        words = b" " + b" ".join(decontaminate.words_of(t)) + b" "
        if find(i) == i and not any(b" " + b" ".join(w) + b" " in words for w in items):
            stay.append((i, t))
    tok = Tokenizer.from_file(WORD_BPE)
    expected = {i: tok.encode(t, add_special_tokens=False).ids for i, t in stay}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == expected


def test_stages_keep_columns_and_take_odd_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "encoding"]
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "word " * 60, "en", "s", 300), (3, " ".join(f"w{i}" for i in range(200)), "en", "s", 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            if name != "encoding":
                assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.collect()
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert [r["doc_id"] for r in kept.collect()] == [3]


def test_stages_pass_texts_in_small_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(6).cast("long").alias("n_chars"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    try:
        for name, stage in corpus_pipeline.STAGES:
            for given, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("300", 300)):
                spark.conf.set(conf, given)
                stage(spark, docs.limit(0), SF)
                seen = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
                assert sum(seen) == 2500 and max(seen) <= most, (name, given)
    finally:
        spark.conf.set(conf, before)
