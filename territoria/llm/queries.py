"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.llm import (bpe_automaton, chat_format, decontaminate, line_templates, merkle_manifest, ngram_jaccard,
                            quality_crf, quality_ledger, simhash_segments, token_attribution, toxicity, warc, whitening)
from territoria.llm.common import scratch_path, table, written

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines."""
    return line_templates.drop_recurring(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a WARC archive, read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return ngram_jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they hold."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "item_id", F.round("score", 6).alias("score"), F.round("question_overlap", 6).alias("question_overlap"),
                F.round("answer_overlap", 6).alias("answer_overlap"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe_automaton.encode_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_attribution.line_token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger row and verdict of every document."""
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    base = F.col("failure_bits").bitwiseAND(F.lit(quality_ledger.mask_of(quality_ledger.POLICIES["base-1"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
                       quality_ledger.kept("prose-2").alias("kept"), "failure_bits")


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one that holds control strings, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = written(chat_format.assemble(turns, BYTE_BPE, public_tokenizers.PATTERN), "chat")
    return chat_format.read_back(formatted, BYTE_BPE, public_tokenizers.PATTERN)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether the document as found still folds to the root."""
    rows = merkle_manifest.manifest(table(spark, sf_dir, "documents")) \
        .withColumn("proof", merkle_manifest.path_digest(F.col("path"))).withColumn("fold", merkle_manifest.folded(F.col("observed"), F.col("path")))
    digests = {name: F.lower(F.hex(column)) for name, column in
               (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof_sha256", "proof"), ("folded_root", "fold"))}
    return rows.select("doc_id", *[c.alias(name) for name, c in digests.items()], (F.col("fold") == F.col("root")).alias("verified"))


def op12_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash_segments.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


_WORDS = r"[^\x20\x09-\x0D]+"
_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

SQL_OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr({_BASE32},
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM r"""

SQL_OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = d.doc_id"""

SQL_OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, w, i FROM (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(t, '{_WORDS}') AS ws FROM d))),
g AS (SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
r AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT rid, i FROM h UNION SELECT rid, i + 1 FROM h UNION SELECT rid, i + 2 FROM h) GROUP BY rid),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
m AS (SELECT doc_id, len(regexp_extract_all(t, '{_WORDS}'))::BIGINT AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^A-Za-z]+', '', 'g'))::BIGINT AS n_letters
  FROM d JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {rule} THEN {1 << i} ELSE 0 END' for i, rule in enumerate(quality_ledger.RULES.values()))})::BIGINT AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & {quality_ledger.mask_of(quality_ledger.POLICIES['base-1'])}) <> 0 AS base_failed,
  (failure_bits & {quality_ledger.mask_of(quality_ledger.POLICIES['prose-2'])}) = 0 AS kept, failure_bits
FROM b"""

SQL_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, 'CONTROL', '\1\\\2\3', 'g') AS x, regexp_replace(role, 'CONTROL', '\1\\\2\3', 'g') AS y FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(x) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 20 + length(y) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""".replace("CONTROL", chat_format._CONTROL)

_FIELD = "coalesce(strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL_OP11 = f"""
WITH RECURSIVE bits AS (SELECT i AS b, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
tab AS (SELECT list(v ORDER BY b) AS v FROM bits),
d AS (SELECT doc_id, coalesce('v' || source, '') AS tree, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
  sha256({_HEAD} || {_FIELD.format("replace(text, chr(10), '')")}) AS touched,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda ch: ascii(ch)::BIGINT)),
    lambda c, x: xor(c >> 8, tab.v[xor(c & 255, x) + 1])), 4294967295) % 2 = 0 AS tampered FROM documents, tab),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL SELECT tree, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY tree, level, i // 3, n),
s AS (SELECT tree, h, level AS top, row_number() OVER (ORDER BY tree::BLOB) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, i, h, n FROM s
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (SELECT l.tree, l.i, k.level, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i < l.i // power(3, k.level)::BIGINT), '') || '|'
    || coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i > l.i // power(3, k.level)::BIGINT), '') AS step
  FROM l JOIN t k ON k.tree = l.tree AND k.n > 1 AND k.i // 3 = l.i // power(3, k.level + 1)::BIGINT GROUP BY l.tree, l.i, k.level),
above AS (SELECT s.tree, k.level, coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i < s.i // power(3, k.level)::BIGINT), '') || '|'
    || coalesce(string_agg(k.h, '' ORDER BY k.i) FILTER (WHERE k.i > s.i // power(3, k.level)::BIGINT), '') AS step
  FROM s JOIN u k ON k.n > 1 AND k.i // 3 = s.i // power(3, k.level + 1)::BIGINT GROUP BY s.tree, k.level),
low AS (SELECT tree, i, list(step ORDER BY level) AS steps FROM steps GROUP BY tree, i),
high AS (SELECT tree, list(step ORDER BY level) AS steps FROM above GROUP BY tree),
e AS (SELECT l.*, s.h AS subroot, r.h AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM l JOIN s ON s.tree = l.tree JOIN (SELECT h FROM u WHERE n = 1) r ON true LEFT JOIN low ON low.tree = l.tree AND low.i = l.i LEFT JOIN high ON high.tree = l.tree),
f AS (SELECT *, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
  list_reduce(list_concat([CASE WHEN tampered THEN touched ELSE leaf END], steps), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root FROM e)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""

QUERIES = {f.__name__: f for f in (op1_line_templates, op2_warc_archive, op3_ngram_jaccard, op4_decontamination, op5_bpe_automaton, op6_toxicity,
                                   op7_token_attribution, op8_quality_ledger, op9_quality_crf, op10_chat_format,
                                   op11_merkle_manifest, op12_simhash_segments, op13_whitening)}
#: The other operators are tested against brute force, the tokenizer's own library or held-out labels.
SQL = {"op2_warc_archive": SQL_OP2, "op3_ngram_jaccard": SQL_OP3, "op8_quality_ledger": SQL_OP8, "op10_chat_format": SQL_OP10, "op11_merkle_manifest": SQL_OP11}
