"""Helpers shared by the operators: shared scratch tables, words, bounded caches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, later reads prune columns.

    The shuffle files of the write go when it ends; else they stay until the driver happens to collect its garbage."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_udf(fn: Callable[[list], list | pa.Array], returns: str, rows: int = 256):
    """Arrow function over one column: fn gets at most `rows` values as a Python list and gives as many results, as a list or an Arrow array.

    A batch is worked through in such slices, so that its results are Python objects a few at a time only.

    Marked non-deterministic, so that a filter on the result is not
    pushed below it and the work done twice.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(returns))

    def run(col: pa.Array) -> pa.Array:
        results = (fn(col.slice(lo, rows).to_pylist()) for lo in range(0, len(col), rows))
        parts = [r.cast(arrow) if isinstance(r, pa.Array) else pa.array(r, type=arrow) for r in results]
        return pa.concat_arrays(parts) if parts else pa.array([], type=arrow)

    return F.arrow_udf(run, returns).asNondeterministic()


#: What the pre-tokenizer's \\s stands for, in runs so long that its pattern would exhaust the stack.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode_text(enc, text: str) -> list[int]:
    """enc.encode_ordinary(text) for texts with white space of any length.

    The pattern takes a run of white space whole at the end of a text, and else but for its
    last character, which may belong to the word behind it.  Such a piece of a very long run is
    encoded as the piece it is, and the texts around it apart: the ids are the same.
    """
    ids, at = [], 0
    for m in _LONG_SPACE.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc.encode_ordinary(text[at:m.start()])
        ids += enc._encode_single_piece(text[m.start():end])
        at = end
    return ids + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def with_struct(df: DataFrame, result: Column, keep: list[str]) -> DataFrame:
    """`keep` columns and the fields of a struct result; other columns of df cannot clash with them."""
    tmp = f"_r_{uuid.uuid4().hex[:8]}"
    return df.select(*[df[c] for c in keep], result.alias(tmp)).select(*keep, f"{tmp}.*")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class TwoGenerationCache:
    """A dictionary of at most 2 * size entries; the older half goes when the newer is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        v = self.new.get(key)
        if v is None:
            v = self.old.get(key)
            if v is not None:
                self.put(key, v)
        return v

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which both sides are dealt anew, by the keys and a checksum of them.

    A side that was just grouped by the keys would else keep its partitions, and a
    frequent key could not be split by the adaptive skew join.
    """
    k = f"_k_{uuid.uuid4().hex[:8]}"
    add = lambda df: df.withColumn(k, F.crc32(F.concat_ws("|", *[F.col(c).cast("string") for c in on])))
    return add(left).join(add(right), [*on, k], how).drop(k)


BLOOM_BITS = 1 << 23


class IdFilter:
    """Bloom filter of fixed size (1 MB of bits): says of an id that it may be among those given, or is not.

    Only saves shuffling rows that cannot match; the join behind it decides.  The bits are a
    table of at most BLOOM_BITS / 64 rows, which is joined by broadcast: rows are
    tested where they are, without leaving the JVM.
    """

    def __init__(self, ids: DataFrame, column: str):
        bit = F.pmod(F.xxhash64(column), F.lit(BLOOM_BITS))
        one = F.expr("shiftleft(1L, cast(_bit & 63 as int))")
        self.words = ids.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).alias("w"), one.alias("b")) \
            .groupBy("w").agg(F.bit_or("b").alias("b"))

    def marked(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """df with a boolean column `out`: the value may be among the ids."""
        w, b = (f"_{x}_{uuid.uuid4().hex[:8]}" for x in "wb")
        bit = F.pmod(F.xxhash64(df[column]), F.lit(BLOOM_BITS))
        words = F.broadcast(self.words.select(F.col("w").alias(w), F.col("b").alias(b)))
        joined = df.join(words, F.shiftright(bit, 6) == F.col(w), "left")
        held = F.getbit(F.col(b), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        return joined.select(*[df[c] for c in df.columns], F.coalesce(held, F.lit(False)).alias(out))
