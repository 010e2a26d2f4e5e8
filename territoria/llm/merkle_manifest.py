"""Merkle manifest of a dataset: a postorder append log and proofs read from it.

A tree stands over the ordered leaves of a group; every ARITY consecutive nodes (the last
run may be shorter, even one) become the SHA-256 of their hex digests until one is left.

1. Leaves get their place in the group by a distributed rank, so that a group with a third
   of all rows is spread as well.
2. Aligned builders: a task takes ARITY ** depth leaves (a span) that start at a multiple of
   that number and appends every node as it is complete, children before their parent.  That is a
   segment of the log in postorder.  The roots of the segments are the leaves of the next
   round, until every group has one segment; each round has a span-th of the rows.
3. Proofs: the place of a node (level, index) in postorder is the number of nodes complete
   before it, a closed form of the subtree sizes (`position`).  A leaf's siblings are read
   from its segment at these places; the path above a segment is the proof of its root in
   the next round, so it is worked out once a segment and not once a leaf.

Defined cases: null fields are `-`; leaves ascend by id, a null id first, and rows that
share an id by their digest (equal rows have the same proof up to their places); an empty
table has no rows and no root; a group of one leaf has that leaf as its root; texts of any
length are hashed whole; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import text_udf, written
from territoria.operators.windows import ranked

ARITY = 3
DEPTH = 6

PATH = "array<struct<at: int, siblings: array<binary>>>"
_PATH = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.binary()))]))
_NODE = "tree string, block long, n long, pos long, level int, hash binary, id long, extra binary"
_NODE_SCHEMA = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("level", pa.int32()),
                          ("hash", pa.binary()), ("id", pa.int64()), ("extra", pa.binary())])
_PROOF = f"tree string, i long, hash binary, id long, extra binary, path {PATH}, subroot binary, root binary"
_PROOF_SCHEMA = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("hash", pa.binary()), ("id", pa.int64()), ("extra", pa.binary()),
                           ("path", _PATH), ("subroot", pa.binary()), ("root", pa.binary())])


def field(value: Column) -> Column:
    """`-` for null, else byte count, `:` and the value in UTF-8."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def height_of(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h, width = 0, n
    while width > 1:
        width = -(-width // ARITY)
        h += 1
    return h


def position(level: int, index: int, n: int, height: int) -> int:
    """Place in postorder, from 0, of a node of a tree over n leaves.

    Complete before it are, at its own level and below, all nodes over the leaves up to its
    last one; above, the nodes that end before its first leaf.
    """
    end = min((index + 1) * ARITY ** level, n)
    below = sum(-(-end // ARITY ** t) for t in range(level + 1))
    return below + sum(index // ARITY ** (t - level) for t in range(level + 1, height + 1)) - 1


def append_log(leaves: list[bytes], height: int) -> list[tuple[int, bytes]]:
    """(level, digest) of every node in the order in which nodes are complete."""
    log: list[tuple[int, bytes]] = []
    open_runs: list[list[bytes]] = [[] for _ in range(height + 1)]

    def complete(level: int, digest: bytes) -> None:
        log.append((level, digest))
        if level < height:
            open_runs[level].append(digest)
            if len(open_runs[level]) == ARITY:
                close(level)

    def close(level: int) -> None:
        run, open_runs[level] = open_runs[level], []
        complete(level + 1, parent(run))

    for leaf in leaves:
        complete(0, leaf)
    for level in range(height):
        if open_runs[level]:
            close(level)
    return log


@lru_cache(maxsize=64)
def _places(n: int, height: int) -> list[list[int]]:
    """Places of the nodes of each level of a segment."""
    return [[position(level, k, n, height) for k in range(-(-n // ARITY ** level))] for level in range(height + 1)]


def path_of(log: list[bytes], index: int, n: int, height: int) -> list[dict]:
    """The other nodes of each run from a leaf up, and where the leaf's own ancestor stands among them."""
    places, path = _places(n, height), []
    for level in range(height):
        at = index % ARITY
        first = index - at
        path.append({"at": at, "siblings": [log[p] for p in places[level][first:first + at] + places[level][index + 1:first + ARITY]]})
        index //= ARITY
    return path


def fold_path(digest: bytes, path: list[dict]) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    for step in path:
        run = list(step["siblings"])
        run.insert(step["at"], digest)
        digest = parent(run)
    return digest


def _segments(batches, rows: int = 1024):
    """Rows of one (tree, block) at a time; the input is sorted by them."""
    key, own = None, []
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            for r in batch.slice(lo, rows).to_pylist():
                if (r["tree"], r["block"]) != key:
                    if own:
                        yield own
                    key, own = (r["tree"], r["block"]), []
                own.append(r)
    if own:
        yield own


def _in_parts(rows, schema: pa.Schema, size: int = 4000):
    part: list[dict] = []
    for r in rows:
        part.append(r)
        if len(part) >= size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def _builder(depth: int):
    def nodes(batches):
        for leaves in _segments(batches):
            first = leaves[0]
            height = height_of(len(leaves)) if first["n"] <= ARITY ** depth else depth
            base = {"tree": first["tree"], "block": first["block"], "n": first["n"]}
            source = iter(leaves)
            for pos, (level, digest) in enumerate(append_log([r["hash"] for r in leaves], height)):
                leaf = next(source) if level == 0 else {}
                yield base | {"pos": pos, "level": level, "hash": digest, "id": leaf.get("id"), "extra": leaf.get("extra")}

    return lambda batches: _in_parts(nodes(batches), _NODE_SCHEMA)


def _extractor(depth: int):
    def rows(batches):
        for seg in _segments(batches):
            above, log = seg[0], seg[1:]
            if above["pos"] >= 0:
                raise ValueError("segment without the path above it")
            digests, leaves = [r["hash"] for r in log], [r for r in log if r["level"] == 0]
            height = log[-1]["level"]
            for k, r in enumerate(leaves):
                yield {"tree": r["tree"], "i": r["block"] * ARITY ** depth + k, "hash": r["hash"], "id": r["id"], "extra": r["extra"],
                       "path": path_of(digests, k, len(leaves), height) + above["path"], "subroot": above["subroot"], "root": above["root"]}

    return lambda batches: _in_parts(rows(batches), _PROOF_SCHEMA)


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with their place in the tree (i, from 0) and its number of leaves (n)."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return ranked(leaves, ["tree"], order, out="i").withColumn("i", F.col("i") - 1).join(sizes, "tree")


def build_log(leaves: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """Rounds of the log for leaves (tree, i, n, hash, id, extra): tree, block, n, pos, level, hash, id, extra.

    n counts the leaves of the tree in that round, pos is the place in the segment's postorder.
    """
    rounds, span = [], ARITY ** depth
    while True:
        dealt = leaves.withColumn("block", F.floor(F.col("i") / span)).repartition("tree", "block").sortWithinPartitions("tree", "block", "i")
        log = written(dealt.select("tree", "block", "n", "i", "hash", "id", "extra").mapInArrow(_builder(depth), _NODE), "merkle")
        rounds.append(log)
        leaves = log.where((F.col("level") == depth) & (F.col("n") > span)) \
            .select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / span).alias("n"), "hash",
                    F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("extra"))
        if leaves.isEmpty():
            return rounds


def tree_roots(rounds: list[DataFrame], depth: int = DEPTH) -> DataFrame:
    """tree, subroot: the last node of each tree's last segment."""
    ends = [r.where(F.col("n") <= ARITY ** depth).groupBy("tree").agg(F.max_by("hash", "pos").alias("subroot")) for r in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def extract(rounds: list[DataFrame], above: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proofs of all leaves of the first round; above: tree, path, subroot, root of every tree."""
    known = None
    for log in reversed(rounds):
        ended = log.where((F.col("n") <= ARITY ** depth) & (F.col("pos") == 0)).select("tree", "block").join(above, "tree")
        tops = ended if known is None else ended.unionByName(known)
        heads = tops.select("tree", "block", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("binary").alias("hash"),
                            F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("extra"), "path", "subroot", "root")
        nodes = log.drop("n").withColumns({"path": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("binary"), "root": F.lit(None).cast("binary")})
        found = nodes.unionByName(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(_extractor(depth), _PROOF)
        if log is not rounds[0]:
            known = found.select("tree", F.col("i").alias("block"), "path", "subroot", "root")
    return found


def proofs(leaves: DataFrame, depth: int = DEPTH) -> DataFrame:
    """tree, hash, id, extra of every leaf with its path, the root of its tree and the root of all.

    leaves: tree (string, not null), id, hash, extra (carried along).  The roots of the trees, in
    order of their names, are the leaves of one more tree, built in the same way.
    """
    kept = written(leaves.select("tree", "id", "hash", "extra"), "leaves")
    rounds = build_log(placed(kept, ["id", "hash"]), depth)
    names = tree_roots(rounds, depth).select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("id"), F.col("subroot").alias("hash"),
                                      F.encode("tree", "UTF-8").alias("extra"))
    upper = build_log(placed(names, ["extra"]), depth)
    top = tree_roots(upper, depth).select("tree", F.array().cast(PATH).alias("path"), "subroot", F.col("subroot").alias("root"))
    above = extract(upper, top, depth).select(F.decode("extra", "UTF-8").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
    return extract(rounds, written(above, "above"), depth)


def folded(digest: Column, path: Column) -> Column:
    """Root worked out anew from a leaf's digest and its path."""
    def run(rows: list) -> list:
        return [fold_path(r["d"], r["p"]) for r in rows]

    return text_udf(run, "binary")(F.struct(digest.alias("d"), path.alias("p")))


def path_digest(path: Column) -> Column:
    """SHA-256 of the hex digests of all siblings, level by level, left to right."""
    def run(paths: list) -> list:
        return [parent([s for step in p for s in step["siblings"]]) for p in paths]

    return text_udf(run, "binary")(path)


def group_key(source: Column) -> Column:
    """A name for a group, null first, then by the bytes of the value."""
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit(""))


def document_leaf(text: Column) -> Column:
    return leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, path and observed of every document.

    observed is the leaf of the text as it would be found after tampering: where 2 divides
    the crc32 of the decimal doc_id, without line feeds; else the leaf itself.
    """
    text = F.col("text")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))
    leaf = docs.select(group_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("id"), document_leaf(text).alias("hash"),
                       F.when(changed, document_leaf(F.translate(text, "\n", ""))).alias("extra"))
    out = proofs(leaf, depth)
    return out.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", "path", F.coalesce("extra", "hash").alias("observed"))
