"""Merkle manifest of a dataset: a postorder log of hash trees, and proofs out of it.

Every row is a leaf; each value of ``tree_col`` has a tree of its own, and the
trees' roots are the leaves of one more tree.  Builders own aligned stretches of
``2**bits`` leaves and append their nodes to a log in the order in which they are
completed, which is postorder; the roots of the stretches are the leaves of the
next round's builders.  A segment of the log is one row that holds fixed-width
digests, and where a node stands in it follows from the sizes of the subtrees
before it, so siblings are read by position when proofs are extracted.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify, unhexlify
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32
_SEGMENT = "tree string, block long, height int, leaves int, digests binary, root binary"


# ---------------------------------------------------------------- hashes and positions
def node_hash(*digests: bytes) -> bytes:
    """Hex SHA-256 of hex digests, one after the other."""
    return hexlify(hashlib.sha256(b"".join(digests)).digest())


def cell(c: Column) -> Column:
    """A value as a leaf hashes it: its UTF-8 length, a colon and itself; ``-`` for null."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(values: Iterable[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(cell, values)), 256))


def subtree_size(leaves: int, height: int) -> int:
    """Nodes of a subtree of that height over so many leaves; an incomplete last run is a node too."""
    return sum(-(-leaves // (1 << k)) for k in range(height + 1))


def position(level: int, index: int, leaves: int) -> int:
    """Where a node stands in the postorder log of a tree over ``leaves`` leaves.

    Before it stand all nodes that ended within the leaves to its left, which
    is twice their number less the set bits of that number, then its own subtree.
    """
    left = index << level
    return 2 * left - left.bit_count() + subtree_size(min(1 << level, leaves - left), level) - 1


def postorder(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes of a tree over ``leaves``, each appended when it is complete."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (height + 1)

    def complete(level: int, node: bytes) -> None:
        log.append(node)
        while level < height:
            left, waiting[level] = waiting[level], None
            if left is None:
                waiting[level] = node
                return
            level, node = level + 1, node_hash(left, node)
            log.append(node)

    for leaf in leaves:
        complete(0, leaf)
    for level in range(height):
        if waiting[level] is not None:
            alone, waiting[level] = waiting[level], None
            complete(level + 1, node_hash(alone))
    return log


def sibling_paths(digests: bytes, leaves: int, height: int, above: str) -> list[str]:
    """Per leaf of a segment: its siblings up to the segment's root, then ``above``.

    A level is ``<`` or ``>`` with the hex digest of the sibling to the left or
    right, or ``.`` where a node has none.
    """
    paths = [above]
    for level in range(height - 1, -1, -1):
        n = -(-leaves // (1 << level))
        here = []
        for index in range(n):
            other, mark = index ^ 1, ".<>"[0 if index ^ 1 >= n else 1 + (index & 1 ^ 1)]
            if other < n:
                at = _DIGEST * position(level, other, leaves)
                mark += digests[at : at + _DIGEST].hex()
            here.append(mark + paths[index >> 1])
        paths = here
    return paths


def steps(path: str) -> list[tuple[str, bytes]]:
    """A path as (side, sibling) per level."""
    out, at = [], 0
    while at < len(path):
        width = 0 if path[at] == "." else 2 * _DIGEST
        out.append((path[at], path[at + 1 : at + 1 + width].encode()))
        at += 1 + width
    return out


def fold(leaf: bytes, path: list[tuple[str, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for side, sibling in path:
        leaf = node_hash(leaf) if side == "." else node_hash(sibling, leaf) if side == "<" else node_hash(leaf, sibling)
    return leaf


# ---------------------------------------------------------------- the log
def ranked(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves(tree, ...)`` with ``rank`` in the tree by ``order`` and the tree's ``height``, and ``trees(tree, n, height)``.

    Rows are range-sorted once; a row's rank is its place in its range and what
    the tree has in the ranges before, so a tree with any share of the rows is
    spread over many tasks.  ``order`` must tell rows apart.
    """
    n = partitions(leaves.sparkSession)
    placed = leaves.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("tree", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("here"))
    height = F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(F.lit(0)).cast("int")
    trees = written(parts.groupBy("tree").agg(F.sum("here").alias("n")).withColumn("height", height), "trees")
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per range that the tree reaches
    offsets = parts.withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first"))
    rows = placed.join(offsets.select("tree", "part", "offset"), ["tree", "part"]).join(trees.select("tree", "height"), "tree")
    return rows.withColumn("rank", F.col("place") + F.col("offset")).drop("place", "part", "offset"), trees


def build_segments(nodes: DataFrame, bits: int, below: int) -> DataFrame:
    """One round: ``nodes(tree, rank, height, digest)``, those of level ``below``, become a segment per aligned stretch."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        height = int(min(bits, pdf["height"].iloc[0] - below))
        log = postorder([hexlify(d) for d in pdf["digest"]], height)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "block": [pdf["rank"].iloc[0] >> bits], "height": [height], "leaves": [len(pdf)], "digests": [unhexlify(b"".join(log))], "root": [unhexlify(log[-1])]})

    rows = nodes.select("tree", "rank", "height", "digest", F.shiftright("rank", bits).alias("block"))
    return rows.groupBy("tree", "block").applyInPandas(build, _SEGMENT)


def build_log(leaves: DataFrame, trees: DataFrame, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The log's segments, one table per round, and ``roots(tree, digest)``: a tree's root is that of the one segment of its last round."""
    tallest = trees.agg(F.max("height")).first()[0] or 0
    nodes, rounds, roots, below = leaves.select("tree", "rank", "height", F.col("leaf").alias("digest")), [], None, 0
    while True:
        log = written(build_segments(nodes, bits, below), "log")
        rounds.append(log)
        up = log.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest")).join(trees.select("tree", "height"), "tree")
        below += bits
        ended = up.where((F.col("height") <= below) & (F.col("height") > below - bits) | (F.col("height") == 0) & F.lit(below == bits)).select("tree", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
        if below >= tallest:
            return rounds, roots
        nodes = up.where(F.col("height") > below)


def paths_above(rounds: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """(tree, block, path, root) of every segment of the first round: the siblings from its root upwards, and the root above all.

    ``tops(tree, path, root)`` holds what stands above each tree.  The rounds are
    read downwards, a row per segment.
    """

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.tree, (r.block << bits) + k, p, r.root) for r in pdf.itertuples() for k, p in enumerate(sibling_paths(r.digests, r.leaves, r.height, r.path))]
        return pd.DataFrame(rows, columns=["tree", "block", "path", "root"])

    known = None
    for log in reversed(rounds):
        ends = log.select("tree", "block") if known is None else log.select("tree", "block").join(known, ["tree", "block"], "left_anti")
        above = ends.join(tops, "tree").select("tree", "block", "path", "root")
        above = above if known is None else above.unionByName(known)
        if log is rounds[0]:
            return above
        held = log.select("tree", "block", "height", "leaves", "digests").join(above, ["tree", "block"])
        known = written(held.groupBy("tree", "block").applyInPandas(down, "tree string, block long, path string, root binary"), "above")


@dataclass
class Manifest:
    """``leaves(tree, rank, doc_id, leaf, claim)``, the log's rounds, ``subroots(tree, digest)``, their tree and ``root`` (hex; None for no rows)."""

    leaves: DataFrame
    rounds: list[DataFrame]
    subroots: DataFrame
    upper_leaves: DataFrame
    upper_rounds: list[DataFrame]
    root: str | None
    bits: int


def build_manifest(docs: DataFrame, *, columns: tuple[str, ...] = COLUMNS, tree_col: str = "lang", id_col: str = "doc_id", claim: Column | None = None, bits: int = 8) -> Manifest:
    """The log of ``docs``: a tree per value of ``tree_col`` (null first, then by bytes), leaves by id (null first).

    Rows that share an id are ordered by leaf, equal rows are leaves of their
    own.  Only digests are moved, never texts.  ``claim`` is the leaf (binary) that somebody
    claims for a row, null where it is the row's own; it is kept beside the
    leaf, for ``verify``.  An empty table gives an empty log without a root.
    """
    thin = docs.select(
        F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string"))).alias("tree"),
        F.col(id_col).alias("doc_id"),
        leaf_hash(F.col(c) for c in columns).alias("leaf"),
        (F.lit(None).cast("binary") if claim is None else claim).alias("claim"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves, trees = ranked(written(thin, "leaves"), ["doc_id", "leaf", "row"])
    leaves = written(leaves.select("tree", "rank", "height", "doc_id", "leaf", "claim"), "ranked")
    rounds, subroots = build_log(leaves, trees, bits)
    subroots = written(subroots, "subroots")
    upper, whole = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")), ["name"])
    upper = written(upper, "upper")
    upper_rounds, root = build_log(upper, whole, bits)
    found = root.first()
    return Manifest(leaves, rounds, subroots, upper, upper_rounds, found and bytes(found["digest"]).hex(), bits)


def verify(manifest: Manifest, *, with_proof: bool = False) -> DataFrame:
    """One row per leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (and ``proof``, the siblings, if asked for).

    Proofs are read out of the log by position, a segment at a time; folding
    starts at the claimed leaf where there is one, else at the leaf itself, and
    is verified where it ends at the root.
    """
    bits, doc_id = manifest.bits, manifest.leaves.schema["doc_id"].dataType
    one = F.lit(unhexlify(manifest.root or b"")).alias("root")
    above = paths_above(manifest.upper_rounds, manifest.upper_leaves.select("tree").distinct().select("tree", F.lit("").alias("path"), one), bits)
    tops = _leaf_paths(manifest.upper_leaves.select("tree", "rank", F.col("name").alias("key")), manifest.upper_rounds[0], above, bits)
    tops = written(tops.select(F.col("key").alias("tree"), "path", "root"), "tops")
    held = manifest.rounds[0].join(paths_above(manifest.rounds, tops, bits).withColumnRenamed("root", "top"), ["tree", "block"])
    held = held.join(manifest.subroots.select("tree", F.col("digest").alias("subroot")), "tree")
    rows = manifest.leaves.select("tree", "rank", F.shiftright("rank", bits).alias("block"), F.col("doc_id").cast("string"), "leaf", "claim")

    def check(mine: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s = segment.iloc[0]
        paths = sibling_paths(s["digests"], s["leaves"], s["height"], s["path"])
        root, out = s["top"].hex(), []
        for rank, key, leaf, claim in zip(mine["rank"], mine["doc_id"], mine["leaf"], mine["claim"]):
            path = steps(paths[rank & (1 << bits) - 1])
            proof = [h for _, h in path if h]
            folded = fold(hexlify(claim if isinstance(claim, bytes) else leaf), path).decode()
            out.append((key, leaf.hex(), s["subroot"].hex(), root, node_hash(*proof).decode(), folded, folded == root, *([[h.decode() for h in proof]] if with_proof else [])))
        return pd.DataFrame(out, columns=names)

    kinds = {"doc_id": "string", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    kinds |= {"proof": "array<string>"} if with_proof else {}
    names = list(kinds)
    out = rows.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(check, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return out.withColumn("doc_id", F.col("doc_id").cast(doc_id))


def _leaf_paths(leaves: DataFrame, log: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """(key, path, root) of ``leaves(tree, rank, key)``: the siblings of each leaf up to the root above all."""

    def read(mine: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        s = segment.iloc[0]
        paths = sibling_paths(s["digests"], s["leaves"], s["height"], s["path"])
        return pd.DataFrame({"key": mine["key"], "path": [paths[r & (1 << bits) - 1] for r in mine["rank"]], "root": [s["top"]] * len(mine)})

    held = log.join(above.withColumnRenamed("root", "top"), ["tree", "block"])
    rows = leaves.withColumn("block", F.shiftright("rank", bits))
    return rows.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInPandas(read, "key string, path string, root binary")


def tampered_leaf(columns: tuple[str, ...] = COLUMNS) -> Column:
    """The leaf with 1 added to n_chars where 7 divides the crc32 of the decimal doc_id; null elsewhere."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    return F.when(chosen, leaf_hash(more if c == "n_chars" else F.col(c) for c in columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verify(build_manifest(docs, claim=tampered_leaf()))


SQL = """
WITH RECURSIVE
bits AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS MATERIALIZED (
  SELECT doc_id, n_chars, '=' || lang AS tree,
    concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
      CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
      CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS a,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z,
    xor(list_reduce(string_split(doc_id::VARCHAR, ''), lambda c, x: xor(t[(xor(c, ascii(x)) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc
  FROM documents, bits),
h AS MATERIALIZED (
  SELECT doc_id, coalesce(tree, '') AS tree, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z) AS leaf,
    sha256(a || CASE WHEN n_chars IS NULL THEN '-' WHEN crc % 7 = 0 THEN strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z) AS claim
  FROM d),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM h),
low AS (
  SELECT tree, 0 AS level, i, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM l
  UNION ALL
  SELECT tree, level + 1, i >> 1, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) >> 1 FROM low WHERE n > 1 GROUP BY tree, level, i >> 1, n),
r AS MATERIALIZED (SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS i FROM low WHERE n = 1),
up AS (
  SELECT '' AS tree, 0 AS level, i, digest, count(*) OVER () AS n FROM r
  UNION ALL
  SELECT tree, level + 1, i >> 1, sha256(string_agg(digest, '' ORDER BY i)), (n + 1) >> 1 FROM up WHERE n > 1 GROUP BY tree, level, i >> 1, n),
top AS (SELECT digest AS root, level AS above FROM up WHERE n = 1),
node AS MATERIALIZED (SELECT 'l' || tree AS t, level, i, digest FROM low UNION ALL SELECT 'u', level, i, digest FROM up),
walk AS (
  SELECT l.tree, l.i AS leaf_i, 0 AS step, CASE WHEN r.height = 0 THEN r.i ELSE l.i END AS k, claim AS folded, '' AS proof, r.height, r.i AS top_i FROM l JOIN r USING (tree)
  UNION ALL
  SELECT w.tree, leaf_i, step + 1, CASE WHEN step + 1 = height THEN top_i ELSE k >> 1 END,
    sha256(CASE WHEN o.digest IS NULL THEN folded WHEN k % 2 = 1 THEN o.digest || folded ELSE folded || o.digest END),
    proof || coalesce(o.digest, ''), height, top_i
  FROM (SELECT *, CASE WHEN step < height THEN 'l' || tree ELSE 'u' END AS t, CASE WHEN step < height THEN step ELSE step - height END AS level FROM walk) w
  CROSS JOIN top LEFT JOIN node o ON o.t = w.t AND o.level = w.level AND o.i = xor(w.k, 1)
  WHERE step < height + above),
ends AS (SELECT w.* FROM walk w, top WHERE step = height + above)
SELECT l.doc_id, l.leaf, r.digest AS subroot, root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = root AS verified
FROM l JOIN r USING (tree) JOIN ends e ON e.tree = l.tree AND e.leaf_i = l.i CROSS JOIN top
"""
