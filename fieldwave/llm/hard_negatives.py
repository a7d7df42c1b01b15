"""Hard-negative mining by exact integer scores.

Components become integers, so a score is an exact inner product.  Groups of
anchors of bounded size are sent to all tasks, one group after the other; every
task multiplies tiles of anchors and candidates by Strassen's recursion and keeps
a small heap per anchor.  Heaps merge: those of a task over its batches, those of
all tasks by rank in Spark.  A first pass gives each anchor its positives, a second
one, for each positive, the best negatives in the window of scores below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import partitions, written

_SCALE = 256
_TILE = 1024  # anchors and candidates that are multiplied at once
_NONE = np.iinfo(np.int64).max  # the key of an empty place in a heap


# ---------------------------------------------------------------- products
def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int64 matrices, in floating point where every partial sum stays below 2^53."""
    top = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (a, b)]
    if top[0] * top[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """Product of int64 matrices by Strassen's seven products; odd sides are padded with a zero.

    Integers wrap at 2^64 and the recursion only adds, subtracts and multiplies,
    so results that fit are exact whatever happens in between.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return product(a, b)
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


# ---------------------------------------------------------------- heaps
def empty_heaps(n: int, k: int) -> np.ndarray:
    """``n`` heaps of ``k`` places; a place is (minus score, no id, id, row), ascending."""
    return np.full((n, k, 4), _NONE, np.int64)


def merge_heaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best places of two heaps each, as many as ``a`` has."""
    both = np.concatenate([a, b], axis=1)
    order = np.lexsort([both[..., c] for c in (3, 2, 1, 0)], axis=-1)[:, : a.shape[1]]
    return np.take_along_axis(both, order[..., None], axis=1)


def best_of(scores: np.ndarray, allowed: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Heaps of the ``k`` highest allowed scores per row; columns come in the order that breaks ties."""
    left, at = np.where(allowed, -scores, _NONE), np.arange(len(scores))
    out = empty_heaps(len(scores), k)
    for place in range(min(k, scores.shape[1])):
        j = left.argmin(axis=1)
        least = left[at, j]
        found = least < _NONE
        if not found.any():
            break
        out[found, place, 0], out[found, place, 1:] = least[found], names[j[found]]
        left[at, j] = _NONE
    return out


# ---------------------------------------------------------------- passes over all candidates
def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros to ``dims``."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Vectors:
    """Rows of a batch: matrix, label and names (no id, id, row), in the order that breaks ties."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, dims: int):
        cols = {n: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for n, c in zip(batch.schema.names, batch.columns)}
        ids = cols["vec_id"]
        names = np.stack([ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), cols["row"].to_numpy()], axis=1).astype(np.int64)
        order = np.lexsort(names.T[::-1])
        self.names, self.label, self.matrix = names[order], cols["label"].to_numpy()[order], _matrix(cols["q"], dims)[order]

    def __len__(self) -> int:
        return len(self.label)

    def tiles(self, size: int = _TILE) -> Iterator[slice]:
        return (slice(i, min(i + size, len(self))) for i in range(0, len(self), size))


def positives_in(anchors: Vectors, found: Vectors, k: int) -> np.ndarray:
    """Heaps of each anchor's best other rows of its label among ``found``; only tiles of one label are multiplied."""
    out = empty_heaps(len(anchors), k)
    for label in np.intersect1d(anchors.label, found.label):
        mine, theirs = np.flatnonzero(anchors.label == label), np.flatnonzero(found.label == label)
        for i in range(0, len(mine), _TILE):
            a = mine[i : i + _TILE]
            for j in range(0, len(theirs), _TILE):
                c = theirs[j : j + _TILE]
                other = anchors.names[a, 2][:, None] != found.names[c, 2]
                out[a] = merge_heaps(out[a], best_of(strassen(anchors.matrix[a], found.matrix[c].T), other, found.names[c], k))
    return out


def negatives_in(anchors: Vectors, positives: np.ndarray, found: Vectors, heaps: np.ndarray) -> None:
    """Updates ``heaps`` (anchor, positive, place, 4) with rows of other labels in the window below each positive's score."""
    score = np.where(positives[..., 0] == _NONE, -1, -positives[..., 0])  # nothing fits below a negative score
    low, high = -(-score // 2), score // 20 * 19 + score % 20 * 19 // 20
    for a in anchors.tiles():
        for c in found.tiles():
            scores = strassen(anchors.matrix[a], found.matrix[c].T)
            differ = anchors.label[a, None] != found.label[c]
            for p in range(score.shape[1]):
                worst = heaps[a, p, -1, 0]
                least = np.where(worst == _NONE, low[a, p], np.maximum(low[a, p], -worst))
                fits = differ & (scores >= least[:, None]) & (scores <= high[a, p, None])
                some = np.flatnonzero(fits.any(axis=1))
                if len(some):
                    heaps[a.start + some, p] = merge_heaps(heaps[a.start + some, p], best_of(scores[some], fits[some], found.names[c], heaps.shape[2]))


def _places(heaps: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Index of each filled place, and its score, id and row."""
    at = np.argwhere(heaps[..., 0] != _NONE)
    got = heaps[tuple(at.T)]
    return at, [pa.array(-got[:, 0]), pa.array(got[:, 2], mask=got[:, 1] == 1), pa.array(got[:, 3])]


def _ranked(partial: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The tasks' heaps merged: the first ``k`` of each key, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def find_positives(vectors: DataFrame, group, dims: int, k: int) -> DataFrame:
    """(anchor_row, score, id, row, rank): the first ``k`` other rows of each anchor's label."""

    def scan(batches):
        anchors = group.value
        heaps = empty_heaps(len(anchors), k)
        for batch in batches:
            if batch.num_rows:
                heaps = merge_heaps(heaps, positives_in(anchors, Vectors(batch, dims), k))
        at, cols = _places(heaps)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.names[at[:, 0], 2]), *cols], ["anchor_row", "score", "id", "row"])

    return _ranked(vectors.mapInArrow(scan, "anchor_row long, score long, id long, row long"), ["anchor_row"], k)


def find_negatives(vectors: DataFrame, group, dims: int, k: int) -> DataFrame:
    """(anchor_row, place, score, id, row, rank): the first ``k`` rows in the window below each of an anchor's positives."""

    def scan(batches):
        anchors, positives = group.value
        heaps = empty_heaps(positives.shape[0] * positives.shape[1], k).reshape(*positives.shape[:2], k, 4)
        for batch in batches:
            if batch.num_rows:
                negatives_in(anchors, positives, Vectors(batch, dims), heaps)
        at, cols = _places(heaps)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.names[at[:, 0], 2]), pa.array(at[:, 1].astype(np.int32)), *cols], ["anchor_row", "place", "score", "id", "row"])

    return _ranked(vectors.mapInArrow(scan, "anchor_row long, place int, score long, id long, row long"), ["anchor_row", "place"], k)


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, q): the rows that take part, as integers.

    Rows with a null label or vector, a null or non-finite component, or a
    squared length (of the integers) of 2^62 or more take no part: below that,
    every score fits a long.
    """
    x = F.col("embedding").cast("array<double>")
    usable = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(
        F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 23)))  # longer ones reach 2^62 alone
    )
    q = usable.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform(x, lambda v: F.floor(v * _SCALE)).alias("q"))
    fits = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) < float(1 << 62)
    return q.where(fits).withColumn("row", F.monotonically_increasing_id())


def mine_hard_negatives(vectors: DataFrame, *, every: int = 50, n_positives: int = 5, n_negatives: int = 3, group_bytes: int = 16 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors(vec_id, label, q)``.

    Anchors are the rows whose vec_id is divisible by ``every``.  An anchor's
    positives are the first other rows of its label; for each, negatives are
    rows of other labels with 0.5 to 0.95 of the positive's score.  Higher
    scores come first, ties by smaller vec_id, null last; a row without a
    vec_id is no anchor; rows that repeat a vec_id are rows of their own.
    Shorter vectors count as padded with zeros.  An empty table gives no rows.

    Anchors are sent out in groups of about ``group_bytes`` (by hash of their
    row), one group at a time; a group's positives, at most ``n_positives`` per
    anchor, go to the tasks with it.  All candidates meet every group; their
    number only changes the number of tasks.
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "q"), "vectors")
    anchors = vectors.where(F.col("vec_id") % every == 0)
    n, dims = vectors.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    dims = max(dims or 0, 1)
    n_groups = max(1, math.ceil(anchors.count() * dims * 8 / group_bytes))
    tasks = max(partitions(spark), -(-n // (64 * _TILE)))
    spread = vectors if vectors.rdd.getNumPartitions() >= tasks else vectors.repartition(tasks, "row")
    out = None
    for g in range(n_groups):
        group = Vectors(anchors.where(F.pmod(F.xxhash64("row"), F.lit(n_groups)) == g).toArrow(), dims)
        sent = spark.sparkContext.broadcast(group)
        firsts = find_positives(spread, sent, dims, n_positives).toArrow().to_pandas(integer_object_nulls=True)
        sent.destroy()
        positives = empty_heaps(len(group), n_positives)
        order = np.argsort(group.names[:, 2])
        for r in firsts.itertuples():
            at = order[np.searchsorted(group.names[:, 2], r.anchor_row, sorter=order)]
            positives[at, r.rank - 1] = -r.score, r.id is None, r.id or 0, r.row
        sent = spark.sparkContext.broadcast((group, positives))
        found = written(find_negatives(spread, sent, dims, n_negatives), "negatives")
        sent.destroy()
        at, cols = _places(positives)
        known = pa.table([pa.array(group.names[at[:, 0], 2]), pa.array(group.names[at[:, 0], 1]), pa.array(at[:, 1].astype(np.int32)), *cols[:2]], ["anchor_row", "anchor_id", "place", "positive_score", "positive_id"])
        pairs = written(spark.createDataFrame(known, "anchor_row long, anchor_id long, place int, positive_score long, positive_id long"), "positives")
        rows = found.join(pairs, ["anchor_row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", noisy))


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.r AS ar, b.vec_id AS id, b.r AS br, a.label = b.label AS same,
    list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, br) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id, s.br)
QUALIFY row_number() OVER w <= 3
"""
