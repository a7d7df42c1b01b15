"""Density clusters of classes of any size, by grid cells.

Cells are so small that any two points of one lie within reach of each other.  A
cell's neighbours are told from the boxes of their points: wholly within reach, out
of reach, or in part.  Points are compared only between cells in part within
reach, tile by tile, and only where the cells' counts leave a question open.
Cells with core points are the nodes whose components are the clusters.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.sources.shared import written

_SLACK = 1e-9  # boxes decide only what rounding can't change


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes in ``edges(a, b)``: the smallest node that can be reached.

    Every round hooks each node's neighbours to the smallest one around it, then
    each node to its smallest neighbour; edges become stars after rounds that grow
    with the logarithm of the component.  A round is a table in the shared folder.
    """

    def hooked(pairs: DataFrame, least: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a <> b").unionByName(least).distinct()

    none = edges.select("a", "b").limit(0)
    now, before = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            break
        before = mark
        both = now.selectExpr("a as u", "b as v").unionByName(now.selectExpr("b as u", "a as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = hooked(both.join(least, "u").where("v > u"), none)
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        now = written(hooked(large.selectExpr("a as u", "b as v").join(small, "u"), small.selectExpr("u as a", "m as b")), "edges")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.selectExpr("a as node", "b as label").unionByName(roots.select("node", F.col("node").alias("label")))


def _extent(xs: str, pick) -> Column:
    return F.aggregate(xs, F.get(F.col(xs), F.lit(0)), lambda m, x: F.zip_with(m, x, lambda p, q: pick(p, q)))


def _squares(gap) -> Column:
    """Sum over the axes of ``gap(low, high, other low, other high)`` squared."""
    axes = F.arrays_zip("lo", "hi", "lo2", "hi2")
    return F.aggregate(axes, F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.lit(0.0), *gap(x["lo"], x["hi"], x["lo2"], x["hi2"])), F.lit(2.0)))


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) <= eps * eps


def cut_into_tiles(df: DataFrame, keys: Sequence[str], ident: str, features: str, side: float, tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``points(keys, ident, g, c, part, pos, x)``, ``tiles(c, part, xs)`` of at most ``tile`` points and ``cells(g, c, cell, n, lo, hi)``.

    A cell is dealt over parts by its count, so one that holds most points is spread.
    """
    x = F.col(features).cast("array<double>")
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = df.where(F.col(features).isNotNull()).select(*keys, ident, group.alias("g"), x.alias("x"), F.transform(x, lambda v: F.floor(v / side)).alias("cell"))
    cells = written(rows.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()), "cells")
    placed = rows.join(cells, ["g", "cell"]).withColumn("salt", F.pmod(F.xxhash64(ident), F.ceil(F.col("n") / (8 * tile))))
    placed = placed.withColumn("k", F.row_number().over(W.partitionBy("c", "salt").orderBy(ident)) - 1)
    points = placed.select(*keys, ident, "g", "c", (F.col("salt") * F.lit(1 << 32) + F.floor(F.col("k") / tile)).alias("part"), (F.col("k") % tile).cast("int").alias("pos"), "x")
    points = written(points, "points")
    tiles = points.groupBy("c", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s")).select("c", "part", F.transform("s", lambda s: s["x"]).alias("xs"))
    tiles = written(tiles, "tiles")
    boxes = tiles.select("c", F.posexplode(F.arrays_zip(_extent("xs", F.least).alias("lo"), _extent("xs", F.greatest).alias("hi"))).alias("axis", "s"))
    boxes = boxes.groupBy("c", "axis").agg(F.min("s.lo").alias("lo"), F.max("s.hi").alias("hi")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("axis", "lo", "hi"))).alias("s"))
    boxes = boxes.select("c", F.transform("s", lambda s: s["lo"]).alias("lo"), F.transform("s", lambda s: s["hi"]).alias("hi"))
    return points, tiles, written(cells.join(boxes, "c"), "boxes")


def neighbour_cells(cells: DataFrame, eps: float, dims: int) -> DataFrame:
    """(a, b, nb, whole): cells of which some points may be within ``eps``, ``whole`` where all are."""
    axes, per = min(dims, 3), math.isqrt(dims) + 1
    coarse = F.transform(F.slice("cell", 1, axes), lambda v: F.floor(v / per))
    around = F.array(*(F.array(*(F.lit(o).cast("long") for o in offset)) for offset in itertools.product((-1, 0, 1), repeat=axes)))
    one = cells.select("g", F.col("c").alias("a"), "lo", "hi", F.explode(F.transform(around, lambda o: F.zip_with(coarse, o, lambda p, q: p + q))).alias("at"))
    two = cells.select("g", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), coarse.alias("at"))
    least = _squares(lambda lo, hi, lo2, hi2: (lo2 - hi, lo - hi2))
    most = _squares(lambda lo, hi, lo2, hi2: (hi2 - lo, hi - lo2))
    met = one.join(two, ["g", "at"]).where((F.col("a") != F.col("b")) & (least <= eps * eps * (1 + _SLACK)))
    return met.select("a", "b", "nb", (most <= eps * eps * (1 - _SLACK)).alias("whole"))


def density_clusters(df: DataFrame, keys: Sequence[str], ident: str, features: str, eps: float, min_share: float = 0.05, min_samples: int = 5, *, tile: int = 512) -> DataFrame:
    """(keys, ident, label): density clusters of feature arrays within each key, -1 for noise.

    A point with ``max(min_samples, min_share n)`` points within ``eps``, itself
    included, is a core point.  Clusters are numbered by their first core point in order of
    ``ident``, which is unique within a key; a point beside several clusters gets
    the first.  Rows without features are noise.  No key and no cell is one piece of work.
    """
    label = F.lit(-1).cast("long").alias("label")
    found = df.agg(F.max(F.size(features))).first()[0]
    if found is None or found < 1:
        return df.select(*keys, ident, label)
    dims = int(found)
    points, tiles, cells = cut_into_tiles(df, keys, ident, features, eps / math.sqrt(dims) * (1 - _SLACK), tile)
    need = cells.groupBy("g").agg(F.greatest(F.lit(min_samples), F.floor(F.sum("n") * min_share)).alias("need"))
    pairs = written(neighbour_cells(cells, eps, dims), "pairs")
    reach = pairs.groupBy(F.col("a").alias("c")).agg(F.sum(F.when(F.col("whole"), F.col("nb")).otherwise(0)).alias("sure"), F.sum("nb").alias("most"))
    state = cells.select("g", "c", "n").join(need, "g").join(reach, "c", "left").na.fill(0, ["sure", "most"])
    state = written(state.select("g", "c", "need", (F.col("n") + F.col("sure")).alias("sure"), (F.col("n") + F.col("most")).alias("most")), "state")
    side = lambda name: tiles.select(F.col("c").alias(name), F.col("part").alias(f"part_{name}"), F.col("xs").alias(f"xs_{name}"))
    matrix = lambda rows: np.array([list(r) for r in rows], float).reshape(len(rows), dims)

    # core points, by counting
    @F.pandas_udf("array<int>")
    def counts(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([_near(matrix(a), matrix(b), eps).sum(1).astype(np.int32) for a, b in zip(one, two)], dtype=object)

    partly = pairs.where(~F.col("whole")).select("a", "b")
    open_cells = state.where("sure < need and most >= need")
    tests = partly.join(open_cells.select(F.col("c").alias("a")), "a").join(side("a"), "a").join(side("b"), "b")
    seen = tests.select(F.col("a").alias("c"), F.col("part_a").alias("part"), F.posexplode(counts("xs_a", "xs_b")).alias("pos", "n")).groupBy("c", "part", "pos").agg(F.sum("n").alias("n"))
    marked = points.select(*keys, ident, "g", "c", "part", "pos").join(state.drop("g"), "c").join(seen, ["c", "part", "pos"], "left")
    marked = written(marked.withColumn("core", F.col("sure") + F.when(F.col("sure") < F.col("need"), F.coalesce("n", F.lit(0))).otherwise(0) >= F.col("need")).select(*keys, ident, "g", "c", "part", "pos", "core"), "marked")

    # links between cells with core points
    flags = marked.groupBy("c", "part").agg(F.array_sort(F.collect_list(F.when(F.col("core"), F.col("pos")))).alias("cores"), F.array_sort(F.collect_list(F.when(~F.col("core"), F.col("pos")))).alias("others"))
    flags = written(flags, "flags")
    cored = flags.where(F.size("cores") > 0)
    with_core = cored.select("c").distinct()
    both = pairs.join(with_core.withColumnRenamed("c", "a"), "a", "left_semi").join(with_core.withColumnRenamed("c", "b"), "b", "left_semi").where("a < b")
    named = lambda df, n: df.select(F.col("c").alias(n), F.col("part").alias(f"part_{n}"), F.col("cores").alias(f"cores_{n}"), F.col("others").alias(f"others_{n}"))

    @F.pandas_udf("boolean")
    def touch(one: pd.Series, two: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([bool(_near(matrix(a)[list(i)], matrix(b)[list(j)], eps).any()) for a, b, i, j in zip(one, two, first, second)])

    facing = both.where(~F.col("whole")).select("a", "b").join(side("a").join(named(cored, "a"), ["a", "part_a"]), "a").join(side("b").join(named(cored, "b"), ["b", "part_b"]), "b")
    links = both.where("whole").select("a", "b").unionByName(facing.where(touch("xs_a", "xs_b", "cores_a", "cores_b")).select("a", "b").distinct())
    joined = with_core.join(components(links).withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("label", "c").alias("cluster"))
    firsts = marked.where("core").groupBy("g", "c").agg(F.min(ident).alias("first")).join(joined, "c")
    order = firsts.groupBy("g", "cluster").agg(F.min("first").alias("first")).withColumn("number", F.row_number().over(W.partitionBy("g").orderBy("first")) - 1)  # a row per cluster
    numbers = written(joined.join(order.select("cluster", "number"), "cluster").select("c", F.col("number").cast("long").alias("number")), "numbers")

    # points that are not core: the first cluster within reach
    @F.pandas_udf("array<int>")
    def touched(one: pd.Series, two: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([np.array(list(i), np.int32)[_near(matrix(a)[list(i)], matrix(b)[list(j)], eps).any(1)] for a, b, i, j in zip(one, two, first, second)], dtype=object)

    whole = pairs.where("whole").select(F.col("a").alias("c"), "b").unionByName(with_core.select("c", F.col("c").alias("b"))).join(numbers.withColumnRenamed("c", "b"), "b").groupBy("c").agg(F.min("number").alias("of_cells"))
    outside = flags.where(F.size("others") > 0)
    met = partly.join(numbers.withColumnRenamed("c", "b"), "b").join(side("a").join(named(outside, "a"), ["a", "part_a"]), "a").join(side("b").join(named(cored, "b"), ["b", "part_b"]), "b")
    beside = met.select(F.col("a").alias("c"), F.col("part_a").alias("part"), "number", F.explode(touched("xs_a", "xs_b", "others_a", "cores_b")).alias("pos")).groupBy("c", "part", "pos").agg(F.min("number").alias("of_points"))
    rows = marked.join(numbers, "c", "left").join(whole, "c", "left").join(beside, ["c", "part", "pos"], "left")
    number = F.when(F.col("core"), F.col("number")).otherwise(F.coalesce(F.least("of_cells", "of_points"), F.lit(-1)))
    bare = df.where(F.col(features).isNull()).select(*keys, ident, label)
    return rows.select(*keys, ident, number.cast("long").alias("label")).unionByName(bare)
