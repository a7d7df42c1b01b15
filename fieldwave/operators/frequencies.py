"""Frequencies of many recordings, windows and groups: matching, uniqueness, consistency."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.operators.stretches import islands, whole_groups
from fieldwave.sources.shared import written

#: Musical intervals (name, numerator, denominator, index): fixed values.
INTERVALS = (
    ("unison", 1, 1, 0.0),
    ("minor second", 16, 15, 1.0),
    ("major second", 9, 8, 2.0),
    ("minor third", 6, 5, 3.0),
    ("major third", 5, 4, 4.0),
    ("forth", 4, 3, 5.0),
    ("tritone", 45, 32, 6.0),
    ("fifth", 3, 2, 7.0),
    ("minor sixth", 8, 5, 8.0),
    ("major sixth", 5, 3, 9.0),
    ("subminor seventh", 7, 4, 9.5),
    ("minor seventh", 9, 5, 10.0),
    ("major seventh", 15, 8, 11.0),
    ("octave", 2, 1, 12.0),
)


def _pairs(df: DataFrame, keys: Sequence[str], ident: str, f: str) -> DataFrame:
    a = df.select(*keys, F.col(ident).alias("i"), F.col(f).alias("fi"))
    b = df.select(*keys, F.col(ident).alias("j"), F.col(f).alias("fj"))
    return a.join(b, list(keys))


def freq_diffs(df: DataFrame, keys: Sequence[str], ident: str = "id", f: str = "f") -> DataFrame:
    """Difference fi - fj and ratio fi / fj of all pairs inside one recording."""
    return _pairs(df, keys, ident, f).withColumn("diff", F.col("fi") - F.col("fj")).withColumn("ratio", F.col("fi") / F.col("fj"))


freq_ratios = freq_diffs


def freq_intervals(df: DataFrame, keys: Sequence[str], ident: str = "id", f: str = "f") -> DataFrame:
    """Nearest musical interval of each pair of different sources with a ratio of 0.5 to 2.05; ratios under 0.98 are inverted."""
    rows = freq_diffs(df, keys, ident, f).where("i <> j and ratio >= 0.5 and ratio < 2.05")
    up = F.when(F.col("ratio") < 0.98, 1 / F.col("ratio")).otherwise(F.col("ratio"))
    table = F.array(*(F.struct(F.lit(k).alias("interval"), F.lit(name).alias("name"), F.lit(num / den).alias("pure")) for name, num, den, k in INTERVALS))
    near = F.array_min(F.transform(table, lambda x: F.struct(F.abs(F.col("up") - x["pure"]).alias("off"), x["interval"].alias("interval"), x["name"].alias("name"), x["pure"].alias("pure"))))
    rows = rows.withColumn("up", up).withColumn("near", near)
    return rows.select(*keys, "i", "j", "ratio", F.col("near.interval").alias("interval"), F.col("near.name").alias("name"), (F.col("up") - F.col("near.pure")).alias("deviation"), ((F.col("up") - F.col("near.pure")) / F.col("near.pure")).alias("rel_deviation"))


def similar_frequencies(df: DataFrame, df_thresh: float, keys: Sequence[str] = (), next_elements: int = 0) -> DataFrame:
    """Pairs of rows of different elements that are each other's nearest in the other's element and closer than ``df_thresh``.

    ``df(keys, element, id, f)``; the pair is (element, id, f) before (element_b,
    id_b, f_b) in element order, optionally among the next elements only.  Rows
    meet by frequency bucket and its neighbours, never by element alone.
    """
    b = F.floor(F.col("f") / df_thresh)
    left = df.select(*keys, "element", "id", "f", F.explode(F.array(b - 1, b, b + 1)).alias("bucket"))
    right = df.select(*keys, F.col("element").alias("element_b"), F.col("id").alias("id_b"), F.col("f").alias("f_b"), b.alias("bucket"))
    met = left.join(right, [*keys, "bucket"]).drop("bucket").where((F.col("element") < F.col("element_b")) & (F.abs(F.col("f") - F.col("f_b")) < df_thresh))
    if next_elements > 0:
        met = met.where(F.col("element_b") - F.col("element") <= next_elements)
    gap = F.abs(F.col("f") - F.col("f_b"))
    there = W.partitionBy(*keys, "element", "id", "element_b").orderBy(gap, "id_b")
    back = W.partitionBy(*keys, "element_b", "id_b", "element").orderBy(gap, "id")
    return met.withColumn("_x", F.row_number().over(there)).withColumn("_y", F.row_number().over(back)).where("_x = 1 and _y = 1").drop("_x", "_y")


def unique_frequencies_index(df: DataFrame, df_thresh: float, keys: Sequence[str]) -> DataFrame:
    """(keys, unique, element, id, f): the members of each distinct frequency.

    Seeds are taken in (element, f) order; a seed's members are its direct
    partners, which are then no seeds themselves.  No partners lie across a gap of
    the threshold, so the greedy pass runs on stretches between gaps, a few
    hundred of them at a time; only the seeds of a key are numbered together.
    """
    pairs = similar_frequencies(df, df_thresh, keys)
    listed = pairs.select(*keys, "element", "id", "element_b", "id_b").unionByName(
        pairs.select(*keys, F.col("element_b").alias("element"), F.col("id_b").alias("id"), F.col("element").alias("element_b"), F.col("id").alias("id_b"))
    )
    partners = listed.groupBy(*keys, "element", "id").agg(F.collect_list(F.struct("element_b", "id_b")).alias("partners"))
    rows = islands(df.select(*keys, "element", "id", "f"), keys, "f", df_thresh, ["element", "id"], closed=True)
    rows = rows.withColumn("_stretch", F.floor(F.col("island") / 256)).drop("island")
    rows = rows.join(partners, [*keys, "element", "id"], "left")

    def greedy(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        element, ident, f = (pdf[c].tolist() for c in ("element", "id", "f"))
        others, seed, row = pdf["partners"].tolist(), [], []
        for a, z in zip(cuts, cuts[1:]):
            place = {(element[n], ident[n]): n for n in range(a, z)}
            taken = set()
            for n in range(a, z):
                own = element[n], ident[n]
                if own in taken:
                    continue
                members = [own] + sorted({(p["element_b"], p["id_b"]) for p in (others[n] if others[n] is not None else ())} - taken)
                taken.update(members)
                seed += [n] * len(members)
                row += [place[m] for m in members]
        of, at = pdf.iloc[row].reset_index(drop=True), pdf.iloc[seed].reset_index(drop=True)
        return of[[*own_keys]].assign(_e=at["element"], _f=at["f"], _i=at["id"], element=of["element"], id=of["id"], f=of["f"])

    kinds, own_keys = dict(df.dtypes), [*keys, "_stretch"]
    made = whole_groups(rows, own_keys, ["element", "f", "id"], f"_e {kinds['element']}, _f double, _i {kinds['id']}, element {kinds['element']}, id {kinds['id']}, f double", greedy)
    made = written(made.drop("_stretch"), "members")
    seeds = made.select(*keys, "_e", "_f", "_i").where("element = _e and id = _i")
    seeds = seeds.withColumn("unique", (F.row_number().over(W.partitionBy(*keys).orderBy("_e", "_f", "_i")) - 1).cast("int")).drop("_f")
    return made.drop("_f").join(seeds, [*keys, "_e", "_i"]).select(*keys, "unique", "element", "id", "f")


def relative_power(df: DataFrame, keys: Sequence[str], power: str = "power", name: str = "relpower") -> DataFrame:
    return df.withColumn(name, F.col(power) - F.max(power).over(W.partitionBy(*keys)))


def power_ranks(df: DataFrame, keys: Sequence[str], power: str = "power", ties: Sequence[str] = ("id",), name: str = "rank") -> DataFrame:
    """0 for the strongest row of an element, then -1, -2, and so on."""
    return df.withColumn(name, 1 - F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(power), *ties)))


def unique_mask(df: DataFrame, df_thresh: float, mode: str = "power", keys: Sequence[str] = (), next_elements: int = 0) -> DataFrame:
    """``df`` without the weaker row of every similar pair.

    Weaker by ``power``, or by ``relpower`` or ``rank`` inside its element with
    power as second criterion; on a full tie the earlier element goes.
    """
    rows = df
    if mode == "relpower":
        rows = relative_power(rows, [*keys, "element"], name="_m")
    elif mode == "rank":
        rows = power_ranks(rows, [*keys, "element"], name="_m")
    else:
        rows = rows.withColumn("_m", F.col("power"))
    pairs = similar_frequencies(df, df_thresh, keys, next_elements)
    strength = rows.select(*keys, "element", "id", F.struct("_m", "power").alias("s"))
    met = pairs.join(strength, [*keys, "element", "id"]).join(
        strength.select(*keys, F.col("element").alias("element_b"), F.col("id").alias("id_b"), F.col("s").alias("s_b")), [*keys, "element_b", "id_b"]
    )
    first = F.col("s") <= F.col("s_b")
    gone = met.select(*keys, F.when(first, F.col("element")).otherwise(F.col("element_b")).alias("element"), F.when(first, F.col("id")).otherwise(F.col("id_b")).alias("id"))
    return df.join(gone.distinct(), [*keys, "element", "id"], "left_anti")


def consistent(df: DataFrame, df_thresh: float, keys: Sequence[str]) -> DataFrame:
    """The strongest row of each distinct frequency that is found in every element (``df`` has power too)."""
    groups = unique_frequencies_index(df, df_thresh, keys).drop("f").join(df, [*keys, "element", "id"])
    total = df.groupBy(*keys).agg(F.count_distinct("element").alias("elements"))
    best = groups.groupBy(*keys, "unique").agg(F.count_distinct("element").alias("n"), F.max_by(F.struct("element", "id", "f", "power"), F.struct("power", -F.col("element"))).alias("best"))
    return best.join(total, list(keys)).where("n = elements").select(*keys, "unique", "n", "best.*")


def closest(df: DataFrame, df_thresh: float, close_thresh: float, min_closest: int, keys: Sequence[str]) -> DataFrame:
    """Per distinct frequency the run of neighbouring windows (elements) whose frequencies stay closest.

    The closest pair of neighbouring windows starts the run; it grows to the side
    with the smaller step (left on ties) while steps are under ``close_thresh``.
    Runs of at least ``min_closest`` windows give their strongest member and the
    first and last window.
    """
    groups = unique_frequencies_index(df, df_thresh, keys).drop("f").join(df, [*keys, "element", "id"])
    own = [*keys, "unique"]
    w = W.partitionBy(*own).orderBy("element")
    rows = groups.withColumn("_n", F.row_number().over(W.partitionBy(*own, "element").orderBy(F.desc("power"), "f", "id"))).where("_n = 1").drop("_n")
    step = F.when(F.col("element") - F.lag("element").over(w) == 1, F.abs(F.col("f") - F.lag("f").over(w)))
    rows = rows.withColumn("_step", step)
    seed = F.min(F.when(F.col("_step").isNotNull(), F.struct("_step", "element"))).over(W.partitionBy(*own))["element"]
    rows = rows.withColumn("_seed", seed)
    # steps under the limit are taken from either side in turn, so the run is the stretch of such steps around the seed's own step
    cut = F.when((F.col("_step") < close_thresh) | (F.col("element") == F.col("_seed")), 0).otherwise(1)
    rows = rows.withColumn("_run", F.when(F.col("_seed").isNotNull(), F.sum(cut).over(w)).otherwise(0))
    rows = rows.withColumn("_at", F.max(F.when(F.col("element") == F.col("_seed"), F.col("_run"))).over(W.partitionBy(*own))).where("_at is null or _run = _at")
    best = F.max_by(F.struct("id", "f", "power"), F.struct("power", -F.col("element"))).alias("best")
    out = rows.groupBy(*own).agg(best, F.min("element").alias("first"), F.max("element").alias("last"), F.count(F.lit(1)).alias("_len"), F.max("_at").alias("_at"))
    kept = F.when(F.col("_at").isNull(), F.lit(min_closest <= 1)).otherwise(F.col("_len") >= min_closest)
    return out.where(kept).select(*own, "best.*", "first", "last")


def match_harmonic_power(coeffs: DataFrame, group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Data power of harmonic h: of the group's lowest peak in ((h - 0.5) f0, (h + 0.5) f0); peaks above the last coefficient get rows of their own.

    ``coeffs(keys, h, f0, amplitude)``, ``group(keys, freq, power)``.
    """
    base = coeffs.groupBy(*keys).agg(F.max("f0").alias("f0"), F.max("h").alias("last"))
    near = group.join(base, list(keys)).withColumn("h", F.floor(F.col("freq") / F.col("f0") + 0.5))
    inside = near.where("freq > (h - 0.5) * f0")
    found = inside.groupBy(*keys, "h").agg(F.min(F.struct("freq", "power")).alias("p"), F.max("last").alias("last"))
    known = coeffs.join(found.select(*keys, "h", F.col("p.power").alias("datapower")), [*keys, "h"], "left").select(*keys, "h", "amplitude", "datapower")
    rest = found.where("h > last").select(*keys, "h", F.lit(None).cast("double").alias("amplitude"), F.col("p.power").alias("datapower"))
    return known.unionByName(rest)


def fundamentals(harmonics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group its fundamental and its power: the sum over harmonics, in decibel."""
    return harmonics.groupBy(*keys).agg(F.min_by("freq", "h").alias("f"), (10 * F.log10(F.sum("power"))).alias("db"), F.sum("power").alias("power"))


def top_groups(harmonics: DataFrame, keys: Sequence[str], group: str, n: int) -> DataFrame:
    """The n groups with most summed power of each key, numbered by frequency."""
    base = fundamentals(harmonics, [*keys, group])
    best = base.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("power"), group))).where(F.col("_n") <= n).drop("_n")
    return best.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy("f", group)) - 1)


def drop_mains(df: DataFrame, f: str = "f", mains: float = 60.0, tol: float = 1.0, keep: bool = False) -> DataFrame:
    """Rows whose frequency is not near a multiple of the mains (or, with ``keep``, only those)."""
    from fieldwave.functions.columns import near_multiple

    hit = near_multiple(F.col(f), mains, tol)
    return df.where(hit if keep else ~hit)
