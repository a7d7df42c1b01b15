"""Clusters of events: mixtures on a line, density clusters, greedy merges, moving sources."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions import kernels as K
from fieldwave.operators.density import density_clusters
from fieldwave.operators.stretches import each_stretch, islands, whole_groups
from fieldwave.sources.shared import written

_FEW = 1000  # names of large groups that a plan may hold


def _grouped(df: DataFrame, keys: Sequence[str], schema: str, work) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(work, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def mixture_1d(df: DataFrame, keys: Sequence[str], ident: str, x: str, n: int, *, use_log: bool = False, min_n: int = 1, ratio: float = 0.5, bins: int = 4096) -> DataFrame:
    """(keys, ident, label): clusters of one property, cut where the mixture's most likely part changes, close neighbours merged.

    The mixture is fitted to a histogram of each key: its values themselves where
    there are at most ``bins`` different ones, else so many equal steps of the
    (logarithmic) property, each at the mean of its values, which moves a cut by a step
    at most.  So no step sees more than ``bins`` rows of a key, however many it has;
    keys with few rows are fitted many at a time.
    Null and NaN values get -1.
    """
    rows = df.select(*keys, ident, F.col(x).cast("double").alias("_x")).withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    rows = rows.withColumn("_z", F.when(F.col("_x").isNotNull(), F.log(F.greatest("_x", F.lit(1e-300)))) if use_log else F.col("_x"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    beside = lambda left, right: left.join(right.withColumnsRenamed({k: f"_{k}" for k in keys}), reduce(Column.__and__, same, F.lit(True)), "left").drop(*(f"_{k}" for k in keys))
    values = rows.where("_x is not null").groupBy(*keys, "_x", "_z").agg(F.count(F.lit(1)).alias("_n"))
    range_ = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.min("_z").alias("_lo"), F.max("_z").alias("_hi"))
    place = F.when(F.col("_m") > bins, F.least(F.floor((F.col("_z") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("double")).otherwise(F.col("_z"))
    steps = beside(values, range_).groupBy(*keys, place.alias("_bin")).agg(F.sum("_n").alias("_n"), (F.sum(F.col("_z") * F.col("_n")) / F.sum("_n")).alias("_z"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("_x"), F.min("_z").alias("_first"))

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        v, z, count, first = (pdf[c].to_numpy(float) for c in ("_x", "_z", "_n", "_first"))
        part, found = K.mixtures_1d(z, cuts, n, count), []
        for a, b in zip(cuts, cuts[1:]):
            label = K.merge_neighbours(v[a:b], part[a:b], ratio, min_n, count[a:b])
            cut = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            found.append((first[a:b][cut], label[cut]))
        return pdf[[*keys]].iloc[cuts[:-1]].assign(_cuts=[c for c, _ in found], _labels=[x for _, x in found])

    cuts = whole_groups(steps, keys, ["_first"], "_cuts array<double>, _labels array<long>", work)
    label = F.get("_labels", F.size(F.filter("_cuts", lambda c: c <= F.col("_z"))) - 1)
    return beside(rows, cuts).select(*keys, ident, F.coalesce(label, F.lit(-1)).cast("long").alias("label"))


def dbscan(df: DataFrame, keys: Sequence[str], ident: str, features: str, eps: float, min_share: float = 0.05, min_samples: int = 5, *, most: int = 2048) -> DataFrame:
    """(keys, ident, label): density clusters of feature arrays within each key, -1 for noise.

    Keys of up to ``most`` rows are clustered in one step each; larger ones by
    grid cells over all tasks (``density``), with the same labels.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ident, kind="stable")
        points = np.stack([np.asarray(f, float) for f in pdf[features]])
        label = K.dbscan(points, eps, max(min_samples, int(min_share * len(points))))
        return pdf[[*keys, ident]].assign(label=label)

    rows = df.select(*keys, ident, features)
    if not most:
        return density_clusters(rows, keys, ident, features, eps, min_share, min_samples)
    group, size = F.to_json(F.struct(*keys)) if keys else F.lit(""), rows.groupBy(*keys).count().where(F.col("count") > most)
    large = [r["g"] for r in size.select(group.alias("g")).limit(_FEW + 1).collect()]
    schema = f"{ident} {dict(df.dtypes)[ident]}, label long"
    if not large:
        return _grouped(rows, keys, schema, work)
    if len(large) > _FEW:
        return density_clusters(rows, keys, ident, features, eps, min_share, min_samples)
    small = _grouped(rows.where(~group.isin(large)), keys, schema, work)
    return small.unionByName(density_clusters(rows.where(group.isin(large)), keys, ident, features, eps, min_share, min_samples))


def merge_peak_trough_clusters(labels: DataFrame, keys: Sequence[str], ident: str) -> DataFrame:
    """(keys, ident, label) from two labelings (peak_label, trough_label) of the same events.

    Repeat: keep the largest cluster left of either labeling and drop the
    clusters of the other that it touches.  Only the contingency table of a key
    meets in one place.
    """
    table = labels.where("peak_label >= 0 or trough_label >= 0").groupBy(*keys, "peak_label", "trough_label").agg(F.count(F.lit(1)).alias("n"))

    def merged(peak: list[int], trough: list[int], n: list[int]) -> list[tuple[str, int]]:
        size, met = {}, {}
        for p, t, k in zip(peak, trough, n):
            for own, other in ((("peak", p), ("trough", t)), (("trough", t), ("peak", p))):
                if own[1] >= 0:
                    size[own] = size.get(own, 0) + k
                    met.setdefault(own, set()).add(other)
        kept, gone = [], set()
        for best in sorted(size, key=lambda c: (-size[c], c)):
            if best not in gone:
                kept.append(best)
                gone |= met[best]
        return kept

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        columns = [pdf[c].tolist() for c in ("peak_label", "trough_label", "n")]
        made = [(a, kind, int(k), i) for a, z in zip(cuts, cuts[1:]) for i, (kind, k) in enumerate(merged(*(c[a:z] for c in columns)))]
        at, kind, old, label = (list(c) for c in zip(*made)) if made else ([], [], [], [])
        return pdf[[*keys]].iloc[at].assign(kind=kind, old=old, label=label)

    kept = whole_groups(table, keys, ["peak_label", "trough_label"], "kind string, old long, label int", work)
    side = lambda kind: labels.join(kept.where(F.col("kind") == kind).withColumnRenamed("old", f"{kind}_label"), [*keys, f"{kind}_label"]).select(*keys, ident, "label")
    return side("peak").unionByName(side("trough")).groupBy(*keys, ident).agg(F.min("label").alias("label"))


def moving_sources(events: DataFrame, keys: Sequence[str], min_dt: float = 0.25, step: float = 0.05, fac: float = 2000.0) -> DataFrame:
    """(keys, label): the clusters of the window with the fewest clusters, then fewest sparse ones, then highest mean height.

    Windows of ``max(min_dt, fac median width)`` slide by ``step``; empty ones don't count.
    A key is passed over in order of time, batch by batch, so an event is no row per window.
    ``events(keys, label, t, width, height)``.
    """
    whole = W.partitionBy(*keys)
    rows = events.withColumn("_dt", F.greatest(F.lit(min_dt), fac * F.median("width").over(whole))).withColumn("_t0", F.min("t").over(whole))
    last = F.floor((F.col("t") - F.col("_t0")) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - F.col("_t0") - F.col("_dt")) / step + 1e-9)).cast("long")
    rows = rows.where("t is not null and _dt is not null").select(*keys, "t", "label", F.coalesce(F.col("height").cast("double"), F.lit(0.0)).alias("height"), first.alias("_first"), F.greatest(first, last).cast("long").alias("_last"))
    more = lambda held, pdf: [held.add(*r) for r in zip(*(pdf[c].tolist() for c in ("_first", "_last", "label", "height")))] and []
    # the window has put a key into one partition
    return each_stretch(rows, keys, ["t"], f"label {dict(events.dtypes)['label']}", _Sliding, more, lambda held: held.end())


class _Sliding:
    """The clusters of the best window, from events in order of the first and the last window that they are in; only those of the present windows are held."""

    def __init__(self):
        self.held, self.number, self.heights, self.odd = deque(), Counter(), 0, Counter()
        self.sparse, self.since, self.best = 0, 0, None

    def _count(self, label, by: int) -> None:
        n = self.number[label] + by
        self.sparse += (n == 1) - (self.number[label] == 1)
        self.number[label] = n
        if not n:
            del self.number[label]

    def _height(self, height: float, by: int) -> None:
        if math.isfinite(height):
            top, bottom = height.as_integer_ratio()
            self.heights += by * (top << (1074 - bottom.bit_length() + 1))  # as a whole number, so that sums are exact
        else:
            self.odd[repr(height)] += by

    def _judge(self) -> None:
        """The windows since ``since`` hold the same events."""
        if self.held:
            odd = sum((float(x) for x, n in self.odd.items() if n), 0.0)
            mean = odd or self.heights / (len(self.held) << 1074)
            rank = (len(self.number), self.sparse, mean != mean, -mean)
            if self.best is None or rank < self.best[0]:
                self.best = rank, list(self.number)

    def _pass(self, first: int) -> None:
        """All windows before ``first`` are judged, and what lies before it is let go."""
        while self.held and self.held[0][0] < first:
            last = self.held[0][0]
            self._judge()
            while self.held and self.held[0][0] <= last:
                _, label, height = self.held.popleft()
                self._count(label, -1)
                self._height(height, -1)
            self.since = last + 1
        if self.since < first:
            self._judge()
            self.since = first

    def add(self, first: int, last: int, label, height: float) -> None:
        self._pass(first)
        self.held.append((last, label, height))
        self._count(label, 1)
        self._height(height, 1)

    def end(self) -> list[tuple]:
        self._pass(self.held[-1][0] + 1)
        return [(label,) for label in self.best[1]]


def group_across_channels(pulses: DataFrame, keys: Sequence[str], max_dt: float = 2e-4, min_height: float = 0.02) -> DataFrame:
    """(keys, event, channel, t, height): pulses of different channels within ``max_dt`` of the highest one are one event.

    One pulse per channel stays, its highest, the nearest of equals; groups whose
    highest pulse is under ``min_height`` go.  Rows are cut into sessions by gaps first, so only
    close pulses meet; no step holds a recording.
    """
    rows = islands(pulses.select(*keys, "channel", "t", "height"), keys, "t", max_dt, ["channel"], name="session")
    rows = rows.withColumn("_part", F.floor(F.col("session") / 256))  # short sessions share a group, none is cut

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "channel", "height"], kind="stable").reset_index(drop=True)
        t, height, channel = (pdf[c].to_numpy() for c in ("t", "height", "channel"))
        free, kept, part = np.ones(len(t), bool), [], []
        for n, k in enumerate(np.lexsort((t, -height))):
            if free[k]:
                near = np.arange(np.searchsorted(t, t[k] - 1.01 * max_dt), np.searchsorted(t, t[k] + 1.01 * max_dt, "right"))
                near = near[free[near] & (np.abs(t[near] - t[k]) <= max_dt)]
                free[near] = False
                if height[k] >= min_height:
                    near = near[np.lexsort((np.abs(t[near] - t[k]), -height[near]))]
                    best = near[np.sort(np.unique(channel[near], return_index=True)[1])]
                    kept.append(best)
                    part += [n] * len(best)
        at = np.concatenate(kept) if kept else np.zeros(0, int)
        made = pdf.loc[at].assign(part=np.array(part, int))
        event = made.groupby(["session", "part"], sort=True).ngroup() + 1
        return made[[*keys, "_part"]].assign(_event=event, channel=made["channel"], t=made["t"], height=made["height"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_part long", "_event long", f"channel {kinds['channel']}", "t double", "height double"])
    made = written(rows.groupBy(*keys, "_part").applyInPandas(work, schema), "events")
    ahead = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per group
    parts = made.groupBy(*keys, "_part").agg(F.max("_event").alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    return made.join(parts, [*keys, "_part"]).select(*keys, "channel", "t", "height", (F.col("_ahead") + F.col("_event")).alias("event"))
