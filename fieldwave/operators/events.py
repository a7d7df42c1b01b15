"""Events of sampled signals: peaks and troughs, pulses, intervals, clusters of events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwave.operators import peak_scan


# ---------------------------------------------------------------- peaks
def hysteresis_peaks(x: np.ndarray, threshold: float | np.ndarray) -> tuple[list[int], list[int]]:
    """Peaks and troughs of ``x``: a running maximum is a peak once the signal falls more than the threshold below it, and likewise up."""
    thr = np.broadcast_to(np.asarray(threshold, float), len(x)).tolist()
    if isinstance(x, np.ndarray) and x.dtype == float:
        x = x.tolist()  # the same numbers, sooner read one by one
    peaks, troughs = [], []
    if not len(x):
        return peaks, troughs
    high = low = 0
    way = 0
    for i in range(1, len(x)):
        if way >= 0 and x[i] > x[high]:
            high = i
        if way <= 0 and x[i] < x[low]:
            low = i
        if way >= 0 and x[high] - x[i] > thr[i]:
            peaks.append(high)
            way, low = -1, i
        elif way <= 0 and x[i] - x[low] > thr[i]:
            troughs.append(low)
            way, high = 1, i
    return peaks, troughs


def detect_peaks(samples: DataFrame, threshold: float, keys: Sequence[str], idx: str = "idx", v: str = "v", *, block_bits: int = 16, also: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, v, kind, also) with kind ``peak`` or ``trough``, strictly alternating, over the whole series of each key.

    Series are scanned in blocks of ``2**block_bits`` places, a task each, and the
    states between blocks are put together afterwards (``peak_scan``): the
    result is that of one scan, whatever the blocks.  Null and NaN values are left out.
    ``also`` names columns of the samples that their events keep.
    """
    kinds = dict(samples.dtypes)
    found = peak_scan.detect(samples.select(*keys, F.col(idx).alias("idx"), F.col(v).alias("v"), *also), threshold, keys, block_bits=block_bits, also=also)
    return found.select(*keys, F.col("idx").cast(kinds[idx]).alias(idx), F.col("v").alias(v), "kind", *also)


def trim_events(events: DataFrame, keys: Sequence[str], idx: str = "idx", *, to_peak: bool = False) -> DataFrame:
    """Peaks and troughs paired in order (keys, n, peak_idx, trough_idx, peak_v, trough_v); ``to_peak`` drops troughs ahead of the first peak."""
    if to_peak:
        first = events.where("kind = 'peak'").groupBy(*keys).agg(F.min(idx).alias("_first"))
        events = events.join(first, list(keys)).where(F.col(idx) >= F.col("_first")).drop("_first")
    w = W.partitionBy(*keys, "kind").orderBy(idx)
    rows = events.withColumn("n", F.row_number().over(w) - 1)
    side = lambda kind: rows.where(F.col("kind") == kind).select(*keys, "n", F.col(idx).alias(f"{kind}_idx"), F.col("v").alias(f"{kind}_v"))
    return side("peak").join(side("trough"), [*keys, "n"])


def assign_side_peaks(events: DataFrame, keys: Sequence[str], rel: float = 0.25, idx: str = "idx", time: str = "t") -> DataFrame:
    """Each peak with a trough on both sides takes the steeper flank, or the higher one where slopes differ by at most ``rel`` of their mean.

    Adds trough_idx, height, width and slope to the peaks.
    """
    w = W.partitionBy(*keys).orderBy(idx)
    near = lambda f, s: F.when(f("kind").over(w) == "trough", f(s).over(w))
    rows = events
    for side, f in (("l", F.lag), ("r", F.lead)):
        rows = rows.withColumn(f"_{side}i", near(f, idx)).withColumn(f"_{side}v", near(f, "v")).withColumn(f"_{side}t", near(f, time))
    rows = rows.where("kind = 'peak'")
    for s in ("l", "r"):
        rows = rows.withColumn(f"_{s}h", F.col("v") - F.col(f"_{s}v")).withColumn(f"_{s}w", F.abs(F.col(time) - F.col(f"_{s}t"))).withColumn(f"_{s}s", F.col(f"_{s}h") / F.col(f"_{s}w"))
    close = F.abs(F.col("_ls") - F.col("_rs")) <= rel * (F.col("_ls") + F.col("_rs")) / 2
    left = F.when(F.col("_ri").isNull(), True).when(F.col("_li").isNull(), False).when(close, F.col("_lh") >= F.col("_rh")).otherwise(F.col("_ls") > F.col("_rs"))
    rows = rows.where("_li is not null or _ri is not null").withColumn("_left", left)
    pick = lambda c: F.when(F.col("_left"), F.col(f"_l{c}")).otherwise(F.col(f"_r{c}"))
    return rows.select(*keys, idx, "v", time, pick("i").alias("trough_idx"), pick("h").alias("height"), pick("w").alias("width"), pick("s").alias("slope"))


def resolve_shared_troughs(pulses: DataFrame, keys: Sequence[str], rel: float = 0.25, idx: str = "idx") -> DataFrame:
    """Of two neighbouring pulses on one trough the less steep goes, or the lower where slopes are alike."""
    w = W.partitionBy(*keys).orderBy(idx)
    rows = pulses
    for name, f in (("b", F.lag), ("a", F.lead)):
        for c in ("trough_idx", "slope", "height"):
            rows = rows.withColumn(f"_{name}_{c}", f(c).over(w))

    def loses(s: str, tie: bool):
        close = F.abs(F.col("slope") - F.col(f"_{s}_slope")) <= rel * (F.col("slope") + F.col(f"_{s}_slope")) / 2
        lower = (F.col("height") < F.col(f"_{s}_height")) | ((F.col("height") == F.col(f"_{s}_height")) & F.lit(tie))
        worse = F.when(close, lower).otherwise(F.col("slope") < F.col(f"_{s}_slope"))
        return F.coalesce((F.col("trough_idx") == F.col(f"_{s}_trough_idx")) & worse, F.lit(False))

    return rows.where(~loses("b", True) & ~loses("a", False)).select(pulses.columns)


def make_events(events: DataFrame, keys: Sequence[str], width: float, time: str = "t") -> DataFrame:
    """Peaks with their height over the nearest troughs within ``width``: the mean of both sides, or the one there is; peaks without any go."""
    w = W.partitionBy(*keys).orderBy(time)
    rows = events
    for side, f in (("l", F.lag), ("r", F.lead)):
        fits = (f("kind").over(w) == "trough") & (F.abs(F.col(time) - f(time).over(w)) <= width)
        rows = rows.withColumn(f"_{side}", F.when(fits, F.col("v") - f("v").over(w)))
    both = (F.coalesce("_l", "_r") + F.coalesce("_r", "_l")) / 2
    return rows.where("kind = 'peak'").withColumn("height", both).where("height is not null").drop("_l", "_r")


def discard_nearby(events: DataFrame, min_dist: float, keys: Sequence[str], time: str = "t", height: str = "height") -> DataFrame:
    """Of each pair closer than ``min_dist`` the lower goes (on a tie the later), until none is left.

    Events further apart never matter to each other, so the loop runs on whole
    islands of close events, a few thousand rows of them at a time.
    """
    w = W.partitionBy(*keys).orderBy(time)
    apart = F.coalesce(F.col(time) - F.lag(time).over(w) >= min_dist, F.lit(True))
    rows = events.withColumn("_start", F.when(apart, F.row_number().over(w))).withColumn("_island", F.floor(F.max("_start").over(w) / 4096)).drop("_start")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, kind="stable")
        while len(pdf) > 1:
            t, h = pdf[time].to_numpy(), pdf[height].to_numpy()
            close = np.diff(t) < min_dist
            if not close.any():
                break
            lower = np.where(h[:-1] < h[1:], np.arange(len(h) - 1), np.arange(1, len(h)))[close]
            gone = np.zeros(len(h), bool)
            gone[lower] = True
            pdf = pdf[~gone]
        return pdf

    return rows.groupBy(*keys, "_island").applyInPandas(thin, rows.schema).drop("_island")


# ---------------------------------------------------------------- intervals and classes
def interval_stats(events: DataFrame, keys: Sequence[str], time: str = "t", cv_thresh: float = 0.5, pct: float = 0.3) -> DataFrame:
    """Per key: number, median, mean, std and CV of the intervals, and EODf = 1 / median.

    Where the CV reaches ``cv_thresh`` only intervals under the ``pct`` percentile
    count; if that leaves none, all values are null.
    """
    ipi = events.withColumn("ipi", F.col(time) - F.lag(time).over(W.partitionBy(*keys).orderBy(time))).where("ipi is not null")
    first = ipi.groupBy(*keys).agg((F.stddev_pop("ipi") / F.avg("ipi")).alias("_cv"), F.percentile("ipi", F.lit(pct)).alias("_p"))
    used = F.when((F.col("_cv") < cv_thresh) | (F.col("ipi") < F.col("_p")), F.col("ipi"))
    out = ipi.join(first, list(keys)).withColumn("ipi", used).groupBy(*keys)
    out = out.agg(F.count("ipi").alias("n"), F.percentile("ipi", F.lit(0.5)).alias("median"), F.avg("ipi").alias("mean"), F.stddev_pop("ipi").alias("std"))
    return out.withColumn("cv", F.col("std") / F.col("mean")).withColumn("EODf", 1 / F.col("median"))


def instant_rate(events: DataFrame, keys: Sequence[str], time: str = "t", max_jump: float = 0.1) -> DataFrame:
    """Adds rate = 1 / interval to the next event, and whether it changed by less than ``max_jump`` from the last."""
    w = W.partitionBy(*keys).orderBy(time)
    rows = events.withColumn("rate", 1 / (F.lead(time).over(w) - F.col(time)))
    return rows.withColumn("steady", F.abs(F.col("rate") / F.lag("rate").over(w) - 1) < max_jump)


def central_events(events: DataFrame, keys: Sequence[str], n: int, idx: str = "idx") -> DataFrame:
    """The n events in the middle of each series."""
    w = W.partitionBy(*keys)
    rows = events.withColumn("_n", F.row_number().over(w.orderBy(idx)) - 1).withColumn("_all", F.count(F.lit(1)).over(w))
    start = F.greatest(F.lit(0), F.floor((F.col("_all") - n) / 2))
    return rows.where((F.col("_n") >= start) & (F.col("_n") < start + n)).drop("_n", "_all")


def classify_pulse_wave(pairs: DataFrame, keys: Sequence[str], threshold: float = 0.15) -> DataFrame:
    """Median ratio of peak-trough time to period, folded at one half, mean over both directions; ``pulse`` under the threshold.

    ``pairs(keys, n, peak_t, trough_t)`` in order.
    """
    w = W.partitionBy(*keys).orderBy("n")
    rows = pairs.withColumn("_np", F.lead("peak_t").over(w)).withColumn("_nt", F.lead("trough_t").over(w))
    fold = lambda r: F.when(r > 0.5, 1 - r).otherwise(r)
    down = F.abs((F.col("trough_t") - F.col("peak_t")) / (F.col("_np") - F.col("peak_t")))
    up = F.abs((F.col("_np") - F.col("trough_t")) / (F.col("_nt") - F.col("trough_t")))
    out = rows.select(*keys, fold(down).alias("down"), fold(up).alias("up")).groupBy(*keys)
    out = out.agg(((F.median("down") + F.median("up")) / 2).alias("ratio"), F.count("down").alias("n"))
    return out.where("n > 0").withColumn("is_pulse", F.col("ratio") < threshold)


def prune_clusters(df: DataFrame, min_n: int, min_frac: float, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Labels of clusters with too few events, or too small a share of all, become -1."""
    size = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    total = size.groupBy(*keys).agg(F.sum("_n").alias("_all")) if keys else size.agg(F.sum("_n").alias("_all"))
    size = size.join(total, list(keys)) if keys else size.crossJoin(F.broadcast(total))  # one row
    bad = (F.col("_n") < min_n) | (F.col("_n") / F.col("_all") < min_frac)
    return df.join(size, [*keys, label]).withColumn(label, F.when(bad, F.lit(-1)).otherwise(F.col(label))).drop("_n", "_all")


def drop_sparse_clusters(df: DataFrame, seconds: float, keys: Sequence[str], rho: float = 5e-4, label: str = "label", width: str = "width") -> DataFrame:
    """Clusters stay whose events cover at least ``rho`` of the time."""
    good = df.groupBy(*keys, label).agg((F.count(F.lit(1)) * F.median(width)).alias("_cover")).where(F.col("_cover") >= seconds * rho)
    return df.join(good.select(*keys, label), [*keys, label], "left_semi")


def drop_unreliable_clusters(df: DataFrame, keys: Sequence[str], threshold: float = 0.2, label: str = "label", time: str = "t", width: str = "width") -> DataFrame:
    """Clusters go that have fewer than two events, or events wider than ``threshold`` of their shortest interval."""
    w = W.partitionBy(*keys, label).orderBy(time)
    ipi = df.withColumn("_ipi", F.col(time) - F.lag(time).over(w)).groupBy(*keys, label)
    stats = ipi.agg(F.count(F.lit(1)).alias("_n"), (F.median(width) / F.min("_ipi")).alias("_ratio"))
    good = stats.where((F.col("_n") >= 2) & ~(F.col("_ratio") > threshold))
    return df.join(good.select(*keys, label), [*keys, label], "left_semi")


def filter_pulses(df: DataFrame, rate: float, min_width: float = 5e-5, max_width: float = 0.01, margin: str | None = None, n_samples: str | None = None) -> DataFrame:
    """Strict limits on the width, and a margin of the widest pulse inside the record where its length is known."""
    ok = (F.col("width") > min_width) & (F.col("width") < max_width)
    if n_samples is not None:
        edge = max_width * rate
        ok = ok & (F.col("idx") > edge) & (F.col("idx") < F.col(n_samples) - edge)
    return df.where(ok)


def discard_wide_pulses(samples: DataFrame, events: DataFrame, keys: Sequence[str], label: str = "label", share: float = 0.5) -> DataFrame:
    """Classes go in which most pulses are wider than a tenth of the class's mean interval."""
    w = W.partitionBy(*keys, label).orderBy("t")
    rows = events.withColumn("_ipi", F.col("t") - F.lag("t").over(w))
    mean = rows.groupBy(*keys, label).agg(F.avg("_ipi").alias("_mean"))
    bad = rows.join(mean, [*keys, label]).groupBy(*keys, label).agg(F.avg((F.col("width") > 0.1 * F.col("_mean")).cast("double")).alias("_share")).where(F.col("_share") > share)
    return events.join(bad.select(*keys, label), [*keys, label], "left_anti")


# ---------------------------------------------------------------- events and samples
def snippets(samples: DataFrame, events: DataFrame, keys: Sequence[str], left: int, right: int, block: int | None = None) -> DataFrame:
    """(keys, event, pos, v): samples from ``left`` before to ``right`` after (exclusive) each event that lies fully inside its record.

    Samples and events meet by block of indices and its neighbours, never by a
    bare range condition; a block holds a few snippets' samples, so that few meet in vain.
    """
    block = block or max(16, 2 * (left + right))
    last = samples.groupBy(*keys).agg(F.max("idx").alias("_last"), F.min("idx").alias("_first"))
    inside = events.select(*keys, F.col("idx").alias("event")).join(last, list(keys)).where((F.col("event") - left >= F.col("_first")) & (F.col("event") + right - 1 <= F.col("_last")))
    spans = inside.withColumn("_block", F.explode(F.sequence(F.floor((F.col("event") - left) / block), F.floor((F.col("event") + right - 1) / block)))).drop("_last", "_first")
    rows = samples.select(*keys, "idx", "v").withColumn("_block", F.floor(F.col("idx") / block))
    met = rows.join(spans, [*keys, "_block"]).withColumn("pos", F.col("idx") - F.col("event"))
    return met.where((F.col("pos") >= -left) & (F.col("pos") < right)).select(*keys, "event", "pos", "v")


def snippet_arrays(samples: DataFrame, events: DataFrame, keys: Sequence[str], left: int, right: int, spans: DataFrame | None = None, block: int = 1 << 14) -> DataFrame:
    """(keys, event, pos, v): the same as arrays, a row for each place with an event; events without any samples go.

    Samples and events are sorted together in blocks of indices, whose ends
    neighbours share; slices are cut out of many whole blocks at a time, so no sample
    becomes a row per event.  ``spans(keys, first, last)`` are the records' ends, where known.
    """
    if spans is None:
        spans = samples.groupBy(*keys).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    inside = events.select(*keys, F.col("idx").cast("long").alias("idx")).distinct().join(spans.select(*keys, "first", "last"), list(keys))
    inside = inside.where((F.col("idx") - left >= F.col("first")) & (F.col("idx") + right - 1 <= F.col("last")))
    begin, end = F.floor((F.col("idx") - (right - 1)) / block).cast("long"), F.floor((F.col("idx") + left) / block).cast("long")
    rows = samples.select(*keys, F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v"), F.explode(F.when(begin == end, F.array(begin)).otherwise(F.sequence(begin, end))).alias("_block"))
    at = inside.select(*keys, "idx", F.lit(None).cast("double").alias("v"), F.floor(F.col("idx") / block).cast("long").alias("_block"))
    rows = rows.withColumn("_event", F.lit(False)).unionByName(at.withColumn("_event", F.lit(True)))
    rows = rows.withColumn("_begins", F.row_number().over(W.partitionBy(*keys, "_block").orderBy("idx")) == 1).select("_begins", "_event", "_block", "idx", "v", *keys)
    kinds = samples.schema
    schema = T.StructType([*(T.StructField(k, kinds[k].dataType) for k in keys), T.StructField("event", T.LongType()), T.StructField("pos", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def made(table: pa.Table) -> list[pa.RecordBatch]:
        of, idx = table["_event"].to_numpy(), table["idx"].to_numpy()
        place = idx - table["_block"].to_numpy() * block
        place += (np.cumsum(table["_begins"].to_numpy()) - 1) * (block + left + right) + left  # a block's places before those of the next one
        x, v, e = place[~of], table["v"].to_numpy()[~of], place[of]
        a, z = np.searchsorted(x, e - left), np.searchsorted(x, e + right)
        has = z > a
        a, e, size, at = a[has], e[has], (z - a)[has], np.flatnonzero(of)[has]
        if not len(at):
            return []
        upto = np.append(0, np.cumsum(size))
        index = np.repeat(a - upto[:-1], size) + np.arange(upto[-1])
        offsets, pos = pa.array(upto.astype(np.int32)), (x[index] - np.repeat(e, size)).astype(np.int32)
        named = table.select(list(keys)).take(pa.array(at)).combine_chunks()
        columns = [*(named[k].combine_chunks() for k in keys), pa.array(idx[at]), pa.ListArray.from_arrays(offsets, pa.array(pos)), pa.ListArray.from_arrays(offsets, pa.array(v[index], from_pandas=True))]
        return [pa.RecordBatch.from_arrays(columns, names=schema.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            cuts = np.flatnonzero(batch.column(0).to_numpy(zero_copy_only=False))
            if len(cuts) and n + cuts[-1] >= 1 << 16:
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]))
                held, n, batch = [], 0, batch.slice(cuts[-1])
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from made(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def clipped_fraction(snips: DataFrame, keys: Sequence[str], low: float, high: float) -> DataFrame:
    """Share of the events with any sample at or beyond a clip limit."""
    each = snips.groupBy(*keys, "event").agg(((F.max("v") >= high) | (F.min("v") <= low)).cast("double").alias("_c"))
    return each.groupBy(*keys).agg(F.avg("_c").alias("clipped"), F.count(F.lit(1)).alias("n"))
