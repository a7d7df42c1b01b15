"""Long-term loggers: signal power, thresholds from histograms, occurrences, file times."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.operators.spectra import filtered_power
from fieldwave.operators.stretches import each_stretch


def signal_power(samples: DataFrame, keys: Sequence[str], micros: str, v: str, size: int, slide: int, *, rate: float | None = None, cutoff: float = 10.0, ties: Sequence[str] = ()) -> DataFrame:
    """(keys, window, std, n): standard deviation in windows of ``size`` microseconds that begin every ``slide``.

    A sample falls in size / slide windows.  With a sampling ``rate``, each window's
    samples are freed of their baseline and drift first: the mean of the first
    twentieth goes, then a first-order high-pass at ``cutoff``; one window is one
    piece of work.  Without it, windows are summed in order of time and of ``ties``, as SQL does
    it row by row, so that the last bits agree; no step holds a window's rows.
    """
    if rate is None:
        return _ordered_std(samples, keys, micros, v, size // slide, slide, ties)
    last = F.floor(F.col(micros) / slide)
    starts = F.sequence(last - (size // slide - 1), last)
    rows = samples.select(*keys, micros, v, F.explode(starts).alias("window"))
    blocks = rows.where(F.col(v).isNotNull()).groupBy(*keys, "window").agg(F.array_sort(F.collect_list(F.struct(micros, v))).alias("_s"))
    blocks = blocks.select(*keys, "window", F.size("_s").cast("long").alias("n"), F.transform("_s", lambda s: s[v].cast("double")).alias("v"))
    return filtered_power(blocks, [*keys, "window", "n"], rate, cutoff).select(*keys, "window", "std", "n")


def _ordered_std(samples: DataFrame, keys: Sequence[str], micros: str, v: str, span: int, slide: int, ties: Sequence[str], part: int = 64) -> DataFrame:
    """(keys, window, std, n) by Welford's sums over rows in order; ``part`` neighbouring windows are one stretch of a key."""
    last = F.floor(F.col(micros) / slide)
    rows = samples.select(*keys, micros, *ties, F.col(v).cast("double").alias("_v"), F.col(v).isNull().alias("_null"), (last - (span - 1)).alias("_f"), last.alias("_l"))
    rows = rows.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_f") / part), F.floor(F.col("_l") / part)))).repartition(*keys, "_part")
    rows = rows.withColumn("_f", F.greatest("_f", F.col("_part") * part)).withColumn("_l", F.least("_l", F.col("_part") * part + (part - 1)))

    def more(held: dict, pdf: pd.DataFrame) -> list:
        for first, last, x, null in zip(*(pdf[c].tolist() for c in ("_f", "_l", "_v", "_null"))):
            for window in range(first, last + 1):
                n, mean, squares = held.get(window, (0, 0.0, 0.0))
                if null:
                    held[window] = n, mean, squares
                else:
                    new = mean + (x - mean) / (n + 1)
                    held[window] = n + 1, new, squares + (x - new) * (x - mean)
        return []

    end = lambda held: [(window, math.sqrt(squares / n) if n else None, n) for window, (n, _, squares) in sorted(held.items())]
    return each_stretch(rows, [*keys, "_part"], [micros, *ties], "window long, std double, n long", dict, more, end).drop("_part")


def hist_threshold(df: DataFrame, keys: Sequence[str], value: str, fac: float = 3.0, nbins: int = 500) -> DataFrame:
    """(keys, center, width, threshold): mode of the histogram plus ``fac`` times its half width at 1/sqrt(e) of the mode's count.

    Bins divide the range of each key evenly; the width is half the distance
    between the outermost bins at or above that height.
    """
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.join(span, list(keys)).where("_hi > _lo")
    step = (F.col("_hi") - F.col("_lo")) / nbins
    rows = rows.withColumn("_b", F.least(F.lit(nbins - 1), F.floor((F.col(value) - F.col("_lo")) / step)))
    hist = rows.groupBy(*keys, "_lo", "_hi", "_b").agg(F.count(F.lit(1)).alias("_n"))
    top = hist.groupBy(*keys).agg(F.max(F.struct(F.col("_n"), (-F.col("_b")).alias("_m"))).alias("_t"))
    rows = hist.join(top, list(keys)).where(F.col("_n") >= F.col("_t._n") / F.exp(F.lit(0.5)))
    out = rows.groupBy(*keys).agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_t").alias("_t"), F.min("_b").alias("_a"), F.max("_b").alias("_z"))
    width = (F.col("_z") - F.col("_a") + 1) / 2 * (F.col("_hi") - F.col("_lo")) / nbins
    center = F.col("_lo") + (-F.col("_t._m") + 0.5) * (F.col("_hi") - F.col("_lo")) / nbins
    return out.select(*keys, center.alias("center"), width.alias("width"), (center + fac * width).alias("threshold"))


def sessionize(df: DataFrame, keys: Sequence[str], time: str, gap: Column | float, extra: Sequence[Column] = ()) -> DataFrame:
    """(keys, session, tstart, tend, n): stretches of rows whose neighbours are at most ``gap`` apart."""
    w = W.partitionBy(*keys).orderBy(time)
    new = F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("int"), F.lit(0))
    rows = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return rows.groupBy(*keys, "session").agg(F.min(time).alias("tstart"), F.max(time).alias("tend"), F.count(F.lit(1)).alias("n"), *extra)


def occurrence_summary(occ: DataFrame, keys: Sequence[str], f: str = "EODf", min_range: float = 10.0) -> DataFrame:
    """Per source: least and largest EODf (a range only beyond ``min_range``), first and last time, total time, channels."""
    out = occ.groupBy(*keys).agg(
        F.min(f).alias("min_EODf"), F.max(f).alias("max_EODf"), F.min("tstart").alias("first"), F.max("tend").alias("last"), F.sum(F.col("tend") - F.col("tstart")).alias("total"), F.array_sort(F.collect_set("channel")).alias("channels")
    )
    return out.withColumn("is_range", F.col("max_EODf") - F.col("min_EODf") > min_range)


def file_time_offsets(files: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: str) -> DataFrame:
    """Adds the offset of each file: the summed durations of the earlier files of its recording."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("offset", F.coalesce(F.sum(seconds).over(w), F.lit(0)))


def shift_start_time(df: DataFrame, times: Sequence[str], start: Column) -> DataFrame:
    """All times moved by the same amount, so that the first one equals ``start``."""
    least = df.agg(F.min(F.least(*times) if len(times) > 1 else F.col(times[0])).alias("_t0"))
    rows = df.crossJoin(F.broadcast(least))  # one row
    for t in times:
        rows = rows.withColumn(t, start + (F.col(t) - F.col("_t0")))
    return rows.drop("_t0")


def read_power(wide: DataFrame, keys: Sequence[str], channels: Sequence[int]) -> DataFrame:
    """(keys, channel, std, supra) from columns channelN and threshN."""
    each = F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"channel{c}").alias("std"), F.col(f"thresh{c}").alias("supra")) for c in channels))
    return wide.select(*keys, F.explode(each).alias("p")).select(*keys, "p.*").where("std is not null")


def write_power(long: DataFrame, keys: Sequence[str], channels: Sequence[int]) -> DataFrame:
    """Columns channelN and threshN from (keys, channel, std, supra)."""
    wide = long.groupBy(*keys).pivot("channel", list(channels)).agg(F.first("std").alias("channel"), F.first("supra").alias("thresh"))
    return wide.select(*keys, *(F.col(f"{c}_{n}").alias(f"{n}{c}") for c in channels for n in ("channel", "thresh")))


def format_occurrences(occ: DataFrame) -> DataFrame:
    """Times as ISO text with whole seconds, the form in which occurrences are stored."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return occ.withColumn("tstart", F.date_format("tstart", iso)).withColumn("tend", F.date_format("tend", iso))


def parse_occurrences(rows: DataFrame) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.withColumn("tstart", F.to_timestamp("tstart", iso)).withColumn("tend", F.to_timestamp("tend", iso))
