"""Analysis windows: clip limits, thresholds, criteria per window, and the most stable stretch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clip_amplitudes(samples: DataFrame, keys: Sequence[str], win: int, low: float, high: float, min_fac: float = 2.0, nbins: int = 20) -> DataFrame:
    """(keys, min_clip, max_clip): where a window's histogram piles up in an edge bin, its inner edge is a clip limit; the tightest over windows.

    ``nbins - 1`` bins between ``low`` and ``high``; windows of ``win`` samples, the
    incomplete one at the end left out.
    """
    bins, step = nbins - 1, (high - low) / (nbins - 1)
    spot = F.floor(F.col("idx") / win)
    last = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / step)))
    rows = samples.join(last, list(keys)).withColumn("_w", spot).where((F.col("_w") + 1) * win < F.col("_n")).where(F.col("v").between(low, high))
    count = lambda k: F.count_if(F.col("_b") == k)
    hist = rows.withColumn("_b", at).groupBy(*keys, "_w").agg(count(0).alias("l0"), count(2).alias("l2"), count(bins - 1).alias("h0"), count(bins - 3).alias("h2"))
    hist = hist.withColumn("_lo", F.when(F.col("l0") > min_fac * F.col("l2"), low + step).otherwise(F.lit(low)))
    hist = hist.withColumn("_hi", F.when(F.col("h0") > min_fac * F.col("h2"), high - step).otherwise(F.lit(high)))
    return hist.groupBy(*keys).agg(F.max("_lo").alias("min_clip"), F.min("_hi").alias("max_clip"))


def percentile_threshold(samples: DataFrame, keys: Sequence[str], win: int, fac: float = 1.0, p: float = 0.0) -> DataFrame:
    """(keys, window, threshold): ``fac`` times the range between the p and 1 - p percentiles of each window of ``win`` samples."""
    rows = samples.withColumn("window", F.floor(F.col("idx") / win)).groupBy(*keys, "window")
    span = F.max("v") - F.min("v") if p <= 0 else F.percentile("v", F.lit(1 - p)) - F.percentile("v", F.lit(p))
    return rows.agg((fac * span).alias("threshold"))


def median_std_threshold(samples: DataFrame, keys: Sequence[str], win: int, fac: float = 1.0) -> DataFrame:
    """(keys, threshold): ``fac`` times the median of the standard deviations of windows of ``win`` samples."""
    std = samples.groupBy(*keys, F.floor(F.col("idx") / win).alias("_w")).agg(F.stddev_pop("v").alias("_s"))
    return std.groupBy(*keys).agg((fac * F.median("_s")).alias("threshold"))


def std_threshold(samples: DataFrame, keys: Sequence[str], fac: float = 1.0) -> DataFrame:
    return samples.groupBy(*keys).agg((fac * F.stddev_pop("v")).alias("threshold"))


def floor_std_threshold(samples: DataFrame, keys: Sequence[str], win: int, floor: float, fac: float = 4.0) -> DataFrame:
    """(keys, window, threshold): ``fac`` standard deviations of each window, but ``floor`` at least."""
    rows = samples.groupBy(*keys, F.floor(F.col("idx") / win).alias("window"))
    return rows.agg(F.greatest(fac * F.stddev_pop("v"), F.lit(floor)).alias("threshold"))


def window_criteria(pairs: DataFrame, keys: Sequence[str], start: float, end: float, size: float, shift: float, min_clip: float, max_clip: float, *, part: int = 64) -> DataFrame:
    """Per window: cv_interv, mean_ampl, cv_ampl and clipped; 1000 (0 for the amplitude) where there is too little to tell.

    ``pairs(keys, peak_t, peak_v, trough_t, trough_v)``.  Windows begin every half
    ``shift``; both their ends are inclusive, so a pair falls in several.  Pairs are
    dealt out by stretches of windows and get a row per window in their task only.  A first
    or last interval to the window's edge that is longer than the mean one
    worsens the interval's CV in proportion.
    """
    step = shift / 2
    n = int((end - start - size) / step + 1e-9) + 1

    def first_of(c: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((c - start - size) / step - 1e-9)).cast("int")

    def last_of(c: Column) -> Column:
        return F.least(F.lit(n - 1), F.floor((c - start) / step + 1e-9)).cast("int")

    own = [*keys, "_part", "window"]

    def each_window(first: Column, last: Column, *columns: Column) -> DataFrame:
        rows = pairs.where(first <= last).select(*keys, first.alias("_f"), last.alias("_l"), *columns)
        rows = rows.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_f") / part).cast("int"), F.floor(F.col("_l") / part).cast("int")))).repartition(*keys, "_part")
        inside = F.sequence(F.greatest("_f", F.col("_part") * part), F.least("_l", F.col("_part") * part + (part - 1)))
        return rows.withColumn("window", F.explode(inside)).drop("_f", "_l")

    def side(kind: str) -> DataFrame:
        t = F.col(f"{kind}_t")
        rows = each_window(first_of(t), last_of(t), t.alias("t"), F.col(f"{kind}_v").alias("v"))
        rows = rows.withColumn("d", F.col("t") - F.lag("t").over(W.partitionBy(*own).orderBy("t")))
        beyond = F.count_if(F.col("v") > max_clip) if kind == "peak" else F.count_if(F.col("v") < min_clip)
        out = rows.groupBy(*own).agg(F.count("d").alias("nd"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s"), F.min("t").alias("a"), F.max("t").alias("b"), beyond.alias("c"))
        begin = F.lit(start) + F.col("window") * step
        worse = lambda gap: F.when(gap > F.col("m"), gap / F.col("m")).otherwise(F.lit(1.0))
        cv = F.col("s") / F.col("m") * worse(F.col("a") - begin) * worse(begin + size - F.col("b"))
        return out.select(*keys, "window", F.when(F.col("nd") > 2, cv).alias(f"cv_{kind}"), F.col("c").alias(f"clip_{kind}"))

    lo, hi = F.greatest(first_of(F.col("peak_t")), first_of(F.col("trough_t"))), F.least(last_of(F.col("peak_t")), last_of(F.col("trough_t")))
    both = each_window(lo, hi, (F.col("peak_v") - F.col("trough_v")).alias("h"))
    ampl = both.groupBy(*own).agg(F.count("h").alias("n"), F.avg("h").alias("mh"), F.stddev_pop("h").alias("sh"))
    rows = ampl.join(side("peak"), [*keys, "window"], "left").join(side("trough"), [*keys, "window"], "left")
    clipped = (F.coalesce("clip_peak", F.lit(0)) + F.coalesce("clip_trough", F.lit(0))) / 2 / F.col("n")
    enough = F.col("n") > 2
    return rows.select(
        *keys,
        "window",
        (F.lit(start) + F.col("window") * step).alias("begin"),
        F.coalesce((F.col("cv_peak") + F.col("cv_trough")) / 2, F.lit(1000.0)).alias("cv_interv"),
        F.when(enough, F.col("mh") * F.pow(1 - clipped, 2)).otherwise(F.lit(0.0)).alias("mean_ampl"),
        F.when(enough, F.col("sh") / F.col("mh")).otherwise(F.lit(1000.0)).alias("cv_ampl"),
        F.when(enough, clipped).otherwise(F.lit(1.0)).alias("clipped"),
    )


def best_window(criteria: DataFrame, keys: Sequence[str], *, w_interv: float = 1.0, w_ampl: float = 1.0, w_mean: float = 1.0, tolerance: float = 0.2, expand: bool = False) -> DataFrame:
    """The longest run of windows whose cost is within ``tolerance`` of the least, the first of equals; unless ``expand``, its best window only.

    Returns keys, first, last (window numbers), cost and clipped (mean over them).
    """
    rows = criteria.withColumn("cost", w_interv * F.col("cv_interv") + w_ampl * F.col("cv_ampl") - w_mean * F.col("mean_ampl"))
    rows = rows.withColumn("_least", F.min("cost").over(W.partitionBy(*keys))).where(F.col("cost") <= F.col("_least") + tolerance)
    rows = rows.withColumn("_run", F.col("window") - F.row_number().over(W.partitionBy(*keys).orderBy("window")))
    runs = rows.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("n"), F.min("window").alias("first"), F.max("window").alias("last"), F.avg("clipped").alias("mean_clip"), F.min(F.struct("cost", "window", "clipped")).alias("best"))
    top = runs.groupBy(*keys).agg(F.max_by(F.struct("first", "last", "mean_clip", "best"), F.struct("n", -F.col("first"))).alias("r"))
    if expand:
        return top.select(*keys, "r.first", "r.last", F.col("r.best.cost").alias("cost"), F.col("r.mean_clip").alias("clipped"))
    return top.select(*keys, F.col("r.best.window").alias("first"), F.col("r.best.window").alias("last"), F.col("r.best.cost").alias("cost"), F.col("r.best.clipped").alias("clipped"))


def analysis_window(samples: DataFrame, keys: Sequence[str], rate: float, seconds: float, position: str | float = "center", best: DataFrame | None = None) -> DataFrame:
    """(keys, first, last): bounds in samples at the beginning, center, end, a time in seconds, or the best window's begin time.

    Records shorter than the window have none.
    """
    n = F.lit(int(seconds * rate))
    rows = samples.groupBy(*keys).agg((F.max("idx") + 1).alias("_n")).where(F.col("_n") >= n)
    if position == "best":
        rows = rows.join(best.select(*keys, F.col("begin").alias("_t")), list(keys))
        first = F.round(F.col("_t") * rate).cast("long")
    elif position == "begin":
        first = F.lit(0)
    elif position == "end":
        first = F.col("_n") - n
    elif position == "center":
        first = F.floor((F.col("_n") - n) / 2)
    else:
        first = F.lit(int(float(position) * rate))
    first = F.greatest(F.lit(0), F.least(first, F.col("_n") - n)).cast("long")
    return rows.select(*keys, first.alias("first"), (first + n).alias("last"))
