"""Signal power, sessions and spectra of streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwave.functions.harmonics import GroupParams
from fieldwave.functions.kernels import nfft_for
from fieldwave.operators.harmonic_groups import harmonic_groups
from fieldwave.operators.spectra import filtered_power, psd


def _windows(rows: DataFrame, keys: Sequence[str], time: str, v: str, size: str, slide: str) -> DataFrame:
    """(keys, start, end, n, v): the samples of each window in order of time."""
    held = rows.groupBy(*keys, F.window(time, size, slide).alias("w")).agg(F.array_sort(F.collect_list(F.struct(time, v))).alias("s"))
    return held.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.size("s").cast("long").alias("n"), F.transform("s", lambda x: x[v].cast("double")).alias("v"))


def stream_signal_power(stream: DataFrame, keys: Sequence[str], time: str = "ts", v: str = "v", size: str = "10 seconds", slide: str = "5 seconds", threshold: Column | float | None = None, late: str = "15 seconds", rate: float | None = None, cutoff: float = 10.0) -> DataFrame:
    """(keys, start, end, std, n[, loud]) of sliding windows; the watermark is one window plus one slide.

    With a sampling ``rate``, windows are freed of baseline and drift by a
    first-order high-pass at ``cutoff`` first.  With a threshold, ``loud`` is
    std > threshold.  Works on batches as well, where the watermark has no effect.
    """
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    if rate is not None:
        out = filtered_power(_windows(rows, keys, time, v, size, slide), [*keys, "start", "end", "n"], rate, cutoff).select(*keys, "start", "end", "std", "n")
    else:
        out = rows.groupBy(*keys, F.window(time, size, slide).alias("w")).agg(F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
        out = out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "std", "n")
    if threshold is None:
        return out
    return out.withColumn("loud", F.col("std") > (F.lit(threshold) if isinstance(threshold, (int, float)) else threshold))


def stream_sessions(stream: DataFrame, keys: Sequence[str], time: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(keys, tstart, tend, n): occurrence intervals whose detections are less than ``gap`` apart; tend is the last detection's time."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(*keys, F.session_window(time, gap).alias("s")).agg(F.max(time).alias("tend"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("s.start").alias("tstart"), "tend", "n")


def window_spectra(rows: DataFrame, keys: Sequence[str], rate: float, resolution: float, time: str = "ts", v: str = "v", min_averages: int = 3, late: str = "15 seconds", size: str | None = None) -> DataFrame:
    """(keys, start, n, v): windows long enough for ``min_averages`` segments (or of a given ``size``), of a batch or a stream."""
    seconds = nfft_for(rate, resolution) * (min_averages + 1) / 2 / rate
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    size = size or f"{seconds:.6f} seconds"
    return _windows(rows, keys, time, v, size, size).select(*keys, "start", "n", "v")


def window_frequencies(windows: DataFrame, keys: Sequence[str], rate: float, resolution: float, params: GroupParams = GroupParams(), thresholds: DataFrame | None = None) -> DataFrame:
    """(keys, start, grp, h, freq, power): harmonic groups of each window's spectrum."""
    own = [*keys, "start"]
    return harmonic_groups(psd(windows, own, rate, resolution), own, resolution, params, thresholds)


def stream_frequencies(stream: DataFrame, keys: Sequence[str], rate: float, resolution: float, sink: Callable[[DataFrame, int], None], params: GroupParams = GroupParams(), thresholds: Callable[[DataFrame], DataFrame] | None = None, **windows):
    """A stream writer that hands the harmonic groups of each micro-batch's windows to ``sink``."""
    rows = window_spectra(stream, keys, rate, resolution, **windows)

    def each(df: DataFrame, n: int) -> None:
        sink(window_frequencies(df, keys, rate, resolution, params, thresholds(df) if thresholds else None), n)

    return rows.writeStream.outputMode("append").foreachBatch(each)
