"""Harmonic groups of spectra, and phases of waveforms."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from operator import gt, lt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions.harmonics import GroupParams
from fieldwave.functions.harmonics import harmonic_groups as _groups
from fieldwave.operators.events import hysteresis_peaks
from fieldwave.operators.stretches import whole_groups


def spectral_thresholds(spectra: DataFrame, keys: Sequence[str], nbins: int = 100, low_fac: float = 6.0, high_fac: float = 10.0) -> DataFrame:
    """(keys, low, high) in decibel: histogram width of the third quarter of the detrended spectrum, times a factor.

    ``spectra(keys, freq, db)``.
    """
    from fieldwave.operators.logger import hist_threshold

    span = spectra.groupBy(*keys).agg(F.max("freq").alias("_top"))
    part = spectra.join(span, list(keys)).where((F.col("freq") >= 0.5 * F.col("_top")) & (F.col("freq") < 0.75 * F.col("_top")) & (F.abs("db") < float("inf")))
    fit = part.groupBy(*keys).agg(F.regr_slope("db", "freq").alias("_s"), F.regr_intercept("db", "freq").alias("_i"))
    flat = part.join(fit, list(keys)).withColumn("_r", F.col("db") - F.col("_s") * F.col("freq") - F.col("_i"))
    return hist_threshold(flat, keys, "_r", 1.0, nbins).select(*keys, (low_fac * F.col("width")).alias("low"), (high_fac * F.col("width")).alias("high"))


def harmonic_groups(spectra: DataFrame, keys: Sequence[str], resolution: float, params: GroupParams = GroupParams(), thresholds: DataFrame | None = None, check: Sequence[float] = ()) -> DataFrame:
    """(keys, grp, h, freq, power) of every spectrum; ``spectra(keys, freq, power)``.

    Peaks rise over the low threshold; those that stand over their trough by more
    than the high one can begin a group.  Groups are numbered by fundamental;
    fundamentals to ``check`` are tried first.  One spectrum is one piece of work.
    """
    rows = spectra.withColumn("db", 10 * F.log10(F.greatest("power", F.lit(1e-20))))
    limits = thresholds if thresholds is not None else spectral_thresholds(rows, keys)
    rows = rows.join(limits.select(*keys, "low", "high"), list(keys))

    @F.pandas_udf("array<struct<grp:int,h:int,freq:double,power:double>>")
    def run(freqs: pd.Series, dbs: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        out = []
        for f, db, low, high in zip(freqs, dbs, lows, highs):
            f, db = np.asarray(f, float), np.asarray(db, float)
            peaks, troughs = hysteresis_peaks(db, low)
            n = min(len(peaks), len(troughs))
            peaks, troughs = np.array(peaks[:n], int), np.array(troughs[:n], int)
            groups = _groups(f[peaks], 10 ** (db[peaks] / 10), db[peaks] - db[troughs] > high, resolution, params, check) if n else []
            out.append([{"grp": g, "h": int(h), "freq": float(x), "power": float(p)} for g, members in enumerate(groups) for h, x, p in members[:, :3]])
        return pd.Series(out, dtype=object)

    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("freq", "db"))).alias("s"), F.first("low").cast("double").alias("low"), F.first("high").cast("double").alias("high"))
    at = lambda name: F.transform("s", lambda x: x[name])
    return held.select(*keys, F.explode(run(at("freq"), at("db"), "low", "high")).alias("g")).select(*keys, "g.*")


def _crossings(t: np.ndarray, v: np.ndarray, level: float) -> np.ndarray:
    """Times at which v crosses the level, by linear interpolation."""
    d = v - level
    i = np.flatnonzero(d[:-1] * d[1:] < 0)
    return t[i] + (t[i + 1] - t[i]) * d[i] / (d[i] - d[i + 1])


def _halfway(t: list[float], v: list[float], spots: list[int]) -> list[float]:
    """Between spots that follow each other, the middle one of the times at which half of the way is done; NaN where there is none."""
    out = []
    for a, b in zip(spots, spots[1:]):
        level = (v[a] + v[b]) / 2
        d = [x - level for x in v[a : b + 1]]
        i = [i for i in range(b - a) if d[i] * d[i + 1] < 0]
        k = i[len(i) // 2] if i else 0
        out.append(t[a + k] + (t[a + k + 1] - t[a + k]) * d[k] / (d[k] - d[k + 1]) if i else np.nan)
    return out


def _width(t: list[float], v: list[float], i: int) -> float:
    """Between the crossings of half of a spot's height that are nearest on either side; from or to the end where there is none."""
    sign, level = float(np.sign(v[i] or 1)), abs(v[i]) / 2

    def nearest(steps: range, beyond: Callable, end: float) -> float:
        for k in steps:
            d, e = v[k] * sign - level, v[k + 1] * sign - level
            if d * e < 0 and beyond(at := t[k] + (t[k + 1] - t[k]) * d / (d - e), t[i]):
                return at
        return end

    return nearest(range(i, len(v) - 1), gt, t[-1]) - nearest(range(i - 1, -1, -1), lt, t[0])


def _phases(waves: DataFrame, keys: Sequence[str], dt: float, names: Sequence[str], found: Callable) -> DataFrame:
    """(keys, p, names) of all that ``found(t, v)`` gives for each waveform, many of them at a time."""

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        t, v = pdf["pos"].to_numpy() * dt, pdf["v"].to_numpy()
        rows = [(a, *r) for a, z in zip(cuts, cuts[1:]) for r in found(t[a:z], v[a:z])]
        at, *columns = zip(*rows) if rows else [()] * (len(names) + 2)
        return pdf[[*keys]].iloc[list(at)].assign(p=list(columns[0]), **{n: np.array(c, float) for n, c in zip(names, columns[1:])})

    return whole_groups(waves.select(*keys, "pos", "v"), keys, ["pos"], ", ".join(["p int", *(f"{n} double" for n in names)]), work)


def pulse_phases(waves: DataFrame, keys: Sequence[str], dt: float, peak_thr: float = 0.01, min_dist: float = 5e-5) -> DataFrame:
    """(keys, p, time, amplitude, relampl, width, area, relarea, zeros): peaks and troughs of a conditioned pulse, P1 the largest peak.

    Turns at the waveform's ends are no phases; of two phases closer than
    ``min_dist`` the smaller goes, but never the largest peak or trough.  Widths are at half height, areas go from zero to zero.
    """

    def found(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        top, low = int(np.argmax(v)), int(np.argmin(v))
        peaks, troughs = hysteresis_peaks(v, peak_thr * np.ptp(v))
        spots = sorted(({*peaks, *troughs} - {0, len(v) - 1}) | {top} | ({low} if v[low] < -peak_thr * v[top] else set()))
        k = 0
        while k + 1 < len(spots):
            a, b = spots[k], spots[k + 1]
            if t[b] - t[a] < min_dist and not {a, b} <= {top, low}:
                loses = a if (b in (top, low) or abs(v[a]) < abs(v[b])) and a not in (top, low) else b
                spots.remove(loses)
                k = max(0, k - 1)
            else:
                k += 1
        times, values, zeros = t.tolist(), v.tolist(), _crossings(t, v, 0.0).tolist()
        rows, total = [], np.abs(v).sum() * dt
        for n, i in enumerate(spots):
            left, right = bisect_left(zeros, times[i]), bisect_right(zeros, times[i])
            a, b = zeros[left - 1] if left else times[0], zeros[right] if right < len(zeros) else times[-1]
            area = v[bisect_left(times, a) : bisect_right(times, b)].sum() * dt
            rows.append((n + 1 - spots.index(top), t[i], v[i], v[i] / v[top], _width(times, values, i), area, area / total, b if right < len(zeros) else None))
        return rows

    return _phases(waves, keys, dt, ["time", "amplitude", "relampl", "width", "area", "relarea", "zeros"], found)


def pulse_span(waves: DataFrame, keys: Sequence[str], dt: float, se_thr: float = 0.01) -> DataFrame:
    """(keys, tstart, tend, pulse_width): where a conditioned pulse first and last exceeds ``se_thr`` of its largest value."""
    top = F.max(F.abs("v")).over(W.partitionBy(*keys))
    rows = waves.withColumn("_top", top).where(F.abs("v") > se_thr * F.col("_top"))
    out = rows.groupBy(*keys).agg((F.min("pos") * dt).alias("tstart"), (F.max("pos") * dt).alias("tend"))
    return out.withColumn("pulse_width", F.col("tend") - F.col("tstart"))


def wave_phases(waves: DataFrame, keys: Sequence[str], dt: float, freq: float, frac: float = 0.05) -> DataFrame:
    """(keys, p, time, amplitude, relampl, width, zeros) over one period from the maximum, P1, that lies a quarter before to three quarters of a period after time zero.

    Peaks and troughs are found on the whole waveform; ``zeros`` is where the way to
    the next one is half done, the width reaches from the last such time to this.
    """

    def found(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        one = v[(t >= 0) & (t <= 1 / freq)]
        peaks, troughs = hysteresis_peaks(v, frac * np.ptp(one)) if len(one) and np.ptp(one) > 0 else ([], [])
        spots = np.array(sorted({*peaks, *troughs}), int)
        near = spots[(t[spots] >= -0.25 / freq) & (t[spots] < 0.75 / freq)]
        rows = []
        if len(near):
            ways = [np.nan, *_halfway(t.tolist(), v.tolist(), spots.tolist()), np.nan]
            zero, big = t[near[np.argmax(v[near])]], np.abs(v[near]).max()
            for k in np.flatnonzero((t[spots] >= zero) & (t[spots] < zero + 1 / freq - dt / 2)):
                rows.append((len(rows) + 1, t[spots[k]] - zero, v[spots[k]], abs(v[spots[k]]) / big, ways[k + 1] - ways[k], ways[k + 1] - zero))
        return rows

    return _phases(waves, keys, dt, ["time", "amplitude", "relampl", "width", "zeros"], found)


def side_peak_or_wave(waves: DataFrame, keys: Sequence[str], dt: float, max_phases: int = 4) -> DataFrame:
    """(keys, side_peak, wave): mean snippets that are not centered on their highest extremum, and those with too many phases of alike width.

    A cluster without phases is judged by itself: neither.
    """
    phases = pulse_phases(waves, keys, dt)
    stats = phases.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by("time", F.abs("amplitude")).alias("_t"), F.stddev_pop("width").alias("_s"), F.avg("width").alias("_w"))
    span = waves.groupBy(*keys).agg((F.max("pos") - F.min("pos")).alias("_span"), ((F.max("pos") + F.min("pos")) / 2).alias("_mid"))
    rows = span.join(stats, list(keys), "left")
    off = F.abs(F.col("_t") - F.col("_mid") * dt) > 0.25 * F.col("_span") * dt
    return rows.select(*keys, F.coalesce(off, F.lit(False)).alias("side_peak"), F.coalesce((F.col("_n") > max_phases) & (F.col("_s") < 0.3 * F.col("_w")), F.lit(False)).alias("wave"))
