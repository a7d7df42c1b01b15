"""Waveforms of wave sources from segments of their recordings: segments are rows, recordings of any length are cut."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRID = np.arange(200) / 200  # phases at which waveforms are compared
_CHUNK = 4096  # samples of a recording that travel together
TOO_SHORT, UNSTABLE = "too short", "waveforms not stable"


def factor(f: float) -> int:
    """By how much high frequencies shorten a segment and widen the search."""
    return max(1, int(np.round(f / 400)))


def plan(n: int, rate: float, f: float, df: float, min_segments: int = 6) -> tuple[int, np.ndarray]:
    """Length of the segments of ``n`` samples, and where they begin: three quarters overlap, halved until there are enough."""
    seconds = min(n / rate, 1 / (df * factor(f)))
    size = max(16, int(seconds * rate))
    starts = lambda size: np.arange(0, max(1, n - size + 1), size // 4)
    while len(starts(size)) < min_segments and size > 8:
        seconds /= 2
        size = max(8, int(seconds * rate))
    return size, starts(size)


def coefficients(x: np.ndarray, rate: float, f: float, n: int) -> np.ndarray:
    """Fourier coefficients 0..n of a segment at a fundamental, by trapezoids."""
    taper = np.full(len(x), 2.0 / (len(x) - 1))
    taper[[0, -1]] /= 2
    return np.exp(-2j * np.pi * f / rate * np.outer(np.arange(n + 1), np.arange(len(x)))) @ (x * taper)


def centred(c: np.ndarray) -> np.ndarray:
    """Without offset, the phase of the fundamental zero."""
    c = c * np.exp(-1j * np.arange(len(c)) * np.angle(c[1]))
    c[0] = 0
    return c


@lru_cache(maxsize=64)
def _harmonics(n: int) -> np.ndarray:
    return np.exp(2j * np.pi * np.outer(_GRID, np.arange(n)))


def waveform(c: np.ndarray) -> np.ndarray:
    return np.real(_harmonics(len(c)) @ c)


def fit(x: np.ndarray, rate: float, f: float, df: float, max_harmonics: int) -> tuple[float, np.ndarray]:
    """The frequency around ``f`` whose five harmonics have the largest height, the first of equals, and its coefficients."""
    wide = factor(f)
    grid = np.linspace(f - df * wide, f + df * wide, 1 + 4 * wide)
    height = [np.ptp(waveform(coefficients(x, rate, g, 5))) for g in grid]
    best = float(grid[int(np.argmax(height))])
    return best, centred(coefficients(x, rate, best, max_harmonics))


def stable(corr: np.ndarray, min_corr: float) -> list[int]:
    """Segments of one cluster of much alike waveforms, empty where there is none.

    Alike is beyond the upper median of all correlations over ``min_corr``, or equal
    to it where none is beyond, as in signals without noise; common
    segments are alike to more than half as many (rounded down) as the one with most.  The
    best pair that has a common member starts the cluster, and each member brings
    the common one that it is most like.
    """
    corr = corr.copy()
    np.fill_diagonal(corr, 0.0)
    high = np.sort(corr[corr > min_corr])
    if not len(high):
        return []
    level = high[len(high) // 2]
    beyond = corr > level
    if not beyond.any():
        beyond = corr >= level
    count = beyond.sum(1)
    common = count > max(1, count.max() // 2)
    left = corr.copy()
    while True:
        pair = [int(k) for k in np.unravel_index(np.argmax(left), left.shape)]
        if left[pair[0], pair[1]] < max(level, 1 - (1 - min_corr) / 4):
            return []
        left[pair, :] = left[:, pair] = -np.inf
        members = [k for k in pair if common[k]]
        for k in members:  # grows meanwhile
            options = np.where(common & beyond[k], corr[k], -np.inf)
            options[members] = -np.inf
            if np.isfinite(options.max()):
                members.append(int(options.argmax()))
        if len(members) == 1:
            members.append(int(corr[members[0]].argmax()))
        if members:
            return members


def choose(f: float, starts: np.ndarray, size: int, rate: float, found: list[tuple[float, np.ndarray]], min_corr: float, ampl_frac: float = 0.5) -> tuple:
    """(EODf, periods, mean coefficients, reason) of fitted segments; a single one is taken as it is."""
    if not found:
        return None, 0.0, None, TOO_SHORT
    waves = np.array([waveform(c) for _, c in found])
    good = [0]
    if len(found) > 1:
        std = waves.std(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.nan_to_num(np.corrcoef(waves)) if std.any() else np.zeros((len(waves), len(waves)))
        good = stable(corr, min_corr)
        if not good:
            return f, 0.0, None, UNSTABLE
        good = [k for k in good if std[k] >= ampl_frac * std[good].max()]
    covered, reach = 0, -np.inf
    for a in np.sort(starts[good]):
        covered, reach = covered + min(size, a + size - reach), a + size
    eodf = float(np.mean([found[k][0] for k in good]))
    return eodf, float(covered / rate * eodf), np.mean([found[k][1] for k in good], axis=0), ""


def extract(x: np.ndarray, rate: float, f: float, df: float, min_corr: float, max_harmonics: int) -> tuple:
    """The same of one series that is at hand."""
    size, starts = plan(len(x), rate, f, df)
    if len(x) < min(size, 8) or len(x) < 4:
        return None, 0.0, None, TOO_SHORT
    found = [fit(x[s : s + size], rate, f, df, max_harmonics) for s in starts]
    return choose(f, starts, min(size, len(x)), rate, found, min_corr)


def extract_waves(samples: DataFrame, waves: DataFrame, keys: Sequence[str], rate: float, resolution: float = 0.5, min_corr: float = 0.99, max_harmonics: int = 5) -> DataFrame:
    """(keys, grp, EODf, n, skip_reason, coeffs): refined frequency and mean coefficients of the sources ``waves(keys, grp, freq)`` of recordings ``samples(keys, idx, v)``.

    Samples travel in chunks to the segments that need them; a segment is fitted
    by itself, and only its coefficients meet those of the others.  Samples that
    are missing between the first and the last count as zero.
    """
    own, kinds = [*keys, "grp"], dict(waves.dtypes) | dict(samples.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in own)
    sizes = samples.groupBy(*keys).agg(F.min("idx").cast("long").alias("first"), (F.max("idx") - F.min("idx") + 1).cast("long").alias("n"))
    cut = waves.select(*own, F.col("freq").cast("double").alias("freq")).join(sizes, list(keys))

    @F.pandas_udf("size long, starts array<long>")
    def planned(ns: pd.Series, fs: pd.Series) -> pd.DataFrame:
        made = [plan(n, rate, f, resolution) if n >= 4 else (n, np.zeros(0, int)) for n, f in zip(ns, fs)]
        return pd.DataFrame({"size": [min(s, n) for (s, _), n in zip(made, ns)], "starts": [x for _, x in made]})

    cut = cut.withColumn("p", planned("n", "freq")).select(*own, "freq", "first", F.col("p.size").alias("size"), F.explode_outer("p.starts").alias("start"))
    begin = F.col("first") + F.col("start")
    chunk = F.floor(F.col("idx") / _CHUNK).cast("long")
    chunks = samples.groupBy(*keys, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("v").cast("double").alias("v")))).alias("s"))
    need = cut.where("start is not null").withColumn("chunk", F.explode(F.sequence(F.floor(begin / _CHUNK).cast("long"), F.floor((begin + F.col("size") - 1) / _CHUNK).cast("long"))))
    inside = F.filter("s", lambda x: (x["idx"] >= begin) & (x["idx"] < begin + F.col("size")))
    parts = need.join(chunks, [*keys, "chunk"]).select(*own, "freq", "size", "start", "chunk", inside.alias("s"))
    segments = parts.groupBy(*own, "freq", "size", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x["s"])).alias("s"))
    segments = segments.select(*own, "freq", "size", "start", F.transform("s", lambda x: x["idx"]).alias("at"), F.transform("s", lambda x: x["v"]).alias("v"))
    segments = segments.join(sizes.select(*keys, "first"), list(keys)).withColumn("at", F.transform("at", lambda i: i - begin))

    def dense(at, v, size: int) -> np.ndarray:
        x = np.zeros(size)
        x[np.asarray(at, int)] = v
        return x

    @F.pandas_udf("f double, re array<double>, im array<double>")
    def fitted(at: pd.Series, vs: pd.Series, sizes: pd.Series, fs: pd.Series) -> pd.DataFrame:
        made = [fit(dense(i, v, n), rate, f, resolution, max_harmonics) for i, v, n, f in zip(at, vs, sizes, fs)]
        return pd.DataFrame({"f": [f for f, _ in made], "re": [c.real for _, c in made], "im": [c.imag for _, c in made]})

    rows = segments.select(*own, "freq", "size", "start", fitted("at", "v", "size", "freq").alias("r")).select(*own, "freq", "size", "start", "r.*")
    rows = rows.unionByName(cut.where("start is null").select(*own, "freq", "size", "start"), allowMissingColumns=True)

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        known = pdf[pdf["f"].notna()]
        found = [(f, np.asarray(a, float) + 1j * np.asarray(b, float)) for f, a, b in zip(known["f"], known["re"], known["im"])]
        eodf, n, c, why = choose(pdf["freq"].iloc[0], known["start"].to_numpy(int), int(pdf["size"].iloc[0]), rate, found, min_corr)
        return pdf[own].iloc[:1].assign(EODf=np.nan if eodf is None else eodf, n=n, skip_reason=why, re=[None if c is None else c.real], im=[None if c is None else c.imag])

    made = rows.groupBy(*own).applyInPandas(chosen, head + ", EODf double, n double, skip_reason string, re array<double>, im array<double>")
    return made.select(*own, F.when(~F.isnan("EODf"), F.col("EODf")).alias("EODf"), "n", "skip_reason", F.arrays_zip("re", "im").alias("coeffs"))
