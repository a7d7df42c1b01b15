"""Whole jobs made of the operators: pulses and waves of a recording, their property rows, merged sources, loaded analyses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions import kernels as K
from fieldwave.functions.harmonics import GroupParams
from fieldwave.operators import clusters as C
from fieldwave.operators import events as V
from fieldwave.operators import frequencies as Q
from fieldwave.operators import harmonic_groups as H
from fieldwave.operators import spectra as S
from fieldwave.operators import wave_segments as G
from fieldwave.operators import waveforms as A
from fieldwave.operators import windows as N
from fieldwave.operators.stretches import each_stretch, whole_groups
from fieldwave.sources.shared import joins_by_shuffle, written


_FEW, _MOST = 1000, 2048  # names of large classes that a plan may hold; rows of a class that is clustered in one step


def _unit_shapes(pos: pd.Series, v: pd.Series) -> pd.Series:
    """Snippets freed of the line from their first to their last sample, with unit norm; all of a length at a time."""
    sizes, out = v.map(len).to_numpy(), np.empty(len(v), object)
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        p, x = np.stack(pos.iloc[of]).astype(float), np.stack(v.iloc[of]).astype(float)
        first, rise = x[:, :1], x[:, -1:] - x[:, :1]
        x = x - first - rise * (p - p[:, :1]) / np.maximum(p[:, -1:] - p[:, :1], 1)
        norm = np.zeros(len(of))
        for k in range(size):
            norm += x[:, k] * x[:, k]
        norm = np.sqrt(norm)[:, None]
        x = np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), 0.0)
        for k, row in zip(of, x):
            out[k] = row
    return pd.Series(out)


def shape_clusters(arrays: DataFrame, keys: Sequence[str], ident: str, eps: float, k: int = 5, min_share: float = 0.05, min_samples: int = 5, *, most: int = _MOST) -> DataFrame:
    """(keys, ident, label): density clusters of each class's waveforms on its own principal components, -1 for noise."""
    return clusters_and_means(arrays, keys, ident, eps, k, min_share, min_samples, most=most).where("mean is null").select(*keys, ident, "label")


def clusters_and_means(arrays: DataFrame, keys: Sequence[str], ident: str, eps: float, k: int = 5, min_share: float = 0.05, min_samples: int = 5, *, carry: Sequence[str] = (), most: int = _MOST) -> DataFrame:
    """(keys, ident, label, carry, mean): a row for each waveform, and one with the mean waveform, and no ident, for each cluster.

    Classes of up to ``most`` rows get components, clusters and means in one step,
    many classes at a time; of larger ones no step sees all rows.
    """
    kinds = dict(arrays.dtypes)
    rows = arrays.select(*keys, ident, *carry, "v")
    group = F.to_json(F.struct(*keys)) if len(keys) else F.lit("")
    large = [r["g"] for r in rows.groupBy(*keys).count().where(F.col("count") > most).select(group.alias("g")).limit(_FEW + 1).collect()]

    def work(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        label, size, at, of, means = np.empty(len(pdf), int), pdf["v"].map(len).to_numpy(), [], [], []
        for a, z in zip(cuts, cuts[1:]):
            if size[a:z].min() != size[a:z].max():
                raise ValueError("waveforms of a class have one length")
            x = np.stack(pdf["v"].iloc[a:z]).astype(float)
            mean = x.sum(0) / len(x)
            base = K.loadings(x.T @ x / len(x) - np.outer(mean, mean), k)
            label[a:z] = found = K.dbscan((x - mean) @ base.T, eps, max(min_samples, int(min_share * len(x))))
            for c in range(found.max() + 1):
                at.append(a), of.append(c), means.append(x[found == c].mean(0))
        no, rows = [None] * len(at), np.append(np.arange(len(pdf)), np.array(at, int))
        own = {c: pd.Series([*pdf[c], *no], dtype=object) for c in (ident, *carry)}
        own |= {"label": np.append(label, np.array(of, int)), "mean": pd.Series([None] * len(pdf) + means, dtype=object)}
        return pdf[[*keys]].iloc[rows].reset_index(drop=True).assign(**{c: own[c] for c in (ident, "label", *carry, "mean")})

    schema = ", ".join([f"{ident} {kinds[ident]}", "label long", *(f"{c} {kinds[c]}" for c in carry), "mean array<double>"])
    small = rows if not large else rows.where(~group.isin(large)) if len(large) <= _FEW else None
    done = [] if small is None else [whole_groups(small, keys, [ident], schema, work, nullable=[ident, *carry])]
    if large:
        rest = rows if small is None else rows.where(group.isin(large))
        scores = written(S.principal_scores(rest, keys, ident, k), "scores")
        label = written(C.dbscan(scores, keys, ident, "scores", eps, min_share, min_samples).join(rest, [*keys, ident]), "shapes")
        at = label.where("label >= 0").select(*keys, "label", F.posexplode("v").alias("pos", "x")).groupBy(*keys, "label", "pos").agg(F.avg("x").alias("x"))
        mean = at.groupBy(*keys, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda x: x["x"]).alias("mean"))
        done.append(label.select(*keys, ident, "label", *carry, F.lit(None).cast("array<double>").alias("mean")))
        done.append(mean.select(*keys, F.lit(None).cast(kinds[ident]).alias(ident), "label", *(F.lit(None).cast(kinds[c]).alias(c) for c in carry), "mean"))
    return reduce(DataFrame.unionByName, done)


def _labelled(pieces: DataFrame, keys: Sequence[str], rate: float, eps: float, low_freq: float) -> DataFrame:
    """(keys, side, idx, name): the shape cluster of each pulse around its peak (side 0) and around its trough (1); artefacts, unreliable clusters, side peaks and waves have no row.

    ``pieces(keys, side, idx, t, width, w, h, pos, v)`` are the snippets.
    """
    classed = pieces.where("w >= 0 and h >= 0").select(*keys, "side", "w", "h", "idx", "t", "width", F.pandas_udf(_unit_shapes, "array<double>")("pos", "v").alias("v"))
    found = clusters_and_means(classed, [*keys, "side", "w", "h"], "idx", eps, carry=["t", "width"]).where("label >= 0")
    name = (F.col("w") * 1024 + F.col("h")) * F.lit(1 << 40) + F.col("label")  # in the order of classes and their clusters
    found = written(found.select(*keys, "side", name.cast("long").alias("name"), "idx", "t", "width", "mean"), "shapes")
    own = [*keys, "side", "name"]
    arrays = found.where("mean is not null").select(*own, F.col("mean").alias("v"))
    bad = S.artefact_clusters(arrays, own, rate, low_freq).where("artefact").select(*own)
    bad = bad.unionByName(H.side_peak_or_wave(arrays.select(*own, F.posexplode("v").alias("pos", "v")), own, 1 / rate).where("side_peak or wave").select(*own)).distinct()
    good = V.drop_unreliable_clusters(found.where("mean is null"), [*keys, "side"], label="name").join(bad, own, "left_anti")
    return good.select(*own, "idx")


def _mean_snippets(snips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, v): means of the snippets ``snips(keys, pos, v)`` of each class, a batch of arrays at a time."""

    def more(held: dict, pdf: pd.DataFrame) -> list:
        pos, v = np.concatenate(pdf["pos"].tolist()), np.concatenate(pdf["v"].tolist())
        known, at = np.unique(pos[~np.isnan(v)], return_inverse=True)
        for p, n, total in zip(known.tolist(), np.bincount(at).tolist(), np.bincount(at, v[~np.isnan(v)]).tolist()):
            before = held.get(p, (0, 0.0))
            held[p] = before[0] + n, before[1] + total
        return []

    rows = snips.select(*keys, "pos", "v").repartition(*keys)
    return each_stretch(rows, keys, [], "pos int, v double", dict, more, lambda held: [(p, total / n) for p, (n, total) in sorted(held.items())])


def extract_pulses(
    samples: DataFrame, keys: Sequence[str], rate: float, threshold: float, *, min_width: float = 5e-5, max_width: float = 0.01, left: int = 8, right: int = 8, eps: float = 0.5,
    low_freq: float = float("inf"), clip: float | None = None, rho: float = 5e-4, min_dt: float = 0.25, step: float = 0.05,
) -> DataFrame:
    """(keys, idx, t, height, width, label): pulses of every series with the cluster they belong to, -1 for none.

    Peaks pair with troughs; pulses are split by width, then by height, then, around
    their peaks and around their troughs, by the shape of their snippets.  Of either
    labeling artefacts (too little power under ``low_freq``), unreliable clusters,
    side peaks and waves go; then both are merged.  Clipped clusters (mean beyond
    ``clip``), those that are not there when fewest sources are, and sparse ones
    go last.  ``samples(keys, idx, t, v)``.  A class of pulses of one series is
    one piece of work.  Steps are written to the shared folder, as each serves several;
    they join by shuffle, whatever their size, as small files may hold many rows.
    """
    with joins_by_shuffle(samples.sparkSession):
        spans = samples.groupBy(*keys).agg(F.min("idx").alias("first"), F.max("idx").alias("last"), (F.max("t") - F.min("t")).alias("_seconds"))
        spans = written(spans, "spans")
        found = V.detect_peaks(samples, threshold, keys, also=["t"])
        pulses = V.resolve_shared_troughs(V.assign_side_peaks(found, keys), keys)
        pulses = written(V.filter_pulses(pulses, rate, min_width, max_width).select(*keys, "idx", "trough_idx", "t", "height", "width"), "pulses")
        by_width = C.mixture_1d(pulses, keys, "idx", "width", 3, use_log=True, ratio=0.5).withColumnRenamed("label", "w")
        rows = written(pulses.join(by_width, [*keys, "idx"]), "widths")
        by_height = C.mixture_1d(rows, [*keys, "w"], "idx", "height", 10, use_log=True, ratio=0.1).withColumnRenamed("label", "h")
        rows = written(rows.join(by_height.drop("w"), [*keys, "idx"]), "classes")
        places = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(at).alias("at")) for side, at in enumerate(("idx", "trough_idx")))))
        places = rows.select(*keys, "idx", "t", "width", "w", "h", places.alias("s")).select(*keys, "idx", "t", "width", "w", "h", "s.*")
        places = written(places.where("at is not null"), "places")
        pieces = V.snippet_arrays(samples, places.select(*keys, F.col("at").alias("idx")), keys, left, right, spans).withColumnRenamed("event", "at")
        pieces = written(pieces.join(places, [*keys, "at"]), "pieces")
        own = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("name"))), F.lit(-1))
        both = _labelled(pieces, keys, rate, eps, low_freq).groupBy(*keys, "idx").agg(own(0).alias("peak_label"), own(1).alias("trough_label"))
        both = written(both, "labels")
        merged = C.merge_peak_trough_clusters(both, keys, "idx").withColumn("label", F.col("label").cast("long"))
        held = written(rows.join(merged, [*keys, "idx"]), "merged")
        if clip is not None:
            mean = _mean_snippets(pieces.where("side = 0").join(held.select(*keys, "idx", "label"), [*keys, "idx"]), [*keys, "label"])
            held = held.join(A.clipped_clusters(mean, [*keys, "label"], clip).where("clipped").select(*keys, "label"), [*keys, "label"], "left_anti")
        held = written(held.join(C.moving_sources(held, [*keys, "w"], min_dt, step), [*keys, "w", "label"], "left_semi"), "held")
        cover = held.groupBy(*keys, "label").agg((F.count(F.lit(1)) * F.median("width")).alias("_cover")).join(spans, list(keys))
        good = cover.where(F.col("_cover") >= rho * F.col("_seconds")).select(*keys, "label")
        kept = written(held.join(good, [*keys, "label"], "left_semi").select(*keys, "idx", "label"), "kept")
    return pulses.drop("trough_idx").join(kept.hint("merge"), [*keys, "idx"], "left").withColumn("label", F.coalesce("label", F.lit(-1)))


def _joined(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, list(keys), "left"), parts)


def analyze_pulse(waves: DataFrame, events: DataFrame, keys: Sequence[str], rate: float, *, clipped: DataFrame | None = None, peak_thr: float = 0.01, se_thr: float = 0.01) -> DataFrame:
    """One row of properties per pulse source: amplitudes, start and end, phases, intervals, spectrum and tail.

    ``waves(keys, pos, v)`` are mean waveforms, ``events(keys, t)`` the pulse times,
    ``clipped(keys, clipped)`` the share of clipped snippets, where known.  There is
    no fitted sum of Gaussians, so ``rmserror`` is null.
    """
    shaped = A.condition_pulse(waves, keys)
    arrays = shaped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"), F.first("noise").alias("noise"), F.first("flipped").alias("flipped"))
    arrays = arrays.select(*keys, "noise", "flipped", F.transform("s", lambda x: x["v"]).alias("v"))
    phases = H.pulse_phases(shaped, keys, 1 / rate, peak_thr)
    summary = phases.groupBy(*keys).agg(F.count(F.lit(1)).alias("nphases"), F.min("p").alias("firstphase"), F.max("p").alias("lastphase"))
    spectrum = S.pulse_spectrum(arrays, keys, rate)
    parts = [
        A.pulse_basic_properties(shaped, keys, 1 / rate),
        arrays.select(*keys, "flipped", "noise"),
        H.pulse_span(shaped, keys, 1 / rate, se_thr),
        summary,
        V.interval_stats(events, keys).select(*keys, "n", "EODf", F.col("median").alias("period"), F.col("std").alias("periodstd")),
        A.pulse_spectrum_properties(spectrum, keys, 1.0),
        S.tail_time_constant(arrays, keys, 1 / rate, F.col("noise") / 4 + 1e-12),
    ]
    out = _joined(parts + ([clipped.select(*keys, "clipped")] if clipped is not None else []), keys)
    unknown = {c: F.lit(None).cast("double") for c in ("clipped", "rmserror") if c not in out.columns}
    return out.withColumns(unknown)


def analyze_wave(waves: DataFrame, keys: Sequence[str], rate: float, freq: float, n: int = 10, *, group: DataFrame | None = None, clipped: DataFrame | None = None) -> DataFrame:
    """One row of properties per wave source: coefficients' summary, amplitudes over a period, phases, noise and fit error.

    ``waves(keys, pos, v[, sem])``; the fit is the synthesis of the n harmonics;
    noise is that of ``sem``.  ``group(keys, freq, power)`` are the peaks of the
    source's spectrum: their data power is summed, in decibel.
    """
    timed = waves.withColumn("t", F.col("pos") / rate)
    raw = A.fourier_coeffs(timed, keys, freq, n)
    coeffs = A.condition_wave(raw, keys)
    _, whole = A.wave_spectrum_properties(coeffs, keys)
    half = raw.withColumns({c: F.when(F.col("h") == 0, F.col(c) / 2).otherwise(F.col(c)) for c in ("re", "im")})
    fit = A.fourier_synthesis(half, timed.select(*keys, "t"), keys, freq).withColumnRenamed("v", "fit")
    phases = H.wave_phases(waves, keys, 1 / rate, freq).groupBy(*keys).agg(F.count(F.lit(1)).alias("nphases"), F.min("width").alias("minwidth"))
    basic = A.wave_basic_properties(timed.join(fit, [*keys, "t"]), keys, 1 / rate, freq, sem="sem" if "sem" in waves.columns else None, fit="fit")
    parts = [basic, whole, phases]
    if group is not None:
        base = coeffs.select(*keys, "h", F.lit(float(freq)).alias("f0"), F.hypot("re", "im").alias("amplitude"))
        parts.append(Q.match_harmonic_power(base, group, keys).groupBy(*keys).agg((10 * F.log10(F.sum("datapower"))).alias("datapower")))
    if clipped is not None:
        parts.append(clipped.select(*keys, "clipped"))
    out = _joined(parts, keys)
    return out.withColumns({c: F.lit(None).cast("double") for c in ("datapower", "clipped") if c not in out.columns})


def extract_wave(arrays: DataFrame, keys: Sequence[str], rate: float, freq: str, resolution: float = 0.5, min_corr: float = 0.99, max_harmonics: int = 5) -> DataFrame:
    """(keys, EODf, n, skip_reason, coeffs): refined frequency and mean coefficients of the stable segments of each series.

    ``arrays(keys, freq, v)``; a row is a short series and one of its fundamentals.
    Recordings of any length are for ``wave_segments.extract_waves``.
    """

    @F.pandas_udf("EODf double, n double, skip_reason string, re array<double>, im array<double>")
    def run(parts: pd.Series, freqs: pd.Series) -> pd.DataFrame:
        out = []
        for v, f in zip(parts, freqs):
            eodf, n, c, why = G.extract(np.asarray(v, float), rate, f, resolution, min_corr, max_harmonics)
            out.append((eodf, n, why, None if c is None else c.real, None if c is None else c.imag))
        return pd.DataFrame(out, columns=["EODf", "n", "skip_reason", "re", "im"])

    rows = arrays.select(*keys, run("v", freq).alias("r")).select(*keys, "r.*")
    return rows.select(*keys, "EODf", "n", "skip_reason", F.arrays_zip("re", "im").alias("coeffs"))


def stable_window(samples: DataFrame, keys: Sequence[str], rate: float, seconds: float, threshold: float, *, shift: float = 0.2, limits: tuple[float, float] = (float("-inf"), float("inf")), w_ampl: float = 10.0) -> DataFrame:
    """The samples of each series' most stable ``seconds``; of a series too short for the window, or without peaks, all."""
    end = samples.agg(F.max("t")).first()[0] or 0.0  # one number: windows are numbered alike in all series
    events = written(V.detect_peaks(samples, threshold, keys, also=["t"]), "events")  # read four times
    pairs = V.trim_events(events, keys, to_peak=True)
    time = lambda kind: events.where(F.col("kind") == kind).select(*keys, F.col("idx").alias(f"{kind}_idx"), F.col("t").alias(f"{kind}_t"))
    pairs = pairs.join(time("peak"), [*keys, "peak_idx"]).join(time("trough"), [*keys, "trough_idx"])
    if end <= seconds:
        return samples
    criteria = N.window_criteria(written(pairs, "pairs"), keys, 0.0, end, seconds, shift, *limits)
    best = N.best_window(criteria, keys, w_ampl=w_ampl).select(*keys, (F.col("first") * shift / 2).alias("begin"))
    bounds = N.analysis_window(samples, keys, rate, seconds, "best", best).withColumnsRenamed({"first": "_a", "last": "_z"})
    rows = samples.join(bounds, list(keys), "left")
    return rows.where("_a is null or idx >= _a and idx < _z").drop("_a", "_z")


def _block_psd(samples: DataFrame, keys: Sequence[str], rate: float, resolution: float, added: DataFrame | None = None) -> DataFrame:
    """(keys, freq, power): mean over blocks of each series, none of which is more than a few segments long."""
    nfft = K.nfft_for(rate, resolution)
    return S.psd(S.blocks(samples, keys, 4 * nfft, nfft // 2, part=32, added=added), [*keys, "block"], rate, resolution).groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def detect_sources(
    samples: DataFrame, keys: Sequence[str], rate: float, resolution: float, threshold: float, mode: str = "wp", limits: DataFrame | None = None, params: GroupParams = GroupParams(), *,
    window: float | None = None, clip: tuple[float, float] = (float("-inf"), float("inf")), pulses: dict | None = None, min_corr: float = 0.99, min_share: float = 0.01,
) -> DataFrame:
    """(keys, type, index, EODf, strength, ppampl, clipped, skip_reason): the sources of every series.

    With ``window``, the most stable stretch of so many seconds is analysed.  Wave
    sources are the harmonic groups of its mean spectrum, pulse sources its
    clusters of pulses.  Waves whose first harmonics lie under the spectrum of the
    pulse trains go, then those much smaller than the largest pulse.  A wave's
    waveform is taken from stable segments; where there are none its row says why
    and has no amplitude.  Rows are numbered pulses first, then by strength.
    """
    with joins_by_shuffle(samples.sparkSession):
        if window is not None:
            samples = written(stable_window(samples, keys, rate, window, threshold, limits=clip), "window")
        made = []
        groups = None
        if "w" in mode:
            groups = written(H.harmonic_groups(_block_psd(samples, keys, rate, resolution), keys, resolution, params, limits), "groups")
        if "p" in mode:
            found = written(extract_pulses(samples, keys, rate, threshold, **(pulses or {})).where("label >= 0"), "found")
            stats = V.interval_stats(found, [*keys, "label"]).select(*keys, "label", "EODf")
            height = found.groupBy(*keys, "label").agg(F.avg("height").alias("strength"))
            left, right = (pulses or {}).get("left", 8), (pulses or {}).get("right", 8)
            snips = V.snippet_arrays(samples, found, keys, left, right).join(found.select(*keys, F.col("idx").alias("event"), "label"), [*keys, "event"])
            snips = written(snips, "snips")  # read twice
            beyond = (F.array_max("v") >= clip[1]) | (F.array_min("v") <= clip[0])
            share = snips.groupBy(*keys, "label").agg(F.avg(beyond.cast("double")).alias("clipped"))
            rows = stats.join(height, [*keys, "label"]).join(share, [*keys, "label"], "left")
            made.append(rows.select(*keys, F.lit("pulse").alias("type"), "EODf", "strength", F.col("strength").alias("ppampl"), "clipped", F.lit("").alias("skip_reason")))
            if groups is not None:
                mean = _mean_snippets(snips, [*keys, "label"])
                train = S.pulse_train(found.select(*keys, "label", "idx"), mean, [*keys, "label"]).select(*keys, "idx", "v")
                none = samples.select(*keys, "idx", F.lit(0.0).alias("v"))  # series without pulses have no power, under which nothing lies
                bin_width = rate / K.nfft_for(rate, resolution)
                groups = written(A.drop_waves_below_pulses(groups, _block_psd(none, keys, rate, resolution, train), keys, bin_width), "groups")
        if groups is not None:
            waves = Q.fundamentals(groups, [*keys, "grp"]).select(*keys, "grp", "f", F.col("db").alias("strength"))
            shaped = G.extract_waves(samples, waves.withColumnRenamed("f", "freq"), keys, rate, resolution, min_corr)
            ampl = F.when(F.col("skip_reason") == "", 2 * F.array_max(F.transform("coeffs", lambda c: F.hypot(c["re"], c["im"]))))
            share = samples.groupBy(*keys).agg(F.avg(((F.col("v") <= clip[0]) | (F.col("v") >= clip[1])).cast("double")).alias("clipped"))
            rows = waves.join(shaped, [*keys, "grp"]).join(share, list(keys))
            made.append(rows.select(*keys, F.lit("wave").alias("type"), F.when(F.col("skip_reason") == "", F.col("EODf")).otherwise(F.col("f")).alias("EODf"), "strength", ampl.alias("ppampl"), "clipped", "skip_reason"))
        both = A.drop_weak_waves(reduce(DataFrame.unionByName, made), keys, "strength", "ppampl", share=min_share)
        both = written(both, "sources")
    return both.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy("type", F.desc("strength"), "EODf")) - 1)


def load_analysis(fish: DataFrame, waveforms: DataFrame, spectra: DataFrame, eodfs: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """The tables of an analysis put together.

    Returns fish with their mean waveform as an array, and the harmonics
    (recording, channel, index, h, freq, power): of fish with a spectrum those
    with finite data power, of frequencies without a waveform the first n
    multiples without power.  Where a recording has wave fish only, indices of
    its waveforms and spectra are shifted to begin with those of the fish.
    """
    keys = ["recording", "channel"]
    start = fish.groupBy(*keys).agg(F.min("index").alias("_first"), F.max((F.col("type") == "pulse").cast("int")).alias("_pulse"))
    least = waveforms.groupBy(*keys).agg(F.min("index").alias("_least"))
    shift = start.join(least, keys).select(*keys, F.when(F.col("_pulse") == 0, F.col("_first") - F.col("_least")).otherwise(0).alias("_d"))
    moved = lambda df: df.join(shift, keys, "left").withColumn("index", F.col("index") + F.coalesce("_d", F.lit(0))).drop("_d")
    waves = moved(waveforms).groupBy(*keys, "index").agg(F.array_sort(F.collect_list(F.struct("time", "mean", "sem"))).alias("waveform"))
    whole = fish.join(waves, [*keys, "index"], "left")
    known = moved(spectra).where("datapower is not null and not isnan(datapower)").select(*keys, "index", F.col("harmonics").alias("h"), F.col("frequency").alias("freq"), F.col("datapower").alias("power"))
    bare = eodfs.where("index is null").select(*keys, F.lit(None).cast("int").alias("index"), "EODf", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("h"))
    bare = bare.select(*keys, "index", "h", (F.col("h") * F.col("EODf")).alias("freq"), F.lit(None).cast("double").alias("power"))
    return whole, known.unionByName(bare)


def merge_fish(fish: DataFrame, *, max_noise: float = 0.1, max_dist: float = 2e-4, max_df: float = 10.0, max_rms: float = 0.3) -> DataFrame:
    """Repeated detections over files become one source: (type, source, id, representative).

    ``fish(id, type, EODf, ppdist, ppampl, noise, time, v)``.  Pulses in order of
    p-p distance, waves in order of EODf, each against the last kept one: close
    and alike joins it.  The largest p-p amplitude represents.  Rows are cut at
    gaps wider than the limit first, which no join can cross: gaps inside stretches
    of the key, and those between the stretches, of which there are few.  An island is
    passed over in order, batch by batch.
    """
    @F.pandas_udf("shape array<double>, mirrored array<double>")
    def shapes(kinds: pd.Series, times: pd.Series, values: pd.Series, freqs: pd.Series) -> pd.DataFrame:
        out = [(None, None) if kind == "pulse" or t is None or v is None or not len(t) else K.wave_shapes(np.array([t, v], float), f) for kind, t, v, f in zip(kinds, times, values, freqs)]
        return pd.DataFrame(out, columns=["shape", "mirrored"])

    rows = fish.where(F.col("noise") <= max_noise).withColumn("_s", shapes("type", "time", "v", "EODf"))  # the costly part, before rows of an island meet
    rows = rows.withColumn("key", F.when(F.col("type") == "pulse", F.col("ppdist")).otherwise(F.col("EODf")))
    limit = F.when(F.col("type") == "pulse", max_dist).otherwise(max_df)
    rows = rows.withColumn("_b", F.floor(F.col("key") / (50 * limit)))
    w, over = W.partitionBy("type", "_b").orderBy("key", "id"), W.partitionBy("type").orderBy("_b")
    rows = rows.withColumn("_new", F.coalesce((F.col("key") - F.lag("key").over(w) > limit).cast("int"), F.lit(0))).withColumn("_own", F.sum("_new").over(w))
    ends = rows.groupBy("type", "_b").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.sum("_new").alias("_cuts"))
    apart = F.coalesce((F.col("_lo") - F.lag("_hi").over(over) > limit).cast("int"), F.lit(1))
    ends = ends.withColumn("_first", apart).withColumn("_base", F.sum(F.col("_first")).over(over) + F.coalesce(F.sum("_cuts").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(ends.select("type", "_b", "_base"), ["type", "_b"]).withColumn("_island", F.col("_base") + F.col("_own")).drop("_new", "_own", "_base", "_b")

    class Chain:
        kept, part = None, -1

        def add(self, r) -> int:
            own = np.array([r.time, r.v], float)
            if self.kept is not None:
                key, last, freq, shape = self.kept
                if r.type == "pulse":
                    alike = r.key - key <= max_dist and not K.pulse_similarity(last, own, 4.0) >= max_rms
                else:
                    rms = lambda: K.shapes_difference(shape, r.shape, r.mirrored) if shape is not None and r.shape is not None and len(shape) == len(r.shape) else K.wave_similarity(last, own, freq, r.EODf)
                    alike = r.key - key < max_df and not rms() >= max_rms
                if alike:
                    return self.part
            self.kept, self.part = (r.key, own, r.EODf, r.shape), self.part + 1
            return self.part

    more = lambda held, pdf: [(r.id, r.ppampl, held.add(r)) for r in pdf.itertuples()]
    kinds = dict(fish.dtypes)
    rows = rows.select("type", "_island", "key", "id", "ppampl", "EODf", "time", "v", "_s.shape", "_s.mirrored").repartition("type", "_island")
    made = each_stretch(rows, ["type", "_island"], [F.asc_nulls_last("key"), F.asc_nulls_last("id")], f"id {kinds['id']}, ppampl double, part int", Chain, more, lambda held: [])
    best = F.first("id").over(W.partitionBy("type", "_island", "part").orderBy(F.desc("ppampl"), "id"))
    return made.select("type", F.concat_ws("-", "type", "_island", "part").alias("source"), "id", (best == F.col("id")).alias("representative"))
