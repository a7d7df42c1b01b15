"""Mean waveforms and what describes them: averages, conditioning, coefficients, spectra, phases."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAU = 2 * math.pi


# ---------------------------------------------------------------- averages
def mean_waveform(snips: DataFrame, keys: Sequence[str], ddof: int = 1) -> DataFrame:
    """(keys, pos, mean, sem, n) over the snippets of a source."""
    std = F.stddev_samp("v") if ddof else F.stddev_pop("v")
    return snips.groupBy(*keys, "pos").agg(F.avg("v").alias("mean"), (std / F.sqrt(F.count("v"))).alias("sem"), F.count("v").alias("n"))


def min_sem_count(snips: DataFrame, keys: Sequence[str], step: int = 10, event: str = "event") -> DataFrame:
    """(keys, n): how many leading snippets give the smallest mean s.e.m., where that is a true minimum inside; else all.

    Candidates are multiples of ``step``.
    """
    w = W.partitionBy(*keys, "pos").orderBy(event).rowsBetween(W.unboundedPreceding, 0)
    rows = snips.withColumn("k", F.row_number().over(W.partitionBy(*keys, "pos").orderBy(event))).withColumn("sem", F.stddev_samp("v").over(w) / F.sqrt(F.col("k")))
    each = rows.where(F.col("k") % step == 0).groupBy(*keys, "k").agg(F.avg("sem").alias("sem"))
    total = snips.groupBy(*keys).agg(F.count_distinct(event).alias("all"))
    best = each.groupBy(*keys).agg(F.min(F.struct("sem", "k")).alias("b"), F.min("k").alias("a"), F.max("k").alias("z")).join(total, list(keys), "right")
    inside = (F.col("b.k") > F.col("a")) & (F.col("b.k") < F.col("z"))
    return best.select(*keys, F.when(inside, F.col("b.k").cast("long")).otherwise(F.col("all")).alias("n"))


# ---------------------------------------------------------------- samples and waveforms
def unwrap_clipped(samples: DataFrame, keys: Sequence[str], thresh: float = 1.5, ampl_max: float = 1.0) -> DataFrame:
    """Undoes wrap-around: after a jump of more than ``thresh`` down (up) the signal is lifted (lowered) by twice ``ampl_max`` until it jumps back."""
    w = W.partitionBy(*keys).orderBy("idx")
    jump = F.col("v") - F.lag("v").over(w)
    turn = F.when(jump < -thresh, 1).when(jump > thresh, -1).otherwise(0)
    rows = samples.withColumn("_turn", F.coalesce(turn, F.lit(0)))
    return rows.withColumn("v", F.col("v") + 2 * ampl_max * F.sum("_turn").over(w)).drop("_turn")


def subtract_slope(snips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Removes the line from the first to the last sample; ``slope_ratio`` is its rise over the height of what is left."""
    w = W.partitionBy(*keys)
    first, last = F.min_by("v", "pos").over(w), F.max_by("v", "pos").over(w)
    a, z = F.min("pos").over(w), F.max("pos").over(w)
    rows = snips.withColumn("_d", last - first).withColumn("v", F.col("v") - first - (last - first) * (F.col("pos") - a) / (z - a))
    return rows.withColumn("slope_ratio", F.abs(F.col("_d")) / (F.max("v").over(w) - F.min("v").over(w))).drop("_d")


def normalize_waveform(waves: DataFrame, keys: Sequence[str], time: str | None = None, freq: str | None = None) -> DataFrame:
    """Divides by the maximum; with a frequency the time axis is in periods."""
    rows = waves.withColumn("v", F.col("v") / F.max("v").over(W.partitionBy(*keys)))
    return rows.withColumn(time, F.col(time) * F.col(freq)) if time and freq else rows


def waveform_derivatives(waves: DataFrame, keys: Sequence[str], dt: float = 1.0) -> DataFrame:
    """Adds d1 and d2: slope and curvature of the parabola through five samples, plain differences where there are fewer."""
    w = W.partitionBy(*keys).orderBy("pos")
    at = {k: F.lead("v", k).over(w) if k else F.col("v") for k in range(-2, 3)}
    d1 = (2 * at[2] + at[1] - at[-1] - 2 * at[-2]) / (10 * dt)
    d2 = (2 * at[2] - at[1] - 2 * at[0] - at[-1] + 2 * at[-2]) / (7 * dt * dt)
    plain = F.coalesce((at[1] - at[-1]) / (2 * dt), (at[1] - at[0]) / dt, (at[0] - at[-1]) / dt)
    return waves.withColumn("d1", F.coalesce(d1, plain)).withColumn("d2", F.coalesce(d2, (at[1] - 2 * at[0] + at[-1]) / (dt * dt)))


def condition_pulse(waves: DataFrame, keys: Sequence[str], *, flip: str = "auto", edge: float = 0.05, least: int = 5) -> DataFrame:
    """Baseline (mean of the first samples) to zero, the larger half-wave up, its maximum at pos 0.

    ``flip`` is auto, none or flip.  Adds ``flipped`` and ``noise``: twice the range of
    the baseline, at most half of the maximum.
    """
    w = W.partitionBy(*keys)
    n = F.greatest(F.lit(least), F.floor(F.count(F.lit(1)).over(w) * edge))
    rank = F.row_number().over(w.orderBy("pos"))
    rows = waves.withColumn("_n", n).withColumn("_r", rank)
    base = F.when(F.col("_r") <= F.col("_n"), F.col("v"))
    rows = rows.withColumn("v", F.col("v") - F.avg(base).over(w))
    base = F.when(F.col("_r") <= F.col("_n"), F.col("v"))
    down = {"auto": -F.min("v").over(w) > F.max("v").over(w), "none": F.lit(False), "flip": F.lit(True)}[flip]
    rows = rows.withColumn("flipped", down).withColumn("noise", 2 * (F.max(base).over(w) - F.min(base).over(w)))
    rows = rows.withColumn("v", F.when(F.col("flipped"), -F.col("v")).otherwise(F.col("v")))
    rows = rows.withColumn("noise", F.least("noise", F.max("v").over(w) / 2))
    top = F.min(F.when(F.col("v") == F.col("_max"), F.col("pos"))).over(w)
    return rows.withColumn("_max", F.max("v").over(w)).withColumn("pos", F.col("pos") - top).drop("_n", "_r", "_max")


def pulse_basic_properties(waves: DataFrame, keys: Sequence[str], dt: float, noise: float = 0.0) -> DataFrame:
    """Amplitudes, distances, area, polarity balance and the median and quartile times of a conditioned pulse waveform."""
    v, t = F.col("v"), F.col("pos") * dt
    w = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = waves.withColumn("_t", t).withColumn("_c", F.sum(F.abs(v)).over(w)).withColumn("_all", F.sum(F.abs(v)).over(W.partitionBy(*keys)))
    when = lambda q: F.min(F.when(F.col("_c") > q * F.col("_all"), F.col("_t")))
    pos, neg = F.greatest(F.max("v"), F.lit(0.0)), F.greatest(-F.min("v"), F.lit(0.0))
    out = rows.groupBy(*keys).agg(
        F.when(pos > noise, pos).otherwise(0.0).alias("pos_ampl"),
        F.when(neg > noise, neg).otherwise(0.0).alias("neg_ampl"),
        F.min(F.struct((-v).alias("x"), t.alias("y"))).alias("_top"),
        F.min(F.struct(v.alias("x"), t.alias("y"))).alias("_low"),
        (F.sum(F.abs(v)) * dt).alias("total_area"),
        (F.sum(F.greatest(v, F.lit(0.0))) * dt).alias("_up"),
        (F.sum(F.greatest(-v, F.lit(0.0))) * dt).alias("_down"),
        when(0.5).alias("median"),
        when(0.25).alias("quartile1"),
        when(0.75).alias("quartile3"),
    )
    big = F.greatest("pos_ampl", "neg_ampl")
    return out.select(
        *keys, "pos_ampl", "neg_ampl", (F.col("pos_ampl") + F.col("neg_ampl")).alias("ppampl"), (big / (F.col("pos_ampl") + F.col("neg_ampl"))).alias("relmaxampl"), (F.col("_low.y") - F.col("_top.y")).alias("ppdist"),
        "total_area", ((F.col("_up") - F.col("_down")) / F.col("total_area")).alias("polaritybalance"), "median", "quartile1", "quartile3", (F.col("quartile3") - F.col("quartile1")).alias("iqrange"),
    )


def wave_basic_properties(waves: DataFrame, keys: Sequence[str], dt: float, freq: float, sem: str | None = None, fit: str | None = None) -> DataFrame:
    """Over one period from time 0: p-p amplitude, relative maximum, p-p distance and its shorter side, noise and fit error relative to p-p."""
    v, t = F.col("v"), F.col("pos") * dt
    rows = waves.where((t >= 0) & (t < 1 / freq)).withColumn("_t", t)
    aggs = [F.max("v").alias("_hi"), F.min("v").alias("_lo"), F.min(F.struct((-v).alias("x"), F.col("_t").alias("y"))).alias("_top"), F.min(F.struct(v.alias("x"), F.col("_t").alias("y"))).alias("_low")]
    for name, c in (("noise", F.col(sem) if sem else None), ("rmserror", v - F.col(fit) if fit else None)):
        aggs.append((F.sqrt(F.avg(c * c)) if c is not None else F.lit(None).cast("double")).alias(name))
    out = rows.groupBy(*keys).agg(*aggs)
    pp, dist = F.col("_hi") - F.col("_lo"), F.col("_low.y") - F.col("_top.y")
    return out.select(*keys, pp.alias("ppampl"), (F.greatest(F.abs("_hi"), F.abs("_lo")) / pp).alias("relmaxampl"), dist.alias("ppdist"), F.least(F.abs(dist), 1 / freq - F.abs(dist)).alias("minppdist"), (F.col("noise") / pp).alias("noise"), (F.col("rmserror") / pp).alias("rmserror"))


# ---------------------------------------------------------------- Fourier coefficients
def fourier_coeffs(samples: DataFrame, keys: Sequence[str], freq: Column | float, n: int, time: str = "t", v: str = "v") -> DataFrame:
    """(keys, h, re, im) for h = 0..n: 2/T times the integral of v exp(-2 pi i h f t), by the trapezoidal rule on even samples."""
    w = W.partitionBy(*keys)
    rows = samples.withColumn("_a", F.min(time).over(w)).withColumn("_z", F.max(time).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    half = F.when((F.col(time) == F.col("_a")) | (F.col(time) == F.col("_z")), 0.5).otherwise(1.0)
    rows = rows.withColumn("_x", F.col(v) * half * 2 / (F.col("_n") - 1)).withColumn("_f", F.lit(freq) if isinstance(freq, (int, float)) else freq)
    arg = lambda h: TAU * h * F.col("_f") * F.col(time)
    sums = [f(F.col("_x") * g(arg(h)) * s).alias(f"{p}{h}") for h in range(n + 1) for f, g, s, p in ((F.sum, F.cos, 1, "re"), (F.sum, F.sin, -1, "im"))]
    wide = rows.groupBy(*keys).agg(*sums)
    each = F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"re{h}").alias("re"), F.col(f"im{h}").alias("im")) for h in range(n + 1)))
    return wide.select(*keys, F.explode(each).alias("c")).select(*keys, "c.*")


def normalize_coeffs(coeffs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turns the phase of the fundamental to zero and drops the offset: c_h exp(-i h phi_1)."""
    phi = F.max(F.when(F.col("h") == 1, F.atan2("im", "re"))).over(W.partitionBy(*keys))
    rows = coeffs.withColumn("_p", -F.col("h") * phi)
    re = F.col("re") * F.cos("_p") - F.col("im") * F.sin("_p")
    im = F.col("re") * F.sin("_p") + F.col("im") * F.cos("_p")
    return rows.select(*keys, "h", re.alias("_re"), im.alias("_im")).where("h > 0").withColumnsRenamed({"_re": "re", "_im": "im"})


def fourier_synthesis(coeffs: DataFrame, times: DataFrame, keys: Sequence[str], freq: float, time: str = "t") -> DataFrame:
    """(keys, time, v): real part of the sum of c_h exp(2 pi i h f t); ``times(keys, time)``."""
    arg = TAU * F.col("h") * freq * F.col(time)
    met = times.join(coeffs, list(keys))
    return met.groupBy(*keys, time).agg(F.sum(F.col("re") * F.cos(arg) - F.col("im") * F.sin(arg)).alias("v"))


def condition_wave(coeffs: DataFrame, keys: Sequence[str], flip: bool = False) -> DataFrame:
    """Flips if asked for, and puts time zero at the maximum of the fundamental."""
    sign = -1.0 if flip else 1.0
    return normalize_coeffs(coeffs.withColumn("re", sign * F.col("re")).withColumn("im", sign * F.col("im")), keys)


def unfilter(samples: DataFrame, keys: Sequence[str], rate: float, cutoff: float) -> DataFrame:
    """Inverse of a first-order high-pass: v_k = d_k + (d_0 + sum of d_j for j < k) / (tau rate), d the signal without its mean."""
    tau = 1 / (TAU * cutoff)
    w = W.partitionBy(*keys).orderBy("idx")
    rows = samples.withColumn("_d", F.col("v") - F.avg("v").over(W.partitionBy(*keys)))
    before = F.coalesce(F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    first = F.first("_d").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("v", F.col("_d") + (first + before) / (tau * rate)).drop("_d")


def unfilter_coeffs(coeffs: DataFrame, keys: Sequence[str], freq: float, cutoff: float) -> DataFrame:
    """Inverse of a first-order high-pass on coefficients: times 1 - i fc / (h f); the offset goes, phases are normalised."""
    k = F.lit(cutoff) / (F.col("h") * freq)
    rows = coeffs.where("h > 0").withColumn("_re", F.col("re") + k * F.col("im")).withColumn("_im", F.col("im") - k * F.col("re"))
    return normalize_coeffs(rows.select(*keys, "h", F.col("_re").alias("re"), F.col("_im").alias("im")), keys)


def wave_spectrum_properties(coeffs: DataFrame, keys: Sequence[str], thd_mode: str = "rms") -> tuple[DataFrame, DataFrame]:
    """Per harmonic: amplitude, relampl, relpower, phase; per source: power, thd, maxharmonics, dbdiff, phaseslope (first 8)."""
    w = W.partitionBy(*keys)
    rows = coeffs.where("h > 0").withColumn("amplitude", F.hypot("re", "im")).withColumn("phase", F.atan2("im", "re"))
    rows = rows.withColumn("relampl", F.col("amplitude") / F.max(F.when(F.col("h") == 1, F.col("amplitude"))).over(w)).withColumn("relpower", 20 * F.log10("relampl"))
    o = w.orderBy("h")
    step = F.col("phase") - F.lag("phase").over(o)
    rows = rows.withColumn("_u", F.coalesce(-F.round(step / TAU), F.lit(0.0))).withColumn("_d", F.col("relpower") - F.lag("relpower").over(o))
    rows = rows.withColumn("_p", F.col("phase") + TAU * F.sum("_u").over(o))
    over = F.when(F.col("h") > 1, F.col("relampl"))
    thd = F.sqrt(F.sum(over * over)) if thd_mode == "rms" else F.sum(over)
    first = F.when(F.col("h") <= 8, F.col("_p"))
    whole = rows.groupBy(*keys).agg(
        (10 * F.log10(F.sum(F.col("amplitude") * F.col("amplitude")))).alias("power"), F.coalesce(thd, F.lit(0.0)).alias("thd"), F.max_by("h", F.struct("amplitude", -F.col("h"))).alias("maxharmonics"),
        F.stddev_pop("_d").alias("dbdiff"), F.regr_slope(first, F.col("h").cast("double")).alias("phaseslope"),
    )
    return rows.select(*keys, "h", "amplitude", "relampl", "relpower", "phase"), whole


def align_snippets(snips: DataFrame, keys: Sequence[str], event: str = "event") -> DataFrame:
    """Shifts every snippet, circularly, by the phase of its first coefficient relative to the mean phase vector of its source."""
    w = W.partitionBy(*keys, event)
    n, first = F.count(F.lit(1)).over(w), F.min("pos").over(w)
    rows = snips.withColumn("_n", n).withColumn("_k", F.col("pos") - first).withColumn("_first", first)
    arg = TAU * F.col("_k") / F.col("_n")
    phase = rows.groupBy(*keys, event).agg(F.atan2(-F.sum(F.col("v") * F.sin(arg)), F.sum(F.col("v") * F.cos(arg))).alias("_p"))
    mean = phase.groupBy(*keys).agg(F.atan2(F.avg(F.sin("_p")), F.avg(F.cos("_p"))).alias("_m"))
    rows = rows.join(phase.join(mean, list(keys)), [*keys, event])
    shift = F.round((F.col("_p") - F.col("_m")) / TAU * F.col("_n"))
    return rows.withColumn("pos", (F.col("_first") + F.pmod(F.col("_k") + shift, F.col("_n"))).cast("long")).drop("_n", "_k", "_first", "_p", "_m")


# ---------------------------------------------------------------- spectra of pulses, clusters, sources
def pulse_spectrum_properties(spectrum: DataFrame, keys: Sequence[str], eodf: float) -> DataFrame:
    """Peak, trough before it, energy at the EOD frequency, attenuation at low frequencies, and the half-energy band.

    ``spectrum(keys, freq, energy)``; attenuations are in decibel below the peak.
    """
    peak = F.max(F.struct("energy", (-F.col("freq")).alias("back"))).over(W.partitionBy(*keys))
    rows = spectrum.withColumn("_pe", peak["energy"]).withColumn("_pf", -peak["back"])
    low = F.min(F.when(F.col("freq") < F.col("_pf"), F.struct("energy", "freq")))
    db = lambda c: 10 * F.log10(c / F.max("_pe"))
    below = lambda f: db(F.avg(F.when(F.col("freq") < f, F.col("energy"))))
    half = F.col("energy") >= F.col("_pe") / 2
    out = rows.groupBy(*keys).agg(
        F.max("_pf").alias("peakfreq"), F.max("_pe").alias("peakenergy"), low.alias("_low"), F.min(F.struct(F.abs(F.col("freq") - eodf).alias("d"), F.col("energy").alias("e"))).alias("_at"),
        below(5.0).alias("energyatt5"), below(50.0).alias("energyatt50"), F.min(F.when(half, F.col("freq"))).alias("lowcutoff"), F.max(F.when(half, F.col("freq"))).alias("highcutoff"),
    )
    return out.select(*keys, "peakfreq", "peakenergy", F.col("_low.freq").alias("troughfreq"), F.col("_low.energy").alias("troughenergy"), F.col("_at.e").alias("eodfenergy"), "energyatt5", "energyatt50", "lowcutoff", "highcutoff")


def mean_power(spectra: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Mean of the spectra of windows ``first`` to ``last``; ``spectra(keys, win, freq, power)``."""
    return spectra.where(F.col("win").between(first, last)).groupBy(*keys, "freq").agg(F.avg("power").alias("power"))


def clipped_clusters(waves: DataFrame, keys: Sequence[str], limit: float = 0.9, fac: float = 8.0) -> DataFrame:
    """(keys, clipped): clusters whose mean waveform has more than n / (2 fac) samples beyond the limit."""
    out = waves.groupBy(*keys).agg(F.count_if(F.abs("v") > limit).alias("_c"), F.count(F.lit(1)).alias("_n"))
    return out.select(*keys, (F.col("_c") > F.col("_n") / (2 * fac)).alias("clipped"))


def drop_weak_waves(fish: DataFrame, keys: Sequence[str], power: str = "power", ampl: str = "ppampl", kind: str = "type", share: float = 0.01) -> DataFrame:
    """In order of power, from the first wave under ``share`` of the largest pulse on, all waves go."""
    largest = F.max(F.when(F.col(kind) == "pulse", F.col(ampl))).over(W.partitionBy(*keys))
    rows = fish.withColumn("_weak", ((F.col(kind) == "wave") & (F.col(ampl) < share * largest)).cast("int"))
    w = W.partitionBy(*keys, kind).orderBy(F.desc(power), F.desc(ampl)).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_gone", F.coalesce(F.max("_weak").over(w), F.lit(0))).where("_gone = 0").drop("_weak", "_gone")


def drop_waves_below_pulses(harmonics: DataFrame, pulses: DataFrame, keys: Sequence[str], df: float, factor: float = 5.0) -> DataFrame:
    """Groups go of whose first three harmonics one lies, at some shift of -2..2 bins, under the summed power of the pulse trains.

    ``harmonics(keys, grp, h, freq, power)``, ``pulses(keys, freq, power)``; the rows
    of ``harmonics`` that stay are returned.
    """
    bins = pulses.groupBy(*keys, F.round(F.col("freq") / df).alias("bin")).agg((factor * F.sum("power")).alias("limit"))
    first = harmonics.where("h <= 3").withColumn("shift", F.explode(F.array(*map(F.lit, range(-2, 3)))))
    met = first.withColumn("bin", F.round(F.col("freq") / df) + F.col("shift")).join(bins, [*keys, "bin"])
    gone = met.where("power < limit").select(*keys, "grp").distinct()
    return harmonics.join(gone, [*keys, "grp"], "left_anti")
