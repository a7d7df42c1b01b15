"""Waveform queries: embeddings are waveforms, their positions the samples, their labels the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwave.operators import waveforms as A

from .bind import SAMPLES, WAVES, r6, samples, waveforms

_K = ["id"]


def _set(spark, sf_dir):
    """Waveforms of a label as its snippets."""
    return waveforms(spark, sf_dir).withColumnRenamed("id", "event")


def mean(spark, sf_dir):
    return A.mean_waveform(_set(spark, sf_dir), ["label"]).select("label", "pos", r6("mean").alias("mean"), r6("sem").alias("sem"), "n")


def sem_count(spark, sf_dir):
    return A.min_sem_count(_set(spark, sf_dir), ["label"], 5)


def unwrapped(spark, sf_dir):
    return A.unwrap_clipped(samples(spark, sf_dir), ["channel"], 60.0, 50.0).select("channel", "idx", r6("v").alias("v"))


def slopes(spark, sf_dir):
    return A.subtract_slope(waveforms(spark, sf_dir), _K).select("id", "pos", r6("v").alias("v"), r6("slope_ratio").alias("slope_ratio"))


def normalized(spark, sf_dir):
    return A.normalize_waveform(waveforms(spark, sf_dir), _K).select("id", "pos", r6("v").alias("v"))


def derivatives(spark, sf_dir):
    return A.waveform_derivatives(waveforms(spark, sf_dir), _K).select("id", "pos", r6("d1").alias("d1"), r6("d2").alias("d2"))


def conditioned(spark, sf_dir):
    return A.condition_pulse(waveforms(spark, sf_dir), _K).select("id", "pos", r6("v").alias("v"), "flipped", r6("noise").alias("noise"))


_PULSE = ["pos_ampl", "neg_ampl", "ppampl", "relmaxampl", "ppdist", "total_area", "polaritybalance", "median", "quartile1", "quartile3", "iqrange"]


def pulse_properties(spark, sf_dir):
    return A.pulse_basic_properties(waveforms(spark, sf_dir), _K, 1 / 64, 0.05).select("id", *(r6(c).alias(c) for c in _PULSE))


def wave_properties(spark, sf_dir):
    out = A.wave_basic_properties(waveforms(spark, sf_dir).withColumn("fit", F.col("v") * 0.9), _K, 1 / 64, 2.0, fit="fit")
    return out.select("id", *(r6(c).alias(c) for c in ("ppampl", "relmaxampl", "ppdist", "minppdist", "rmserror")))


def _coeffs(spark, sf_dir):
    return A.fourier_coeffs(waveforms(spark, sf_dir).withColumn("t", F.col("pos") / 64), _K, 2.0, 4)


def coeffs(spark, sf_dir):
    return _coeffs(spark, sf_dir).select("id", "h", r6("re").alias("re"), r6("im").alias("im"))


def synthesis(spark, sf_dir):
    times = waveforms(spark, sf_dir).select("id", (F.col("pos") / 64).alias("t"))
    return A.fourier_synthesis(_coeffs(spark, sf_dir), times, _K, 2.0).select("id", "t", r6("v").alias("v"))


def conditioned_wave(spark, sf_dir):
    return A.condition_wave(_coeffs(spark, sf_dir), _K, True).select("id", "h", r6("re").alias("re"), r6("im").alias("im"))


def unfiltered(spark, sf_dir):
    return A.unfilter(samples(spark, sf_dir), ["channel"], 1000.0, 10.0).select("channel", "idx", F.round("v", 5).alias("v"))


def unfiltered_coeffs(spark, sf_dir):
    return A.unfilter_coeffs(_coeffs(spark, sf_dir), _K, 2.0, 1.0).select("id", "h", r6("re").alias("re"), r6("im").alias("im"))


def harmonic_spectrum(spark, sf_dir):
    each, _ = A.wave_spectrum_properties(_coeffs(spark, sf_dir), _K)
    return each.select("id", "h", *(r6(c).alias(c) for c in ("amplitude", "relampl", "relpower", "phase")))


def spectrum_summary(spark, sf_dir):
    _, whole = A.wave_spectrum_properties(_coeffs(spark, sf_dir), _K)
    return whole.select("id", "maxharmonics", *(r6(c).alias(c) for c in ("power", "thd", "dbdiff", "phaseslope")))


def aligned(spark, sf_dir):
    return A.align_snippets(_set(spark, sf_dir), ["label"]).select("label", "event", "pos", r6("v").alias("v"))


def _spectrum(spark, sf_dir):
    return waveforms(spark, sf_dir).select("id", (F.col("pos") * 2.0).alias("freq"), (F.col("v") * F.col("v") + 1e-6).alias("energy"))


_PS = ["peakfreq", "peakenergy", "troughfreq", "troughenergy", "eodfenergy", "energyatt5", "energyatt50", "lowcutoff", "highcutoff"]


def pulse_spectrum(spark, sf_dir):
    return A.pulse_spectrum_properties(_spectrum(spark, sf_dir), _K, 30.5).select("id", *(r6(c).alias(c) for c in _PS))


def mean_power(spark, sf_dir):
    rows = waveforms(spark, sf_dir).select("label", F.col("id").alias("win"), F.col("pos").alias("freq"), (F.col("v") * F.col("v")).alias("power"))
    return A.mean_power(rows, ["label"], 10, 200).select("label", "freq", F.round("power", 9).alias("power"))


def clipped(spark, sf_dir):
    return A.clipped_clusters(waveforms(spark, sf_dir), _K, 0.2)


def weak_waves(spark, sf_dir):
    kind = F.when(F.col("id") % 4 == 0, "pulse").otherwise("wave")
    rows = waveforms(spark, sf_dir).groupBy("label", "id").agg(F.max("v").alias("ppampl"), F.sum(F.col("v") * F.col("v")).alias("p")).withColumn("type", kind).withColumn("power", (F.col("id") * 37 % 101).cast("double"))
    return A.drop_weak_waves(rows, ["label"], share=0.5).select("label", "id", "type")


def below_pulses(spark, sf_dir):
    rows = waveforms(spark, sf_dir)
    harm = rows.where("pos < 5").select("label", F.col("id").alias("grp"), (F.col("pos") + 1).alias("h"), F.col("pos").cast("double").alias("freq"), (F.col("v") * F.col("v")).alias("power"))
    pulses = rows.where("pos < 8").select("label", (F.col("pos") + 3.0).alias("freq"), F.lit(1e-6).alias("power"))
    return A.drop_waves_below_pulses(harm, pulses, ["label"], 1.0).select("label", "grp", "h")


_CO = f"""{WAVES}, x AS (SELECT id, pos / 64.0::DOUBLE AS t, v * CASE WHEN pos IN (0, 63) THEN 0.5 ELSE 1 END * 2 / 63 AS x FROM w),
co AS (SELECT id, h, sum(x * cos(2 * pi() * h * 2 * t)) AS re, -sum(x * sin(2 * pi() * h * 2 * t)) AS im FROM x, range(5) r(h) GROUP BY ALL)"""
_NORM = """ph AS (SELECT id, max(atan2(im, re)) FILTER (h = 1) AS phi FROM {0} GROUP BY id),
nm AS (SELECT id, h, re * cos(-h * phi) - im * sin(-h * phi) AS re, re * sin(-h * phi) + im * cos(-h * phi) AS im FROM {0} JOIN ph USING (id) WHERE h > 0)"""
_SPEC = f"""{_CO}, a AS (SELECT id, h, sqrt(re * re + im * im) AS amplitude, atan2(im, re) AS phase FROM co WHERE h > 0),
b AS (SELECT *, amplitude / max(CASE WHEN h = 1 THEN amplitude END) OVER (PARTITION BY id) AS relampl FROM a),
c AS (SELECT *, 20 * log10(relampl) AS relpower, coalesce(-round((phase - lag(phase) OVER (PARTITION BY id ORDER BY h)) / (2 * pi())), 0) AS u FROM b),
d AS (SELECT *, relpower - lag(relpower) OVER (PARTITION BY id ORDER BY h) AS dd, phase + 2 * pi() * sum(u) OVER (PARTITION BY id ORDER BY h) AS up FROM c)"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


QUERIES = {
    "a7_mean_waveform": mean,
    "a8_min_sem_count": sem_count,
    "p10_unwrap_clipped": unwrapped,
    "p11_subtract_slope": slopes,
    "p12_normalize_waveform": normalized,
    "w18_derivatives": derivatives,
    "w19_condition_pulse": conditioned,
    "a11_pulse_properties": pulse_properties,
    "a12_wave_properties": wave_properties,
    "m4_fourier_coeffs": coeffs,
    "m4_fourier_synthesis": synthesis,
    "m6_condition_wave": conditioned_wave,
    "m7_unfilter": unfiltered,
    "m8_unfilter_coeffs": unfiltered_coeffs,
    "a13_harmonic_spectrum": harmonic_spectrum,
    "a13_spectrum_summary": spectrum_summary,
    "m12_align_snippets": aligned,
    "a14_pulse_spectrum": pulse_spectrum,
    "a22_mean_power": mean_power,
    "a21_clipped_clusters": clipped,
    "j17_weak_waves": weak_waves,
    "j16_waves_below_pulses": below_pulses,
}
SQL = {
    "a7_mean_waveform": f"WITH {WAVES} SELECT label, pos::INT AS pos, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem, count(v) AS n FROM w GROUP BY label, pos",
    "a8_min_sem_count": f"""WITH {WAVES}, k AS (SELECT label, row_number() OVER o AS k, stddev_samp(v) OVER (PARTITION BY label, pos ORDER BY id ROWS UNBOUNDED PRECEDING) / sqrt(row_number() OVER o) AS sem FROM w WINDOW o AS (PARTITION BY label, pos ORDER BY id)),
e AS (SELECT label, k, avg(sem) AS sem FROM k WHERE k % 5 = 0 GROUP BY ALL), n AS (SELECT label, count(DISTINCT id) AS n FROM w GROUP BY label),
b AS (SELECT label, arg_min(k, sem) AS k, min(k) AS a, max(k) AS z FROM e GROUP BY label) SELECT label, CASE WHEN k > a AND k < z THEN k ELSE n END AS n FROM n LEFT JOIN b USING (label)""",
    "p10_unwrap_clipped": f"""WITH {SAMPLES}, j AS (SELECT *, v - lag(v) OVER (PARTITION BY channel ORDER BY idx) AS j FROM s)
SELECT channel, idx::INT AS idx, round(v + 100 * sum(CASE WHEN j < -60 THEN 1 WHEN j > 60 THEN -1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY idx), 6) AS v FROM j""",
    "p11_subtract_slope": f"""WITH {WAVES}, e AS (SELECT id, arg_min(v, pos) AS a, arg_max(v, pos) AS z FROM w GROUP BY id), x AS (SELECT id, pos, v - a - (z - a) * pos / 63 AS v, z - a AS d FROM w JOIN e USING (id))
SELECT id, pos::INT AS pos, round(v, 6) AS v, round(abs(d) / (max(v) OVER (PARTITION BY id) - min(v) OVER (PARTITION BY id)), 6) AS slope_ratio FROM x""",
    "p12_normalize_waveform": f"WITH {WAVES} SELECT id, pos::INT AS pos, round(v / max(v) OVER (PARTITION BY id), 6) AS v FROM w",
    "w18_derivatives": f"""WITH {WAVES}, n AS (SELECT *, lag(v, 2) OVER o AS a, lag(v) OVER o AS b, lead(v) OVER o AS d, lead(v, 2) OVER o AS e FROM w WINDOW o AS (PARTITION BY id ORDER BY pos))
SELECT id, pos::INT AS pos, round(coalesce((2 * e + d - b - 2 * a) / 10, (d - b) / 2, d - v, v - b), 6) AS d1, round(coalesce((2 * e - d - 2 * v - b + 2 * a) / 7, d - 2 * v + b), 6) AS d2 FROM n""",
    "w19_condition_pulse": f"""WITH {WAVES}, b AS (SELECT id, avg(v) AS m FROM w WHERE pos < 5 GROUP BY id), x AS (SELECT id, pos, v - m AS v FROM w JOIN b USING (id)),
f AS (SELECT id, -min(v) > max(v) AS flipped, 2 * (max(v) FILTER (pos < 5) - min(v) FILTER (pos < 5)) AS noise FROM x GROUP BY id),
y AS (SELECT id, pos, CASE WHEN flipped THEN -v ELSE v END AS v, flipped, noise FROM x JOIN f USING (id)), t AS (SELECT id, arg_max(pos, v) AS top, max(v) AS mx FROM y GROUP BY id)
SELECT id, (pos - top)::INT AS pos, round(v, 6) AS v, flipped, round(least(noise, mx / 2), 6) AS noise FROM y JOIN t USING (id)""",
    "a11_pulse_properties": f"""WITH {WAVES}, c AS (SELECT *, pos / 64.0::DOUBLE AS t, sum(abs(v)) OVER (PARTITION BY id ORDER BY pos) AS c, sum(abs(v)) OVER (PARTITION BY id) AS al FROM w),
p AS (SELECT id, greatest(max(v), 0) AS p, greatest(-min(v), 0) AS n, arg_max(t, v) AS top, arg_min(t, v) AS low, sum(abs(v)) / 64 AS total_area, sum(greatest(v, 0)) / 64 AS up, sum(greatest(-v, 0)) / 64 AS down,
  min(t) FILTER (c > 0.5 * al) AS median, min(t) FILTER (c > 0.25 * al) AS quartile1, min(t) FILTER (c > 0.75 * al) AS quartile3 FROM c GROUP BY id),
q AS (SELECT *, CASE WHEN p > 0.05 THEN p ELSE 0 END AS pos_ampl, CASE WHEN n > 0.05 THEN n ELSE 0 END AS neg_ampl FROM p),
z AS (SELECT id, pos_ampl, neg_ampl, pos_ampl + neg_ampl AS ppampl, greatest(pos_ampl, neg_ampl) / (pos_ampl + neg_ampl) AS relmaxampl, low - top AS ppdist, total_area, (up - down) / total_area AS polaritybalance, median, quartile1, quartile3, quartile3 - quartile1 AS iqrange FROM q)
SELECT id, {_r(*_PULSE)} FROM z""",
    "a12_wave_properties": f"""WITH {WAVES}, p AS (SELECT *, pos / 64.0::DOUBLE AS t FROM w WHERE pos < 32),
q AS (SELECT id, max(v) AS hi, min(v) AS lo, arg_min(t, v) - arg_max(t, v) AS d, sqrt(avg(0.01 * v * v)) AS e FROM p GROUP BY id)
SELECT id, round(hi - lo, 6) AS ppampl, round(greatest(abs(hi), abs(lo)) / (hi - lo), 6) AS relmaxampl, round(d, 6) AS ppdist, round(least(abs(d), 0.5 - abs(d)), 6) AS minppdist, round(e / (hi - lo), 6) AS rmserror FROM q""",
    "m4_fourier_coeffs": f"WITH {_CO} SELECT id, h::INT AS h, {_r('re', 'im')} FROM co",
    "m4_fourier_synthesis": f"WITH {_CO} SELECT id, i / 64.0::DOUBLE AS t, round(sum(re * cos(2 * pi() * h * 2 * i / 64) - im * sin(2 * pi() * h * 2 * i / 64)), 6) AS v FROM co, range(64) r(i) GROUP BY id, i",
    "m6_condition_wave": f"WITH {_CO}, fl AS (SELECT id, h, -re AS re, -im AS im FROM co), {_NORM.format('fl')} SELECT id, h::INT AS h, {_r('re', 'im')} FROM nm",
    "m7_unfilter": f"""WITH {SAMPLES}, d AS (SELECT channel, idx, v - avg(v) OVER (PARTITION BY channel) AS d FROM s)
SELECT channel, idx::INT AS idx, round(d + (first(d) OVER (PARTITION BY channel ORDER BY idx) + coalesce(sum(d) OVER (PARTITION BY channel ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (1 / (2 * pi() * 10) * 1000), 5) AS v FROM d""",
    "m8_unfilter_coeffs": f"WITH {_CO}, u AS (SELECT id, h, re + im / (h * 2.0) AS re, im - re / (h * 2.0) AS im FROM co WHERE h > 0), {_NORM.format('u')} SELECT id, h::INT AS h, {_r('re', 'im')} FROM nm",
    "a13_harmonic_spectrum": f"WITH {_SPEC} SELECT id, h::INT AS h, {_r('amplitude', 'relampl', 'relpower', 'phase')} FROM d",
    "a13_spectrum_summary": f"""WITH {_SPEC} SELECT id, arg_max(h, amplitude)::INT AS maxharmonics, round(10 * log10(sum(amplitude * amplitude)), 6) AS power, round(sqrt(sum(relampl * relampl) FILTER (h > 1)), 6) AS thd,
  round(stddev_pop(dd), 6) AS dbdiff, round(regr_slope(up, h), 6) AS phaseslope FROM d GROUP BY id""",
    "m12_align_snippets": f"""WITH {WAVES}, p AS (SELECT label, id, atan2(-sum(v * sin(2 * pi() * pos / 64)), sum(v * cos(2 * pi() * pos / 64))) AS p FROM w GROUP BY ALL), m AS (SELECT label, atan2(avg(sin(p)), avg(cos(p))) AS m FROM p GROUP BY label)
SELECT label, id AS event, (((pos + round((p - m) / (2 * pi()) * 64))::BIGINT % 64 + 64) % 64) AS pos, round(v, 6) AS v FROM w JOIN p USING (label, id) JOIN m USING (label)""",
    "a14_pulse_spectrum": f"""WITH {WAVES}, s AS (SELECT id, pos * 2.0::DOUBLE AS freq, v * v + 1e-6 AS energy FROM w), p AS (SELECT id, max(energy) AS pe, arg_max(freq, energy) AS pf FROM s GROUP BY id)
SELECT id, round(any_value(pf), 6) AS peakfreq, round(any_value(pe), 6) AS peakenergy, round(arg_min(freq, energy) FILTER (freq < pf), 6) AS troughfreq, round(min(energy) FILTER (freq < pf), 6) AS troughenergy,
  round(arg_min(energy, abs(freq - 30.5)), 6) AS eodfenergy, round(10 * log10(avg(energy) FILTER (freq < 5) / any_value(pe)), 6) AS energyatt5, round(10 * log10(avg(energy) FILTER (freq < 50) / any_value(pe)), 6) AS energyatt50,
  min(freq) FILTER (energy >= pe / 2) AS lowcutoff, max(freq) FILTER (energy >= pe / 2) AS highcutoff FROM s JOIN p USING (id) GROUP BY id""",
    "a22_mean_power": f"WITH {WAVES} SELECT label, pos::INT AS freq, round(avg(v * v), 9) AS power FROM w WHERE id BETWEEN 10 AND 200 GROUP BY label, pos",
    "a21_clipped_clusters": f"WITH {WAVES} SELECT id, count(*) FILTER (abs(v) > 0.2) > count(*) / 16 AS clipped FROM w GROUP BY id",
    "j17_weak_waves": f"""WITH {WAVES}, f AS (SELECT label, id, max(v) AS ppampl, CASE WHEN id % 4 = 0 THEN 'pulse' ELSE 'wave' END AS type, id * 37 % 101 AS power FROM w GROUP BY label, id),
k AS (SELECT *, type = 'wave' AND ppampl < 0.5 * max(ppampl) FILTER (type = 'pulse') OVER (PARTITION BY label) AS weak FROM f),
g AS (SELECT *, max(coalesce(weak, false)::INT) OVER (PARTITION BY label, type ORDER BY power DESC, ppampl DESC ROWS UNBOUNDED PRECEDING) AS gone FROM k) SELECT label, id, type FROM g WHERE gone = 0""",
    "j16_waves_below_pulses": f"""WITH {WAVES}, p AS (SELECT label, pos + 3 AS bin, 5 * count(*) * 1e-6 AS lim FROM w WHERE pos < 8 GROUP BY ALL), h AS (SELECT label, id AS grp, pos + 1 AS h, pos AS bin, v * v AS power FROM w WHERE pos < 5),
g AS (SELECT DISTINCT h.label, grp FROM h, range(-2, 3) r(k), p WHERE h.label = p.label AND h.bin + k = p.bin AND h <= 3 AND power < lim) SELECT label, grp, h::INT AS h FROM h ANTI JOIN g USING (label, grp)""",
}
