"""Queries whose inner step is a numpy helper: spectra, clusters, harmonic groups, phases, similarity, tracking, streams."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions.columns import decibel
from fieldwave.operators import clusters as C
from fieldwave.operators import events as V
from fieldwave.operators import harmonic_groups as H
from fieldwave.operators import jobs as J
from fieldwave.operators import spectra as S
from fieldwave.operators import tables as T
from fieldwave.operators import waveforms as A
from fieldwave.streaming import power as P
from fieldwave.streaming import tracking as R

from fieldwave.sources import readers as IO
from fieldwave.sources.shared import scratch

from .bind import SAMPLES, WAVES, r6, samples, table, waveforms
from .logger import FILTERED_STD, _hist_sql
from .waveforms import SQL as WAVEFORM_SQL
from .waveforms import pulse_properties


def _arrays(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))


def _timed(spark, sf_dir):
    return _arrays(spark, sf_dir).withColumn("time", F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: i / 64.0))


def psd(spark, sf_dir):
    """Spectra of each channel's samples, in blocks of 32 with the next 16 at their end."""
    arrays = S.blocks(samples(spark, sf_dir), ["channel"], 32, 16)
    return S.psd(arrays, ["channel", "block"], 1000.0, 50.0).withColumn("power", r6("power"))


def spectrogram(spark, sf_dir):
    return S.spectrogram(_arrays(spark, sf_dir), ["id"], 64.0, 4.0).withColumn("power", r6("power"))


def filtered_power(spark, sf_dir):
    return S.filtered_power(_arrays(spark, sf_dir), ["id"], 64.0, 1.0).withColumn("std", r6("std"))


def upsampled(spark, sf_dir):
    rows = S.upsample(_arrays(spark, sf_dir), 4)
    return rows.select("id", F.size("v").alias("n"), r6(F.array_max("v")).alias("top"))


def energy(spark, sf_dir):
    return S.pulse_spectrum(_arrays(spark, sf_dir), ["id"], 64.0, 1.0).withColumn("energy", F.round("energy", 9))


def pulse_train(spark, sf_dir):
    """Each channel's hours with events are the times of the mean pulse of its label, the channel's last digit."""
    events = samples(spark, sf_dir).select("channel", F.floor(F.col("us") / 3_600_000_000).alias("idx")).distinct()
    mean = A.mean_waveform(waveforms(spark, sf_dir).withColumnRenamed("id", "event"), ["label"]).select(F.col("label").cast("long").alias("label"), (F.col("pos") - 32).alias("pos"), F.col("mean").alias("v"))
    waves = events.select("channel", (F.col("channel") % 10).alias("label")).distinct().join(mean, "label")
    return S.pulse_train(events, waves, ["channel"]).withColumn("v", r6("v"))


def artefacts(spark, sf_dir):
    return S.artefact_clusters(_arrays(spark, sf_dir), ["id"], 64.0, 16.0)


def species(spark, sf_dir):
    mean = A.mean_waveform(waveforms(spark, sf_dir).withColumnRenamed("id", "event"), ["label"]).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("s"))
    templates = mean.select(F.concat(F.lit("species"), "label").alias("species"), F.transform("s", lambda x: x["pos"] / 64.0).alias("ttime"), F.transform("s", lambda x: x["mean"]).alias("tv"))
    return S.assign_species(_timed(spark, sf_dir), templates, 0.35).select("id", "species", r6("rms").alias("rms"))


def wave_species(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("EODf", F.lit(2.0))
    templates = rows.withColumn("n", F.row_number().over(W.partitionBy("label").orderBy("id"))).where("n = 1").select(F.concat(F.lit("wave"), "label").alias("species"), F.col("time").alias("ttime"), F.col("v").alias("tv"), F.lit(2.0).alias("tEODf"))
    return S.assign_species(rows, templates, 0.8, "wave").select("id", "species", r6("rms").alias("rms"))


def _chirps(spark, sf_dir):
    spectra = S.spectrogram(S.blocks(samples(spark, sf_dir), ["channel"], 64, 0), ["channel", "block"], 1000.0, 100.0, 0.9)
    spectra = spectra.withColumn("t", (F.col("block") * 64 + F.col("win")) / 1000.0)
    return spectra, S.chirps(spectra, spectra.groupBy("channel").agg(F.lit(250.0).alias("f")), ["channel"], 40.0, 0.02, 25, depth=0.5)


def chirps(spark, sf_dir):
    return _chirps(spark, sf_dir)[1].select("channel", "f", r6("t").alias("t"))


def chirp_rises(spark, sf_dir):
    spectra, found = _chirps(spark, sf_dir)
    return S.chirp_rise_check(found, spectra, ["channel"], 62.5, 40.0, 0.05, 1e5, 1.0).select("channel", "f", r6("t").alias("t"))


def pca(spark, sf_dir):
    rows = S.waveform_pca(_arrays(spark, sf_dir), ["id"], 3)
    return rows.select("id", F.posexplode("scores").alias("k", "score")).select("id", "k", F.round(F.abs("score"), 5).alias("score"))


def features(spark, sf_dir):
    return S.poly_features(_arrays(spark, sf_dir), ["id"]).select("id", F.posexplode("features").alias("k", "feature")).withColumn("feature", r6("feature"))


def tails(spark, sf_dir):
    return S.tail_time_constant(_arrays(spark, sf_dir), ["id"], 1 / 64, 0.02).select("id", r6("tau").alias("tau"), r6("taustart").alias("taustart"))


def widths(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", "event_id", F.col("v").alias("width"))
    return C.mixture_1d(rows, ["channel"], "event_id", "width", 3, use_log=True, min_n=2)


def density(spark, sf_dir):
    rows = S.poly_features(_arrays(spark, sf_dir), ["id", "label"]).withColumnRenamed("label", "source")
    return C.dbscan(rows, ["source"], "id", "features", 0.35, most=0)


def peak_trough(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", "event_id", (F.col("idx") % 5).cast("long").alias("peak_label"), (F.col("idx") % 3 - 1).cast("long").alias("trough_label"))
    return C.merge_peak_trough_clusters(rows, ["channel"], "event_id")


def moving(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", (F.col("t") / 86_400).alias("t"), (F.col("idx") % 4).alias("label"), (F.col("v") / 1e5).alias("width"), F.col("v").alias("height"))
    return C.moving_sources(rows, ["channel"], 2.0, 0.5, 2000.0)


def across_channels(spark, sf_dir):
    rows = samples(spark, sf_dir).select((F.col("channel") % 3).alias("recording"), (F.col("channel") % 7).alias("channel"), "t", (F.col("v") / 100).alias("height"))
    return C.group_across_channels(rows, ["recording"], 120.0).select("recording", "event", "channel", r6("t").alias("t"), r6("height").alias("height"))


def groups(spark, sf_dir):
    """Harmonic groups in the spectra of 32-sample blocks of every channel."""
    arrays = S.blocks(samples(spark, sf_dir), ["channel"], 64, 0)
    spectra = S.psd(arrays, ["channel", "block"], 1000.0, 8.0)
    limits = spectra.select("channel", "block").distinct().select("channel", "block", F.lit(3.0).alias("low"), F.lit(5.0).alias("high"))
    return H.harmonic_groups(spectra, ["channel", "block"], 8.0, H.GroupParams(max_freq_tol=12.0, max_freq=500.0, max_harmonics_db=5.0), limits).withColumn("power", r6("power"))


def pulse_phases(spark, sf_dir):
    rows = A.condition_pulse(waveforms(spark, sf_dir), ["id"]).select("id", "pos", "v")
    return H.pulse_phases(rows, ["id"], 1 / 64, 0.05, 0.02).select("id", "p", *(r6(c).alias(c) for c in ("time", "amplitude", "relampl", "width", "area")))


def wave_phases(spark, sf_dir):
    return H.wave_phases(waveforms(spark, sf_dir), ["id"], 1 / 64, 2.0).select("id", "p", *(r6(c).alias(c) for c in ("time", "amplitude", "relampl", "width")))


def side_peaks(spark, sf_dir):
    rows = A.condition_pulse(waveforms(spark, sf_dir), ["id"]).select("id", "pos", "v")
    return H.side_peak_or_wave(rows, ["id"], 1 / 64)


def _detections(spark, sf_dir):
    kind = F.when(F.col("kind_of") == "click", "pulse").otherwise("wave")
    return samples(spark, sf_dir).select((F.col("channel") % 20).alias("channel"), (F.col("t") / 60).alias("t0"), (F.col("t") / 60 + 5).alias("t1"), kind.alias("kind"), F.round(F.col("v") / 10).alias("EODf"), (F.round("v") * 1e-6).alias("ppdist"), F.col("v").alias("ppampl"))


def tracked(spark, sf_dir):
    return R.track_sources(_detections(spark, sf_dir), ["channel"]).select("channel", "source", "kind", r6("t0").alias("t0"), "EODf")


def tracked_occurrences(spark, sf_dir):
    rows = R.occurrences(R.track_sources(_detections(spark, sf_dir), ["channel"]), ["channel"])
    return rows.select("channel", "source", r6("tstart").alias("tstart"), r6("tend").alias("tend"), "EODf", "n")


def block_labels(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("block", F.floor(F.col("idx") / 10)).withColumn("label", (F.col("idx") % 3))
    mean = rows.groupBy("channel", "block", "label").agg(F.array(F.avg("v") / 100, F.lit(0.0)).alias("features"))
    return R.align_block_labels(mean, ["channel"], 0.2)


def walks(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", "idx", (F.col("idx") % 2).alias("label"), F.col("v").alias("height"))
    return R.amplitude_walk(rows, ["channel"])


def online(spark, sf_dir):
    rows = samples(spark, sf_dir).select("channel", F.col("event_id").alias("event"), (F.col("t") / 86_400).alias("t"), F.array("v", F.col("v") / 2, F.col("idx") % 5 + 0.0).alias("heights"))
    return R.online_multichannel_cluster(rows, ["channel"], 3.0)


def window_power(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    out = P.stream_signal_power(rows, ["channel"], size="2 days", slide="1 day", threshold=30.0, rate=1000.0, cutoff=50.0)
    return out.select("channel", F.unix_seconds("start").alias("start_s"), r6("std").alias("std"), "n", "loud")


def window_frequencies(spark, sf_dir):
    """Harmonic groups of every channel's windows of ten days, samples taken as a thousand a second."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("v"))
    windows = P.window_spectra(rows, ["channel"], 1000.0, 32.0, size="10 days")
    limits = windows.select("channel", "start", F.lit(3.0).alias("low"), F.lit(5.0).alias("high"))
    out = P.window_frequencies(windows, ["channel"], 1000.0, 32.0, H.GroupParams(max_freq_tol=40.0, max_freq=500.0, max_harmonics_db=5.0), limits)
    return out.select("channel", F.unix_seconds("start").alias("start_s"), "grp", "h", r6("freq").alias("freq"), r6("power").alias("power"))


def spectral_limits(spark, sf_dir):
    """Low and high thresholds of each label's spectrum: decibel of squared samples by position."""
    rows = waveforms(spark, sf_dir).select("label", (F.col("pos") + F.col("id") / 1e6).alias("freq"), decibel(F.col("v") * F.col("v"), 1.0, 1e-12).alias("db"))
    return H.spectral_thresholds(rows, ["label"], 20).select("label", r6("low").alias("low"), r6("high").alias("high"))


def recording_blocks(spark, sf_dir):
    """Events written as sample tables, read as blocks, and laid out again."""
    rows = samples(spark, sf_dir).select(F.concat(F.lit("rec"), F.col("channel") % 10).alias("recording"), F.col("channel").cast("int").alias("channel"), F.col("idx").cast("long").alias("idx"), "v")
    path = scratch(spark, "samples")
    rows.write.parquet(path)
    return IO.exploded(IO.read_samples(spark, path, "parquet", 16)).select("recording", "channel", "idx", r6("v").alias("v"))


def stored_waveforms(spark, sf_dir):
    """Mean waveforms stored in file units, milliseconds, and read back."""
    rows = A.mean_waveform(waveforms(spark, sf_dir).withColumnRenamed("id", "event"), ["label"])
    rows = rows.select(F.concat(F.lit("rec"), "label").alias("recording"), (F.col("pos") / 64).alias("time"), "mean", "sem")
    path = scratch(spark, "waveforms")
    IO.write_analysis(rows, path, "eodwaveform")
    return spark.read.parquet(path).select("recording", r6("time").alias("time_ms"), r6("mean").alias("mean"), r6("sem").alias("sem"))


def session_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("ts").cast("timestamp").alias("ts"))
    out = P.stream_sessions(rows, ["channel"], gap="6 hours")
    return out.select("channel", F.unix_micros("tstart").alias("tstart"), F.unix_micros("tend").alias("tend"), "n")


def pulse_rows(spark, sf_dir):
    events = samples(spark, sf_dir).select(F.col("channel").alias("id"), "t")
    rows = J.analyze_pulse(waveforms(spark, sf_dir).select("id", "pos", "v"), events, ["id"], 64.0)
    return rows.select("id", "flipped", "nphases", *(r6(c).alias(c) for c in ("ppampl", "ppdist", "tstart", "tend", "pulse_width", "median", "EODf", "peakfreq", "tau")))


def wave_rows(spark, sf_dir):
    rows = J.analyze_wave(waveforms(spark, sf_dir).select("id", "pos", "v"), ["id"], 64.0, 2.0, 5)
    return rows.select("id", "nphases", "maxharmonics", *(r6(c).alias(c) for c in ("ppampl", "power", "thd", "minwidth", "rmserror")))


def extracted_waves(spark, sf_dir):
    rows = J.extract_wave(_arrays(spark, sf_dir).withColumn("f", F.lit(8.0)), ["id"], 64.0, "f", 2.0, 0.5)
    return rows.select("id", r6("EODf").alias("EODf"), r6("n").alias("n"), "skip_reason")


def loaded(spark, sf_dir):
    waves = waveforms(spark, sf_dir).select((F.col("label") % 3).cast("string").alias("recording"), F.col("label").alias("channel"), (F.col("id") + 5).alias("index"), (F.col("pos") / 64).alias("time"), F.col("v").alias("mean"), F.lit(0.0).alias("sem"))
    fish = waves.select("recording", "channel", (F.col("index") - 5).alias("index")).distinct().withColumn("type", F.lit("wave"))
    low = waves.groupBy("recording", "channel").agg((F.min("index") - 5).alias("lowest"))
    spectra = waves.where("time < 0.1").select("recording", "channel", "index", (F.col("time") * 64 + 1).cast("int").alias("harmonics"), (F.col("time") * 640).alias("frequency"), F.when(F.col("mean") > 0, F.col("mean")).alias("datapower"))
    eodfs = low.select("recording", "channel", F.lit(None).cast("int").alias("index"), F.lit(7.5).alias("EODf"))
    whole, harmonics = J.load_analysis(fish, waves, spectra, eodfs, 3)
    return harmonics.select("recording", "channel", "index", "h", r6("freq").alias("freq"), r6("power").alias("power")).join(whole.select("recording", "channel", "index", F.size("waveform").alias("n")), ["recording", "channel", "index"], "left")


def merged(spark, sf_dir):
    rows = _timed(spark, sf_dir).withColumn("type", F.when(F.col("id") % 2 == 0, "pulse").otherwise("wave"))
    rows = rows.select("id", "type", (F.col("id") % 40 + 0.0).alias("EODf"), (F.col("id") % 30 * 1e-4).alias("ppdist"), F.array_max("v").alias("ppampl"), F.lit(0.01).alias("noise"), "time", "v")
    return J.merge_fish(rows, max_rms=0.6)


def decibels(spark, sf_dir):
    power = F.col("v") * F.col("v")
    return waveforms(spark, sf_dir).select("id", "pos", r6(decibel(power, 2.0, 1e-12)).alias("db"))


def property_columns(spark, sf_dir):
    rows = pulse_properties(spark, sf_dir).withColumns({"P1ampl": F.col("ppampl"), "P2ampl": F.when(F.col("id") % 7 > 0, F.col("ppampl")), "P2time": F.col("ppdist")})
    return T.select_property_columns(rows, "pulse", ["noise", "timing", "ampl", "time"], n=2, extra=["id"])


def _spectrum_sql(segments: str, keys: str, nfft: int, rate: float) -> str:
    """spec(keys, f, power): one-sided Hann power density of segments(keys, k, x)."""
    hann = f"0.5 * (1 - cos(2 * pi() * k / {nfft}))"
    total = float(sum((0.5 * (1 - np.cos(2 * np.pi * k / nfft))) ** 2 for k in range(nfft)))
    return f"""seg AS ({segments}), mid AS (SELECT {keys}, avg(x) AS m FROM seg GROUP BY ALL),
dft AS (SELECT {keys}, f, sum((x - m) * {hann} * cos(2 * pi() * f * k / {nfft})) AS re, sum((x - m) * {hann} * sin(2 * pi() * f * k / {nfft})) AS im FROM seg JOIN mid USING ({keys}), range({nfft // 2 + 1}) r(f) GROUP BY ALL),
spec AS (SELECT {keys}, f, (re * re + im * im) / {rate * total!r} * CASE WHEN f IN (0, {nfft // 2}) THEN 1 ELSE 2 END AS power FROM dft)"""


def _mixture_sql() -> str:
    """Expectation and maximisation as recursive SQL, a step per row: three parts of the logarithms of each channel; then cuts, small clusters, and the first close pair merged at a time."""
    each = lambda f: ", ".join(f(k) for k in (1, 2, 3))
    return f"""WITH RECURSIVE {SAMPLES}, l AS MATERIALIZED (SELECT channel, event_id, v AS x, ln(greatest(v, 1e-300)) AS y FROM s),
g AS (SELECT channel, avg(y) AS m, stddev_pop(y) AS sd, count(DISTINCT y) AS many FROM l GROUP BY channel),
z AS MATERIALIZED (SELECT channel, x, (y - m) / sd AS z, count(*) AS n FROM l JOIN g USING (channel) WHERE many > 3 AND sd > 0 GROUP BY ALL),
q AS (SELECT channel, quantile_cont((y - m) / sd, [1 / 6, 0.5, 5 / 6]) AS q FROM l JOIN g USING (channel) WHERE many > 3 AND sd > 0 GROUP BY channel),
em AS (SELECT channel, 0 AS step, false AS done, {each(lambda k: f"q[{k}] AS m{k}, 1.0::DOUBLE / 9 AS v{k}, 1.0::DOUBLE / 3 AS p{k}, q[{k}] AS om{k}, 1.0::DOUBLE / 9 AS ov{k}, 1.0::DOUBLE / 3 AS op{k}")} FROM q
  UNION ALL SELECT channel, step + 1, greatest({each(lambda k: f"abs(n{k} - om{k})")}) < 1e-6,
    {each(lambda k: f"n{k}, greatest((z2{k} - 2 * n{k} * z1{k} + n{k} * n{k} * (w{k} - 1e-9)) / w{k}, 1e-4), w{k} / (w1 + w2 + w3), om{k}, ov{k}, op{k}")} FROM (
    SELECT channel, step, {each(lambda k: f"sum(r{k}) + 1e-9 AS w{k}, sum(r{k} * z) / (sum(r{k}) + 1e-9) AS n{k}, sum(r{k} * z) AS z1{k}, sum(r{k} * z * z) AS z2{k}, m{k} AS om{k}, v{k} AS ov{k}, p{k} AS op{k}")} FROM (
      SELECT *, {each(lambda k: f"n * exp(l{k} - greatest(l1, l2, l3)) / (exp(l1 - greatest(l1, l2, l3)) + exp(l2 - greatest(l1, l2, l3)) + exp(l3 - greatest(l1, l2, l3))) AS r{k}")} FROM (
        SELECT em.*, z.z, z.n, {each(lambda k: f"-((z - m{k}) * (z - m{k})) / (2 * v{k}) - 0.5 * ln(v{k}) + ln(p{k}) AS l{k}")} FROM em JOIN z USING (channel) WHERE NOT done AND step < 200))
    GROUP BY channel, step, {each(lambda k: f"m{k}, v{k}, p{k}")})),
last AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY channel ORDER BY step DESC) = 1),
best AS (SELECT channel, x, z, n, CASE WHEN l1 >= l2 AND l1 >= l3 THEN 1 WHEN l2 >= l3 THEN 2 ELSE 3 END AS k FROM (
  SELECT channel, x, z, n, {each(lambda k: f"-((z - om{k}) * (z - om{k})) / (2 * ov{k}) - 0.5 * ln(ov{k}) + ln(op{k}) AS l{k}")} FROM z JOIN last USING (channel))),
cut AS MATERIALIZED (SELECT channel, x, n, coalesce(sum(new) OVER (PARTITION BY channel ORDER BY z), 0)::BIGINT AS c FROM (SELECT *, (k <> lag(k) OVER (PARTITION BY channel ORDER BY z))::INT AS new FROM best)),
mg AS (SELECT channel, 0 AS step, c AS label, list(x) AS xs, [c] AS of FROM (SELECT channel, c, x FROM cut, range(n) r(i)) GROUP BY channel, c HAVING count(*) >= 2
  UNION ALL SELECT channel, step + 1, min(label), flatten(list(xs)), flatten(list(of)) FROM (
    SELECT *, min(ord) FILTER (near) OVER (PARTITION BY channel) AS hit FROM (
      SELECT *, abs(lead(med) OVER w - med) < 0.5 * greatest(abs(med), abs(lead(med) OVER w)) AS near, row_number() OVER w AS ord FROM (SELECT *, list_median(xs) AS med FROM mg)
      WINDOW w AS (PARTITION BY channel ORDER BY med, label))) WHERE hit IS NOT NULL GROUP BY channel, step, CASE WHEN ord = hit + 1 THEN hit ELSE ord END),
ends AS (SELECT channel, label, unnest(of) AS c FROM mg QUALIFY step = max(step) OVER (PARTITION BY channel))
SELECT l.channel, l.event_id, CASE WHEN z0.channel IS NULL THEN 0 ELSE coalesce(ends.label, -1) END::BIGINT AS label
FROM l LEFT JOIN (SELECT DISTINCT channel FROM z) z0 USING (channel) LEFT JOIN cut ON cut.channel = l.channel AND cut.x = l.x LEFT JOIN ends ON ends.channel = l.channel AND ends.c = cut.c"""


#: Rows (k, pos, weight) of the projection on Chebyshev polynomials of 64 samples.
_BASIS = ", ".join(f"({k}, {i}, {c!r}::DOUBLE)" for k, row in enumerate(np.linalg.pinv(np.polynomial.chebyshev.chebvander(np.linspace(-1, 1, 64), 5)).tolist()) for i, c in enumerate(row))

#: r(channel, n, source, kind, t0, t1, f, dist, ampl): detections in order with their source; a source holds its largest detection's values.
_TRACK = f"""WITH RECURSIVE {SAMPLES}, e AS (SELECT channel % 20 AS channel, t / 60 AS t0, t / 60 + 5 AS t1, CASE WHEN kind_of = 'click' THEN 'pulse' ELSE 'wave' END AS kind, round(v / 10) AS f, round(v) * 1e-6 AS dist, v AS ampl FROM s),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t0, f, dist) AS n FROM e),
r AS (SELECT DISTINCT channel, 0::BIGINT AS n, -1::BIGINT AS source, '' AS kind, 0::DOUBLE AS t0, 0::DOUBLE AS t1, 0::DOUBLE AS f, 0::DOUBLE AS dist, 0::DOUBLE AS ampl,
    []::STRUCT(id BIGINT, kind VARCHAR, f DOUBLE, dist DOUBLE, ampl DOUBLE, tend DOUBLE)[] AS known FROM o
  UNION ALL SELECT channel, n, CASE WHEN fits THEN best.id ELSE len(known) END, kind, t0, t1, f, dist, ampl,
    CASE WHEN NOT fits THEN list_append(known, {{'id': len(known), 'kind': kind, 'f': f, 'dist': dist, 'ampl': ampl, 'tend': t1}})
      ELSE list_transform(known, lambda e: CASE WHEN e.id <> best.id THEN e ELSE {{'id': e.id, 'kind': e.kind, 'f': CASE WHEN ampl > e.ampl THEN f ELSE e.f END, 'dist': CASE WHEN ampl > e.ampl THEN dist ELSE e.dist END, 'ampl': greatest(ampl, e.ampl), 'tend': greatest(e.tend, t1)}} END) END
  FROM (SELECT *, coalesce(best.off <= CASE kind WHEN 'wave' THEN 1.0 ELSE 5e-5 END AND abs(best.f - f) <= 1.0 AND t0 - best.tend < 300, false) AS fits FROM (
    SELECT r.channel, o.n, o.kind, o.t0, o.t1, o.f, o.dist, o.ampl, r.known, list_sort(list_transform(list_filter(r.known, lambda e: e.kind = o.kind), lambda e: {{'off': CASE WHEN o.kind = 'wave' THEN abs(e.f - o.f) ELSE abs(e.dist - o.dist) END, 'id': e.id, 'f': e.f, 'tend': e.tend}}))[1] AS best
    FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1)))"""

QUERIES = {
    "c4_analyze_pulse": pulse_rows,
    "c4_analyze_wave": wave_rows,
    "m5_extract_wave": extracted_waves,
    "j18_load_analysis": loaded,
    "j21_merge_fish": merged,
    "p2_decibel": decibels,
    "p6_property_columns": property_columns,
    "m1_psd": psd,
    "m1_spectrogram": spectrogram,
    "m13_filtered_power": filtered_power,
    "m11_upsample": upsampled,
    "m2_pulse_spectrum": energy,
    "m3_pulse_train": pulse_train,
    "a20_artefact_clusters": artefacts,
    "j5_pulse_species": species,
    "m9_wave_species": wave_species,
    "w14_chirps": chirps,
    "w15_chirp_rises": chirp_rises,
    "a2_spectral_thresholds": spectral_limits,
    "s1_recording_blocks": recording_blocks,
    "s5_stored_waveforms": stored_waveforms,
    "r4_window_frequencies": window_frequencies,
    "m16_waveform_pca": pca,
    "m17_poly_features": features,
    "m15_tail_time_constant": tails,
    "c1_mixture": widths,
    "c2_dbscan": density,
    "j20_peak_trough_clusters": peak_trough,
    "w16_moving_sources": moving,
    "j19_across_channels": across_channels,
    "m14_harmonic_groups": groups,
    "w11_pulse_phases": pulse_phases,
    "w12_wave_phases": wave_phases,
    "w20_side_peaks": side_peaks,
    "r2_track_sources": tracked,
    "r2_occurrences": tracked_occurrences,
    "r5_block_labels": block_labels,
    "r6_amplitude_walk": walks,
    "r7_online_cluster": online,
    "r1_window_power": window_power,
    "r3_session_windows": session_windows,
}
SQL = {
    "p2_decibel": """WITH w AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT id, pos::INT AS pos, round(CASE WHEN v * v < 1e-12 THEN '-inf'::DOUBLE ELSE 10 * log10(v * v / 2.0) END, 6) AS db FROM w""",
    "r1_window_power": f"""WITH x AS (SELECT user_id AS channel, value AS v, epoch_us(ts) AS us, epoch_us(ts) // 86400000000 - k AS "window" FROM events, range(2) r(k)), {FILTERED_STD}
SELECT channel, "window" * 86400 AS start_s, round(std, 6) AS std, n, std > 30 AS loud FROM ps""",
    "r3_session_windows": """WITH g AS (SELECT user_id AS channel, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 AS new FROM events),
h AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY channel ORDER BY us) AS s FROM g) SELECT channel, min(us) AS tstart, max(us) AS tend, count(*) AS n FROM h GROUP BY channel, s""",
    "m3_pulse_train": """WITH e AS (SELECT DISTINCT user_id AS channel, (epoch_us(ts) - 1704067200000000) // 3600000000 AS idx FROM events),
n AS (SELECT *, lag(idx) OVER w AS b, lead(idx) OVER w AS a FROM e WINDOW w AS (PARTITION BY channel ORDER BY idx)),
w AS (SELECT label, pos - 32 AS pos, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL)
SELECT channel, idx + pos AS idx, round(v, 6) AS v FROM n JOIN w ON w.label = n.channel % 10 WHERE (b IS NULL OR pos > (b - idx) / 2) AND (a IS NULL OR pos <= (a - idx) / 2)""",
    "w16_moving_sources": """WITH s AS (SELECT user_id AS channel, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS label, (epoch_us(ts) - 1704067200000000) / 1e6 / 86400 AS t, value / 1e5 AS width, value AS height FROM events),
z AS (SELECT channel, greatest(2.0, 2000 * median(width)) AS dt, min(t) AS t0 FROM s GROUP BY channel),
x AS (SELECT s.*, greatest(0, ceil((t - t0 - dt) / 0.5 + 1e-9))::BIGINT AS a, floor((t - t0) / 0.5)::BIGINT AS b FROM s JOIN z USING (channel)),
y AS (SELECT *, unnest(range(a, greatest(a, b) + 1)) AS w FROM x),
e AS (SELECT channel, w, label, count(*) AS n, sum(height) AS h FROM y GROUP BY ALL),
k AS (SELECT channel, w, count(*) AS k, count(*) FILTER (n < 2) AS sp, sum(h) / sum(n) AS m FROM e GROUP BY ALL),
b AS (SELECT channel, w FROM k QUALIFY row_number() OVER (PARTITION BY channel ORDER BY k, sp, -m, w) = 1) SELECT channel, label::INT AS label FROM e JOIN b USING (channel, w)""",
    "m1_psd": f"""WITH {SAMPLES}, bl AS (SELECT channel, b AS block, idx - b * 32 AS i, v FROM (SELECT channel, idx, v, unnest(CASE WHEN idx >= 32 AND idx % 32 < 16 THEN [idx // 32 - 1, idx // 32] ELSE [idx // 32] END) AS b FROM s)),
ln AS (SELECT channel, block, max(i) + 1 AS len FROM bl GROUP BY ALL), st AS (SELECT *, unnest(CASE WHEN len >= 48 THEN [0, 16] ELSE [0] END) AS start FROM ln),
{_spectrum_sql("SELECT g.channel, g.block, g.start, g.k, coalesce(bl.v, 0) AS x FROM (SELECT * FROM st, range(32) r(k)) g LEFT JOIN bl ON bl.channel = g.channel AND bl.block = g.block AND bl.i = g.k + g.start", "channel, block, start", 32, 1000.0)}
SELECT channel, block, f * 1000.0::DOUBLE / 32 AS freq, round(avg(power), 6) AS power FROM spec GROUP BY channel, block, f""",
    "m1_spectrogram": f"""WITH {WAVES}, {_spectrum_sql("SELECT id, win, k, v AS x FROM w, range(7) a(win), range(16) r(k) WHERE pos = win * 8 + k", "id, win", 16, 64.0)}
SELECT id, win, f * 4.0 AS freq, round(power, 6) AS power FROM spec""",
    "m2_pulse_spectrum": f"""WITH {WAVES}, e AS (SELECT id, (avg(v) FILTER (pos < 3) + avg(v) FILTER (pos > 60)) / 2 AS m FROM w GROUP BY id),
x AS (SELECT id, pos, (v - m) * CASE WHEN pos < 3 THEN pos / 3 WHEN pos > 60 THEN (63 - pos) / 3 ELSE 1 END AS x FROM w JOIN e USING (id)),
d AS (SELECT id, f, sum(x * cos(2 * pi() * f * pos / 64)) AS re, sum(x * sin(2 * pi() * f * pos / 64)) AS im FROM x, range(33) r(f) GROUP BY ALL)
SELECT id, f::DOUBLE AS freq, round((re * re + im * im) / 4096 * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END, 9) AS energy FROM d""",
    "m11_upsample": f"""WITH {WAVES}, g AS (SELECT i / 4 AS u, least(62, greatest(1, round_even(i / 4, 0)))::BIGINT AS k FROM range(253) r(i)),
y AS (SELECT w.id, b.v + (u - k) * (c.v - w.v) / 2 + (u - k) * (u - k) * (w.v - 2 * b.v + c.v) / 2 AS y FROM g JOIN w ON w.pos = k - 1 JOIN w b ON b.id = w.id AND b.pos = k JOIN w c ON c.id = w.id AND c.pos = k + 1)
SELECT id, count(*)::INT AS n, round(max(y), 6) AS top FROM y GROUP BY id""",
    "m13_filtered_power": f"""WITH {WAVES}, d AS (SELECT id, pos, (v - coalesce(lag(v) OVER (PARTITION BY id ORDER BY pos), v)) / (1 + tan(pi() / 64)) AS d FROM w),
y AS (SELECT a.id, a.pos, sum(b.d * pow((1 - tan(pi() / 64)) / (1 + tan(pi() / 64)), a.pos - b.pos)) AS y FROM d a JOIN d b ON a.id = b.id AND b.pos <= a.pos GROUP BY ALL)
SELECT id, round(stddev_pop(y), 6) AS std FROM y GROUP BY id""",
    "m17_poly_features": f"""WITH {WAVES}, b(k, pos, c) AS (VALUES {_BASIS}),
f AS (SELECT id, k, sum(c * v) AS feature FROM w JOIN b USING (pos) GROUP BY ALL UNION ALL SELECT id, 6, 0.1 * (max(v) - min(v)) FROM w GROUP BY id)
SELECT id, k::INT AS k, round(feature, 6) AS feature FROM f""",
    "a20_artefact_clusters": f"""WITH {WAVES}, m AS (SELECT id, avg(v) AS m FROM w GROUP BY id),
d AS (SELECT id, f, sum((v - m) * cos(2 * pi() * f * pos / 64)) AS re, sum((v - m) * sin(2 * pi() * f * pos / 64)) AS im FROM w JOIN m USING (id), range(33) r(f) GROUP BY ALL)
SELECT id, coalesce(sum(re * re + im * im) FILTER (f < 16), 0) < 0.5 * sum(re * re + im * im) AS artefact FROM d GROUP BY id""",
    "j18_load_analysis": f"""WITH {WAVES} SELECT (label % 3)::VARCHAR AS recording, label AS channel, id AS "index", (pos + 1)::INT AS h, round(pos * 10.0::DOUBLE, 6) AS freq, round(v, 6) AS power, 64::INT AS n FROM w WHERE pos <= 6 AND v > 0
UNION ALL SELECT (label % 3)::VARCHAR, label, NULL, h::INT, h * 7.5::DOUBLE, NULL, NULL FROM (SELECT DISTINCT label FROM w), range(1, 4) r(h)""",
    "p6_property_columns": f"SELECT ppampl, ppdist, iqrange, ppampl AS P1ampl, ppdist AS P2time, id FROM ({WAVEFORM_SQL['a11_pulse_properties']})",
    "s1_recording_blocks": f"WITH {SAMPLES} SELECT 'rec' || (channel % 10) AS recording, channel::INT AS channel, idx, round(v, 6) AS v FROM s",
    "s5_stored_waveforms": f"WITH {WAVES} SELECT 'rec' || label AS recording, round(pos / 64 * 1000, 6) AS time_ms, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem FROM w GROUP BY label, pos",
    "a2_spectral_thresholds": f"""WITH {WAVES}, d AS (SELECT label, pos + id / 1e6 AS freq, 10 * log10(v * v) AS db FROM w WHERE v * v >= 1e-12), tops AS (SELECT label, max(pos + id / 1e6) AS top FROM w GROUP BY label),
q AS (SELECT label, freq, db FROM d JOIN tops USING (label) WHERE freq >= 0.5 * top AND freq < 0.75 * top), lin AS (SELECT label, regr_slope(db, freq) AS s, regr_intercept(db, freq) AS i FROM q GROUP BY label),
p AS (SELECT label, db - s * freq - i AS r FROM q JOIN lin USING (label)), {_hist_sql('p', 'label', 'r', 1.0, 20)} SELECT label, round(6 * width, 6) AS low, round(10 * width, 6) AS high FROM th""",
    "j20_peak_trough_clusters": f"""WITH RECURSIVE {SAMPLES}, lab AS MATERIALIZED (SELECT channel, event_id, idx % 5 AS pl, idx % 3 - 1 AS tl FROM s),
cl AS MATERIALIZED (SELECT channel, 'p' || pl AS name, count(*) AS size FROM lab WHERE pl >= 0 GROUP BY ALL UNION ALL SELECT channel, 't' || tl, count(*) FROM lab WHERE tl >= 0 GROUP BY ALL),
tch AS MATERIALIZED (SELECT channel, name, list(DISTINCT o) AS o FROM (SELECT channel, 'p' || pl AS name, 't' || tl AS o FROM lab WHERE pl >= 0 UNION ALL SELECT channel, 't' || tl, 'p' || pl FROM lab WHERE tl >= 0) GROUP BY ALL),
r AS (SELECT channel, -1 AS i, list(name) AS rest, NULL::VARCHAR AS kept FROM cl GROUP BY channel
  UNION ALL SELECT b.channel, i + 1, list_filter(rest, lambda x: x <> best AND NOT list_contains(o, x)), best FROM (
    SELECT r.channel, r.i, r.rest, arg_max(cl.name, (cl.size, -ascii(cl.name), -substr(cl.name, 2)::INT)) AS best FROM r JOIN cl ON cl.channel = r.channel AND list_contains(r.rest, cl.name) GROUP BY ALL) b
  JOIN tch ON tch.channel = b.channel AND tch.name = b.best)
SELECT l.channel, event_id, min(i)::INT AS label FROM lab l JOIN r ON r.channel = l.channel AND r.kept IN ('p' || pl, 't' || tl) GROUP BY ALL""",
    "j19_across_channels": f"""WITH RECURSIVE {SAMPLES}, g AS (SELECT channel % 3 AS recording, channel % 7 AS channel, event_id AS id, t, v / 100 AS height FROM s),
n AS (SELECT *, t - lag(t) OVER (PARTITION BY recording ORDER BY t, channel) > 120 AS new FROM g),
h AS MATERIALIZED (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY recording ORDER BY t, channel) AS session FROM n),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY recording, session ORDER BY height DESC, t, channel) AS n FROM h),
nb AS MATERIALIZED (SELECT a.id, list(b.id) AS ids FROM h a JOIN h b ON a.recording = b.recording AND a.session = b.session AND abs(a.t - b.t) <= 120 GROUP BY a.id),
r AS (SELECT DISTINCT recording, session, 0::BIGINT AS n, []::BIGINT[] AS taken, []::BIGINT[] AS got, 0::BIGINT AS top FROM h
  UNION ALL SELECT recording, session, n, list_concat(taken, got), got, top FROM (
    SELECT r.recording, r.session, o.n, r.taken, o.id AS top, CASE WHEN list_contains(r.taken, o.id) THEN [] ELSE list_filter(nb.ids, lambda i: NOT list_contains(r.taken, i)) END AS got
    FROM r JOIN o ON o.recording = r.recording AND o.session = r.session AND o.n = r.n + 1 JOIN nb ON nb.id = o.id)),
m AS (SELECT r.recording, r.session, r.n, x.channel, x.t, x.height, p.t AS top_t FROM (SELECT recording, session, n, top, unnest(got) AS id FROM r) r JOIN h x ON x.id = r.id JOIN h p ON p.id = r.top WHERE p.height >= 0.02)
SELECT recording, dense_rank() OVER (PARTITION BY recording ORDER BY session, n)::INT AS event, channel, round(t, 6) AS t, round(height, 6) AS height
FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY recording, session, n, channel ORDER BY height DESC, abs(t - top_t)) = 1)""",
    "r5_block_labels": f"""WITH RECURSIVE {SAMPLES}, c AS (SELECT channel, idx // 10 AS block, idx % 3 AS label, avg(v) / 100 AS x FROM s GROUP BY ALL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY block, label) AS n FROM c),
r AS (SELECT DISTINCT channel, 0::BIGINT AS n, -1::BIGINT AS block, -1::BIGINT AS label, []::STRUCT(k BIGINT, x DOUBLE)[] AS known, []::BIGINT[] AS taken, 0::BIGINT AS fresh, -1::BIGINT AS aligned FROM o
  UNION ALL SELECT channel, n, block, label, list_append(list_filter(known, lambda e: e.k <> k), {{'k': k, 'x': x}}), list_append(taken, k), fresh + (k = fresh)::BIGINT, k FROM (
    SELECT *, CASE WHEN best.d < 0.2 THEN best.k ELSE fresh END AS k FROM (
      SELECT *, list_sort(list_transform(list_filter(known, lambda e: NOT list_contains(taken, e.k)), lambda e: {{'d': abs(e.x - x), 'k': e.k}}))[1] AS best FROM (
        SELECT r.channel, o.n, o.block, o.label, o.x, r.known, r.fresh, CASE WHEN o.block = r.block THEN r.taken ELSE [] END AS taken FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1))))
SELECT channel, block, label::INT AS label, aligned FROM r WHERE n > 0""",
    "r6_amplitude_walk": f"""WITH RECURSIVE {SAMPLES}, o AS MATERIALIZED (SELECT channel, idx, idx % 2 AS label, v AS h, row_number() OVER (PARTITION BY channel ORDER BY idx) AS n FROM s),
r AS (SELECT DISTINCT channel, 0::BIGINT AS n, 0::BIGINT AS idx, []::STRUCT(last BIGINT, id BIGINT, label BIGINT, hs DOUBLE[], gap DOUBLE)[] AS open, 0::BIGINT AS fresh, -1::BIGINT AS walk FROM o
  UNION ALL SELECT channel, n, idx, list_sort(list_append(CASE WHEN best IS NULL THEN CASE WHEN len(live) >= 12 THEN live[2:] ELSE live END ELSE list_filter(live, lambda e: e.id <> best.id) END,
      {{'last': idx, 'id': coalesce(best.id, fresh), 'label': label, 'hs': CASE WHEN best IS NULL THEN [h] ELSE list_append(best.hs[-2:], h) END, 'gap': CASE WHEN best IS NULL THEN 0 ELSE (idx - best.last)::DOUBLE END}})),
    fresh + (best IS NULL)::BIGINT, coalesce(best.id, fresh) FROM (
    SELECT *, list_sort(list_filter(list_transform(list_filter(live, lambda e: e.label = label AND h > 0), lambda e: {{'d': abs(log2(h / list_avg(e.hs))), 'id': e.id, 'hs': e.hs, 'last': e.last}}), lambda e: e.d < log2(1.6)))[1] AS best FROM (
      SELECT r.channel, o.n, o.idx, o.label, o.h, r.fresh, list_filter(r.open, lambda e: o.idx - e.last <= greatest(30000, 20 * e.gap)) AS live FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1)))
SELECT channel, idx::INT AS idx, walk FROM r WHERE n > 0""",
    "r2_track_sources": f"{_TRACK} SELECT channel, source, kind, round(t0, 6) AS t0, f AS EODf FROM r WHERE n > 0",
    "r2_occurrences": f"""{_TRACK}, d AS MATERIALIZED (SELECT channel, source, t0, t1, f, ampl, row_number() OVER (PARTITION BY channel, source ORDER BY t0, t1, f, ampl) AS k FROM r WHERE n > 0),
w AS (SELECT channel, source, k, 0 AS part, t0 AS a, t1 AS z, f AS first, f AS best, ampl AS top, 1::BIGINT AS many FROM d WHERE k = 1
  UNION ALL SELECT channel, source, k, part + (NOT fits)::INT, CASE WHEN fits THEN a ELSE t0 END, CASE WHEN fits THEN greatest(z, t1) ELSE t1 END, CASE WHEN fits THEN first ELSE f END,
    CASE WHEN fits AND ampl <= top THEN best ELSE f END, CASE WHEN fits THEN greatest(top, ampl) ELSE ampl END, CASE WHEN fits THEN many + 1 ELSE 1 END FROM (
    SELECT w.*EXCLUDE (k), d.k, d.t0, d.t1, d.f, d.ampl, d.t0 <= w.z AND abs(d.f - w.first) < 0.5 AS fits FROM w JOIN d ON d.channel = w.channel AND d.source = w.source AND d.k = w.k + 1))
SELECT channel, source, round(a, 6) AS tstart, round(z, 6) AS tend, best AS EODf, many AS n FROM w QUALIFY row_number() OVER (PARTITION BY channel, source, part ORDER BY k DESC) = 1""",
    "r7_online_cluster": f"""WITH RECURSIVE {SAMPLES}, o AS MATERIALIZED (SELECT channel, event_id AS event, t / 86400 AS t, v AS a, v / 2 AS b, (idx % 5)::DOUBLE AS c, row_number() OVER (PARTITION BY channel ORDER BY t, event_id) AS n FROM s),
r AS (SELECT DISTINCT channel, 0::BIGINT AS n, 0::BIGINT AS event, []::STRUCT(t DOUBLE, s BIGINT, a DOUBLE, b DOUBLE, c DOUBLE)[] AS past, 0::BIGINT AS fresh, -1::BIGINT AS source FROM o
  UNION ALL SELECT channel, n, event, CASE WHEN len(list_filter(longer, lambda e: e.s = k)) > 5 THEN list_filter(longer, lambda e, i: i <> list_position(list_transform(longer, lambda y: y.s), k)) ELSE longer END, fresh + (k = fresh)::BIGINT, k FROM (
    SELECT *, list_append(past, {{'t': t, 's': k, 'a': a, 'b': b, 'c': c}}) AS longer FROM (
      SELECT *, CASE WHEN best.d < 0.1 THEN best.s ELSE fresh END AS k FROM (
        SELECT *, list_sort(list_transform(list_filter(past, lambda p: t - list_max(list_transform(list_filter(past, lambda e: e.s = p.s), lambda e: e.t)) >= 1 / 300),
          lambda e: {{'d': (abs(a - e.a) + abs(b - e.b) + abs(c - e.c)) / coalesce(nullif(greatest(abs(a), abs(e.a)) + greatest(abs(b), abs(e.b)) + greatest(abs(c), abs(e.c)), 0), 3), 's': e.s}}))[1] AS best FROM (
          SELECT r.channel, o.n, o.event, o.t, o.a, o.b, o.c, r.fresh, list_filter(r.past, lambda e: o.t - e.t <= 3.0) AS past FROM r JOIN o ON o.channel = r.channel AND o.n = r.n + 1)))))
SELECT channel, event, source FROM r WHERE n > 0""",
    "c1_mixture": _mixture_sql(),
    "c2_dbscan": f"""WITH RECURSIVE {WAVES}, b(k, pos, c) AS (VALUES {_BASIS}),
f AS MATERIALIZED (SELECT id, label, k, sum(c * v) AS x FROM w JOIN b USING (pos) GROUP BY ALL UNION ALL SELECT id, label, 6, 0.1 * (max(v) - min(v)) FROM w GROUP BY ALL),
near AS MATERIALIZED (SELECT p.label, p.id AS a, q.id AS b FROM f p JOIN f q USING (label, k) GROUP BY ALL HAVING sum((p.x - q.x) * (p.x - q.x)) <= 0.35 * 0.35),
size AS (SELECT label, greatest(5, floor(0.05 * count(DISTINCT id))) AS least FROM f GROUP BY label),
core AS MATERIALIZED (SELECT label, a AS id FROM near JOIN size USING (label) GROUP BY label, a, least HAVING count(*) >= least),
reach AS (SELECT label, id AS a, id AS b FROM core UNION SELECT reach.label, reach.a, core.id FROM reach JOIN near ON near.a = reach.b JOIN core ON core.id = near.b),
root AS (SELECT label, b AS id, min(a) AS root FROM reach GROUP BY ALL), num AS (SELECT id, dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS k FROM root)
SELECT i.label AS source, i.id, coalesce(min(num.k) FILTER (num.id = i.id), min(num.k), -1) AS label FROM (SELECT DISTINCT id, label FROM w) i LEFT JOIN near ON near.a = i.id LEFT JOIN num ON num.id = near.b GROUP BY i.label, i.id""",
    "w12_wave_phases": f"""WITH RECURSIVE {WAVES}, lim AS (SELECT id, 0.05 * (max(v) - min(v)) AS thr FROM w WHERE pos <= 32 GROUP BY id), c AS MATERIALIZED (SELECT id, pos, v, thr FROM w JOIN lim USING (id)),
r AS (SELECT id, pos, 0 AS way, v AS hv, pos AS hi, v AS lv, pos AS li, NULL::VARCHAR AS kind, pos AS at_pos, v AS at_v FROM c WHERE pos = 0
  UNION ALL SELECT id, pos, CASE kind WHEN 'peak' THEN -1 WHEN 'trough' THEN 1 ELSE way END, CASE kind WHEN 'trough' THEN v ELSE hv END, CASE kind WHEN 'trough' THEN pos ELSE hi END,
    CASE kind WHEN 'peak' THEN v ELSE lv END, CASE kind WHEN 'peak' THEN pos ELSE li END, kind, CASE kind WHEN 'peak' THEN hi WHEN 'trough' THEN li END, CASE kind WHEN 'peak' THEN hv WHEN 'trough' THEN lv END
  FROM (SELECT *, CASE WHEN way >= 0 AND hv - v > thr THEN 'peak' WHEN way <= 0 AND v - lv > thr THEN 'trough' END AS kind FROM (
    SELECT r.id, c.pos, c.v, c.thr, way, CASE WHEN way >= 0 AND c.v > hv THEN c.v ELSE hv END AS hv, CASE WHEN way >= 0 AND c.v > hv THEN c.pos ELSE hi END AS hi,
      CASE WHEN way <= 0 AND c.v < lv THEN c.v ELSE lv END AS lv, CASE WHEN way <= 0 AND c.v < lv THEN c.pos ELSE li END AS li FROM r JOIN c ON c.id = r.id AND c.pos = r.pos + 1))),
sp AS MATERIALIZED (SELECT id, at_pos AS pos, at_v AS v, row_number() OVER (PARTITION BY id ORDER BY at_pos) AS k FROM r WHERE kind IS NOT NULL),
seg AS (SELECT s.id, s.k, s.pos AS a, n.pos AS b, (s.v + n.v) / 2 AS lv FROM sp s JOIN sp n ON n.id = s.id AND n.k = s.k + 1),
cr AS (SELECT seg.id, seg.k, x.pos, (x.pos + (x.v - lv) / (x.v - y.v)) / 64 AS tc FROM seg JOIN w x ON x.id = seg.id AND x.pos >= a AND x.pos < b JOIN w y ON y.id = x.id AND y.pos = x.pos + 1 WHERE (x.v - lv) * (y.v - lv) < 0),
hf AS (SELECT id, k, tc FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY id, k) AS many FROM cr) WHERE rn = many // 2),
nr AS (SELECT id, max(abs(v)) AS big, arg_max(pos, (v, -pos)) AS zp FROM sp WHERE pos < 24 GROUP BY id)
SELECT sp.id, row_number() OVER (PARTITION BY sp.id ORDER BY sp.pos)::INT AS p, round((pos - zp) / 64, 6) AS time, round(v, 6) AS amplitude, round(abs(v) / big, 6) AS relampl, round(h.tc - g.tc, 6) AS width
FROM sp JOIN nr ON nr.id = sp.id LEFT JOIN hf h ON h.id = sp.id AND h.k = sp.k LEFT JOIN hf g ON g.id = sp.id AND g.k = sp.k - 1 WHERE pos >= zp AND pos <= zp + 31""",
}
SQL["c4_analyze_wave"] = f"""WITH {WAVES}, x AS (SELECT id, pos, v * CASE WHEN pos IN (0, 63) THEN 0.5 ELSE 1 END * 2 / 63 AS x FROM w),
co AS (SELECT id, h, sum(x * cos(2 * pi() * h * 2 * pos / 64)) AS re, -sum(x * sin(2 * pi() * h * 2 * pos / 64)) AS im FROM x, range(6) r(h) GROUP BY ALL),
a AS (SELECT id, h, sqrt(re * re + im * im) AS am FROM co WHERE h > 0),
q AS (SELECT id, arg_max(h, (am, -h))::INT AS maxharmonics, 10 * log10(sum(am * am)) AS power, sqrt(sum(am * am) FILTER (h > 1)) / max(am) FILTER (h = 1) AS thd FROM a GROUP BY id),
ft AS (SELECT w.id, w.pos, w.v, sum(CASE h WHEN 0 THEN re / 2 ELSE re * cos(2 * pi() * h * 2 * pos / 64) - im * sin(2 * pi() * h * 2 * pos / 64) END) AS fit FROM w JOIN co USING (id) WHERE pos < 32 GROUP BY ALL),
b AS (SELECT id, max(v) - min(v) AS pp, sqrt(avg((v - fit) * (v - fit))) AS e FROM ft GROUP BY id),
ph AS (SELECT id, count(*) AS nphases, min(width) AS minwidth FROM ({SQL["w12_wave_phases"]}) GROUP BY id)
SELECT b.id, nphases, maxharmonics, round(pp, 6) AS ppampl, round(power, 6) AS power, round(thd, 6) AS thd, round(minwidth, 6) AS minwidth, round(e / pp, 6) AS rmserror FROM b JOIN q USING (id) LEFT JOIN ph USING (id)"""
