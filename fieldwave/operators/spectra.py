"""Spectra of blocks and waveforms, trains of pulses, similarity, chirps: numpy helpers per row or group, dealt out by Spark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions import kernels as K
from fieldwave.sources.shared import written


def blocks(samples: DataFrame, keys: Sequence[str], size: int, overlap: int = 0, *, part: int | None = None, added: DataFrame | None = None) -> DataFrame:
    """(keys, block, idx0, v): samples gathered into arrays of ``size``, each with up to ``overlap`` samples of the next block at its end.

    With ``part``, so many neighbouring blocks are gathered by one task, so that what is summed over
    them is shuffled once.  ``added(keys, idx, v)`` is added to the samples where there are samples.
    """
    at = F.floor(F.col("idx") / size)
    early = (at > 0) & (F.col("idx") - at * size < overlap)
    placed = lambda df, *more: df.select(*keys, "idx", "v", *more, F.explode(F.when(early, F.array(at - 1, at)).otherwise(F.array(at))).alias("block"))
    rows = placed(samples) if added is None else placed(samples, F.lit(True).alias("_is")).unionByName(placed(added, F.lit(False).alias("_is")))
    own = [*keys, "block"]
    if part is not None:
        own = [*keys, "_part", "block"]
        rows = rows.withColumn("_part", F.floor(F.col("block") / part)).repartition(*keys, "_part")
    if added is not None:
        rows = rows.groupBy(*own, "idx").agg(F.sum("v").alias("v"), F.max("_is").alias("_is")).where("_is")
    grouped = rows.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("_s"))
    return grouped.select(*keys, "block", F.col("_s")[0]["idx"].alias("idx0"), F.transform("_s", lambda s: s["v"].cast("double")).alias("v"))


def _stacked(df: DataFrame, keys: Sequence[str], schema: str, make, most: int = 1 << 21) -> DataFrame:
    """Rows of arrays ``v`` of equal length, many at a time, through ``make(matrix)``, which gives a column each per row or for all rows; the keys stand in front."""
    kinds = dict(df.dtypes)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                for k in range(0, len(of), max(1, most // max(size, 1))):
                    part = of[k : k + max(1, most // max(size, 1))]
                    cols = make(np.stack([np.asarray(v, float) for v in pdf["v"].iloc[part]]))
                    n = max(c.size // len(part) if c.ndim == 2 else len(c) for c in cols)
                    out = pdf[[*keys]].iloc[np.repeat(part, n)].reset_index(drop=True)
                    yield out.assign(**{name: c.ravel() if c.ndim == 2 else np.tile(c, len(part)) for name, c in zip(names, cols)})

    return df.where(F.size("v") > 0).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))


def psd(arrays: DataFrame, keys: Sequence[str], rate: float, resolution: float) -> DataFrame:
    """(keys, freq, power) of each array, at least as fine as ``resolution``."""
    nfft = K.nfft_for(rate, resolution)
    return _stacked(arrays.select(*keys, "v"), keys, "freq double, power double", lambda x: K.psd(x, rate, nfft))


def spectrogram(arrays: DataFrame, keys: Sequence[str], rate: float, resolution: float, overlap: float = 0.5) -> DataFrame:
    """(keys, win, freq, power) of each array."""
    nfft = K.nfft_for(rate, resolution)

    def make(x):
        starts, p = K.spectrogram(x, rate, nfft, overlap)
        f = np.fft.rfftfreq(nfft, 1 / rate)
        return np.repeat(np.arange(len(starts)), len(f)), np.tile(f, len(starts)), p.reshape(len(x), -1)

    return _stacked(arrays.select(*keys, "v"), keys, "win long, freq double, power double", make)


def high_pass(arrays: DataFrame, keys: Sequence[str], rate: float, cutoff: float = 10.0) -> DataFrame:
    """Each array after a first-order high-pass; the mean of its first twentieth is removed before."""

    @F.pandas_udf("array<double>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([K.high_pass(np.asarray(v, float) - np.mean(v[: max(1, len(v) // 20)]), rate, cutoff) for v in parts])

    return arrays.withColumn("v", run("v"))


def filtered_power(arrays: DataFrame, keys: Sequence[str], rate: float, cutoff: float = 10.0) -> DataFrame:
    """(keys, std): signal power of each array after the high-pass."""
    v = F.col("v")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = high_pass(arrays, keys, rate, cutoff).withColumn("_m", mean(v))
    return rows.select(*keys, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - F.col("_m")) * (x - F.col("_m"))) / F.size(v)).alias("std"))


def upsample(arrays: DataFrame, factor: int, most: int = 1 << 18) -> DataFrame:
    """Arrays with ``factor`` times as many samples; give it short ones, around candidate events.

    Rows pass as flat buffers of about ``most`` samples, with no object per sample or row; a null array stays null, and where there is no number there is null.
    """
    plain = arrays.withColumn("v", F.col("v").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("v")
            size = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(np.append(0, size.astype(np.int64))) * max(factor, 1)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, "right")) - 1)
                part = batch.slice(begin, end - begin)
                yield part.set_column(at, batch.schema.field(at), _upsampled(part.column(at), factor))
                begin = end

    return plain.mapInArrow(run, plain.schema)


def _upsampled(v: pa.ListArray, factor: int) -> pa.ListArray:
    """``quadratic_upsample`` of each list, all of a length at a time."""
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    made = np.where((size < 3) | (factor <= 1), size, (size - 1) * factor + 1)
    begin, upto = np.cumsum(size) - size, np.append(0, np.cumsum(made))
    x, out = v.flatten().to_numpy(zero_copy_only=False).astype(float), np.empty(upto[-1])
    for n in np.unique(size[size > 0]):
        of = np.flatnonzero(size == n)
        y = K.quadratic_upsample(x[begin[of][:, None] + np.arange(n)], factor)
        out[upto[of][:, None] + np.arange(y.shape[1])] = y
    offsets = pa.array(upto.astype(np.int32), mask=np.append(v.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(out, from_pandas=True), type=v.type)


def pulse_spectrum(arrays: DataFrame, keys: Sequence[str], rate: float, resolution: float = 1.0, fade: float = 0.05) -> DataFrame:
    """(keys, freq, energy) of each pulse waveform."""

    return _stacked(arrays.select(*keys, "v"), keys, "freq double, energy double", lambda x: K.energy_spectrum(x, rate, resolution, fade))


def pulse_train(events: DataFrame, waves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, idx, v): the mean pulse at every event; where two overlap, each counts up to the middle between them.

    ``events(keys, idx)``, ``waves(keys, pos, v)``.
    """
    w = W.partitionBy(*keys).orderBy("idx")
    rows = events.select(*keys, "idx", F.lag("idx").over(w).alias("_b"), F.lead("idx").over(w).alias("_a"))
    met = rows.join(waves.select(*keys, "pos", "v"), list(keys))
    inside = (F.col("_b").isNull() | (F.col("pos") > (F.col("_b") - F.col("idx")) / 2)) & (F.col("_a").isNull() | (F.col("pos") <= (F.col("_a") - F.col("idx")) / 2))
    return met.where(inside).select(*keys, (F.col("idx") + F.col("pos")).alias("idx"), "v")


def pulse_train_spectrum(events: DataFrame, waves: DataFrame, keys: Sequence[str], rate: float, resolution: float, size: DataFrame | None = None) -> DataFrame:
    """(keys, freq, power): mean power density of each train of pulses, zero between them, over segments that overlap by half.

    ``size(keys, n)`` tells how many samples a series has, from 0 on; else it ends with its last pulse.
    Samples of a train go to the two segments that hold them; segments without
    pulses count as zero.
    """
    nfft = K.nfft_for(rate, resolution)
    half = nfft // 2
    train = pulse_train(events, waves, keys).where("idx >= 0")
    size = train.groupBy(*keys).agg((F.max("idx") + 1).alias("n")) if size is None else size.select(*keys, "n")
    count = F.greatest(F.lit(1), F.floor((F.col("n") - nfft) / half) + 1).cast("long")
    held = train.join(size, list(keys)).withColumn("_count", count).where(F.col("idx") < F.col("n"))
    last = F.floor(F.col("idx") / half)
    parts = held.select(*keys, "_count", "idx", "v", F.explode(F.array(last - 1, last)).alias("segment")).where((F.col("segment") >= 0) & (F.col("segment") < F.col("_count")))
    dense = parts.groupBy(*keys, "_count", "segment").agg(F.map_from_entries(F.collect_list(F.struct((F.col("idx") - F.col("segment") * half).cast("int"), "v"))).alias("m"))
    dense = dense.select(*keys, "_count", "segment", F.transform(F.sequence(F.lit(0), F.lit(nfft - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    power = psd(dense, [*keys, "_count", "segment"], rate, resolution)
    return power.groupBy(*keys, "_count", "freq").agg(F.sum("power").alias("power")).select(*keys, "freq", (F.col("power") / F.col("_count")).alias("power"))


def artefact_clusters(arrays: DataFrame, keys: Sequence[str], rate: float, low_freq: float, threshold: float = 0.5) -> DataFrame:
    """(keys, artefact): mean snippets with less than ``threshold`` of their spectral power below ``low_freq``; off beyond half the rate."""

    @F.pandas_udf("boolean")
    def run(parts: pd.Series) -> pd.Series:
        out = []
        for v in parts:
            v = np.asarray(v, float)
            power = np.abs(np.fft.rfft(v - v.mean())) ** 2
            low = power[np.fft.rfftfreq(len(v), 1 / rate) < low_freq].sum()
            out.append(bool(low_freq <= rate / 2 and low < threshold * power.sum()))
        return pd.Series(out)

    return arrays.select(*keys, run("v").alias("artefact"))


def similarity(kind: str):
    """Pandas UDF over (time_a, v_a, time_b, v_b [, freq_a, freq_b]) arrays: ``wave`` or ``pulse``."""

    def wave(ta: pd.Series, va: pd.Series, tb: pd.Series, vb: pd.Series, fa: pd.Series, fb: pd.Series) -> pd.Series:
        return pd.Series([K.wave_similarity(np.array([a, b], float), np.array([c, d], float), x, y) for a, b, c, d, x, y in zip(ta, va, tb, vb, fa, fb)])

    def pulse(ta: pd.Series, va: pd.Series, tb: pd.Series, vb: pd.Series) -> pd.Series:
        return pd.Series([K.pulse_similarity(np.array([a, b], float), np.array([c, d], float)) for a, b, c, d in zip(ta, va, tb, vb)])

    return F.pandas_udf(wave if kind == "wave" else pulse, "double")


def assign_species(fish: DataFrame, templates: DataFrame, max_rms: float, kind: str = "pulse", block: int = 5_000) -> DataFrame:
    """Adds the best template's name and difference; ``unknown`` from ``max_rms`` on.

    ``fish(…, time, v)``, ``templates(species, ttime, tv)`` as arrays (with EODf columns
    ``EODf`` and ``tEODf`` for waves).  Templates are broadcast ``block`` at a time; a
    fish meets them where it stands, and keeps the least difference, the first name
    on ties.  Without templates all are unknown, with a null difference.
    """
    columns = ["species", "ttime", "tv"] + (["tEODf"] if kind == "wave" else [])
    args = ["time", "v"] + (["EODf"] if kind == "wave" else [])
    n = -(-templates.count() // block)
    kept = fish.withColumn("_best", F.lit(None).cast("struct<rms:double,species:string>"))
    for k in range(n):
        part = templates.select(*columns).where(F.pmod(F.xxhash64("species", "ttime", "tv"), F.lit(n)) == k)
        rows = [(r.species, np.array([r.ttime, r.tv], float), r.tEODf if kind == "wave" else None) for r in part.orderBy("species").collect()]
        if rows:
            sent = fish.sparkSession.sparkContext.broadcast(rows)
            kept = kept.withColumn("_best", F.least("_best", _least_difference(sent, kind)(*args)))
            if n > 1:  # the block is done with before the next one is sent
                kept = written(kept, "nearest")
                sent.destroy()
    return kept.withColumn("species", F.when(F.col("_best.rms") < max_rms, F.col("_best.species")).otherwise("unknown")).withColumn("rms", F.col("_best.rms")).drop("_best")


def _least_difference(known, kind: str):
    """Pandas UDF: (rms, species) of the nearest of the broadcast templates."""

    def nearest(t, v, f):
        own = np.array([t, v], float)
        return min(((K.wave_similarity(own, w, f, g) if kind == "wave" else K.pulse_similarity(own, w), name) for name, w, g in known.value), default=(None, None))

    def pulse(ts: pd.Series, vs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t, v, None) for t, v in zip(ts, vs)], columns=["rms", "species"])

    def wave(ts: pd.Series, vs: pd.Series, fs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nearest(t, v, f) for t, v, f in zip(ts, vs, fs)], columns=["rms", "species"])

    return F.pandas_udf(wave if kind == "wave" else pulse, "rms double, species string")


def chirps(spectra: DataFrame, fundamentals: DataFrame, keys: Sequence[str], tol: float = 1.0, max_dur: float = 1.0, frame: int = 50, depth: float = 3.0) -> DataFrame:
    """(keys, f, t): moments at which the power around a fundamental dips.

    ``spectra(keys, t, freq, power)``, ``fundamentals(keys, f)``.  Per fundamental the
    largest power within ``tol`` follows in time; rises after falls of more than a
    standard deviation of its steps, less than ``max_dur`` apart, mark a dip; it
    counts when the least power within it is under median - ``depth`` std of ``frame`` steps around.
    """
    from fieldwave.operators.events import hysteresis_peaks

    bucket = F.floor(F.col("f") / tol)
    want = fundamentals.select(*keys, "f", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    met = spectra.withColumn("_b", F.floor(F.col("freq") / tol)).join(want, [*keys, "_b"]).where(F.abs(F.col("freq") - F.col("f")) <= tol)
    trace = met.groupBy(*keys, "f", "t").agg(F.max("power").alias("power"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        p, t = pdf["power"].to_numpy(), pdf["t"].to_numpy()
        d = np.diff(p)
        rows = []
        if len(d) > 2 and d.std() > 0:
            peaks, troughs = hysteresis_peaks(d, d.std())
            for low in troughs:
                later = [k for k in peaks if k > low]
                if later and t[later[0]] - t[low] < max_dur:
                    mid = (low + later[0]) // 2
                    near = p[max(0, mid - frame) : mid + frame + 1]
                    if p[low : later[0] + 2].min() < np.median(near) - depth * near.std(ddof=1):
                        rows.append(t[mid])
        first = pdf.iloc[0]
        return pd.DataFrame({**{k: [first[k]] * len(rows) for k in keys}, "f": [first["f"]] * len(rows), "t": rows})

    kinds = dict(trace.dtypes)
    return trace.groupBy(*keys, "f").applyInPandas(find, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "f double", "t double"]))


def chirp_rise_check(found: DataFrame, spectra: DataFrame, keys: Sequence[str], above: float = 50.0, tol: float = 1.0, frame: float = 1.0, most: float = 1e-3, height: float = 3.0) -> DataFrame:
    """Chirps stay whose power at f + ``above`` exceeds median + ``height`` std of its surroundings, or where that median is over ``most``."""
    near = F.floor(F.col("t") / frame)
    rows = found.withColumn("_b", F.explode(F.array(near - 1, near, near + 1)))
    other = spectra.select(*keys, F.col("t").alias("_t"), "freq", "power", F.floor(F.col("t") / frame).alias("_b"))
    met = rows.join(other, [*keys, "_b"]).where((F.abs(F.col("_t") - F.col("t")) <= frame) & (F.abs(F.col("freq") - F.col("f") - above) <= tol))
    each = met.groupBy(*keys, "f", "t", "_t").agg(F.max("power").alias("power"))
    stats = each.groupBy(*keys, "f", "t").agg(F.median("power").alias("_m"), F.stddev_samp("power").alias("_s"), F.max_by("power", -F.abs(F.col("_t") - F.col("t"))).alias("_p"))
    return stats.where((F.col("_m") > most) | (F.col("_p") > F.col("_m") + height * F.col("_s"))).select(*keys, "f", "t")


def waveform_pca(arrays: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """Scores of unit-norm waveforms on the first k components of all of them; one model for the table, fitted by Spark."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = F.col("v")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = arrays.select(*keys, array_to_vector(F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))).alias("_x"))
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(rows)
    return model.transform(rows).select(*keys, vector_to_array("_p").alias("scores"))


def class_loadings(arrays: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, mean, loadings): the first k components of the arrays ``v`` of each class, from one pass of sums; loadings are flattened."""
    kinds = dict(arrays.dtypes)
    head = ", ".join([*(f"{c} {kinds[c]}" for c in keys), ""])

    def sums(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            groups = pdf.groupby(list(keys), dropna=False, sort=False)["v"] if len(keys) else [((), pdf["v"])]
            rows = []
            for key, vs in groups:
                x = np.stack([np.asarray(v, float) for v in vs])
                rows.append((*(key if isinstance(key, tuple) else (key,)), len(x), x.sum(0), (x.T @ x).ravel()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "s", "o"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = pdf["n"].sum(), np.sum(pdf["s"].tolist(), axis=0)
        mean = mean / n
        covariance = np.sum(pdf["o"].tolist(), axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
        return pdf[[*keys]].iloc[:1].assign(mean=[mean], loadings=[K.loadings(covariance, k).ravel()])

    partial = arrays.select(*keys, "v").mapInPandas(sums, head + "n long, s array<double>, o array<double>")
    return partial.groupBy(*keys).applyInPandas(solve, head + "mean array<double>, loadings array<double>")  # a row per class and batch


def principal_scores(arrays: DataFrame, keys: Sequence[str], ident: str, k: int = 5) -> DataFrame:
    """(keys, ident, scores): each array on the first k components of its class, each with its largest loading positive; no class is one piece of work."""
    fitted = class_loadings(arrays, keys, k)
    met = arrays.select(*keys, ident, "v").join(fitted, list(keys)) if len(keys) else arrays.select(ident, "v").join(F.broadcast(fitted))  # one row
    off = F.zip_with("v", "mean", lambda a, b: a - b)
    row = lambda i: F.slice("loadings", i * F.size("mean") + 1, F.size("mean"))
    score = lambda i: F.aggregate(F.zip_with("_off", row(i), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.withColumn("_off", off).select(*keys, ident, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), score).alias("scores"))


def property_pca(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int, *, scaled: bool = False) -> DataFrame:
    """(keys, scores): rows of a property table on the first k components of ``columns``; ``scaled`` divides each by its standard deviation first.

    All that is needed comes from one pass of sums over pairs of columns, each over
    the rows that have both; a cell that is missing counts as the column's mean.  The matrix is one
    number per pair of columns.
    """
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    cov = lambda i, j: F.covar_samp(x[i], x[j])
    found = df.agg(*(F.avg(c) for c in x), *(cov(i, j) for i, j in pairs)).first()
    mean, matrix = np.array([found[i] or 0.0 for i in range(len(x))]), np.zeros((len(x), len(x)))
    for n, (i, j) in enumerate(pairs):
        matrix[i, j] = matrix[j, i] = found[len(x) + n] or 0.0
    unit = np.sqrt(np.diag(matrix)) if scaled else np.ones(len(x))
    unit = np.where(unit > 0, unit, 1.0)
    rows = K.loadings(matrix / np.outer(unit, unit), k)
    cells = [F.coalesce((c - float(m)) / float(u), F.lit(0.0)) for c, m, u in zip(x, mean, unit)]
    scores = [sum((c * float(w) for c, w in zip(cells, row)), F.lit(0.0)) for row in rows]
    return df.select(*keys, F.array(*scores).alias("scores"))


def align_to_mean(arrays: DataFrame, keys: Sequence[str], by: Sequence[str] = (), *, most: int = 8, rounds: int = 3) -> DataFrame:
    """(keys, v): arrays moved by up to ``most`` samples so that they correlate best with the mean of their class ``by``, which is formed anew each round.

    Arrays of a class have one length.  Means are sums over positions; an array
    meets the one of its class.
    """
    held = arrays.select(*dict.fromkeys([*keys, *by]), "v", F.lit(0).alias("_by"))

    @F.pandas_udf("array<double>")
    def turn(vs: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([K.moved(np.asarray(v, float)[None], np.array([d]))[0] for v, d in zip(vs, by)], dtype=object)

    @F.pandas_udf("int")
    def lag(vs: pd.Series, means: pd.Series) -> pd.Series:
        return pd.Series([int(K.lags_to(np.asarray(v, float)[None], np.asarray(m, float), most)[0]) for v, m in zip(vs, means)])

    for _ in range(rounds):
        held = written(held, "aligned")
        at = held.select(*by, F.posexplode(turn("v", "_by")).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
        mean = at.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_s")).select(*by, F.transform("_s", lambda s: s["x"]).alias("_mean"))
        held = (held.join(mean, list(by)) if len(by) else held.join(F.broadcast(mean))).withColumn("_by", lag("v", "_mean")).drop("_mean")  # without classes, one row
    return held.select(*dict.fromkeys([*keys, *by]), turn("v", "_by").alias("v"))


def poly_features(arrays: DataFrame, keys: Sequence[str], n: int = 5, *, align: Sequence[str] | None = None, most: int = 8) -> DataFrame:
    """(keys, features): Chebyshev coefficients 0..n of each waveform, and a tenth of its height; one fixed projection for all of a length.

    With ``align``, the columns of a class (none: all are one), waveforms are moved to the mean of their class first.
    """
    if align is not None:
        arrays = align_to_mean(arrays, keys, align, most=most)

    @F.pandas_udf("array<double>")
    def run(parts: pd.Series) -> pd.Series:
        out, basis = [], {}
        for v in parts:
            v = np.asarray(v, float)
            if len(v) not in basis:
                basis[len(v)] = np.linalg.pinv(np.polynomial.chebyshev.chebvander(np.linspace(-1, 1, len(v)), n))
            out.append([*(basis[len(v)] @ v), 0.1 * np.ptp(v)])
        return pd.Series(out)

    return arrays.select(*keys, run("v").alias("features"))


def tail_time_constant(arrays: DataFrame, keys: Sequence[str], dt: float, noise: Column | float) -> DataFrame:
    """(keys, tau, taustart) from the tail behind the last extremum over the noise; null where there is no decay."""
    noise = F.lit(noise) if isinstance(noise, (int, float)) else noise

    @F.pandas_udf("tau double, taustart double")
    def run(parts: pd.Series, level: pd.Series) -> pd.DataFrame:
        rows = []
        for v, s in zip(parts, level):
            v = np.asarray(v, float)
            high = np.flatnonzero((np.abs(v[1:-1]) > 4 * s) & (np.abs(v[1:-1]) >= np.abs(v[:-2])) & (np.abs(v[1:-1]) >= np.abs(v[2:])))
            got = K.tail_time_constant(np.arange(len(v)) * dt, v, int(high[-1]) + 1, s) if len(high) else None
            rows.append(got or (None, None))
        return pd.DataFrame(rows, columns=["tau", "taustart"], dtype="float64")

    return arrays.select(*keys, run("v", noise).alias("_r")).select(*keys, "_r.*")
