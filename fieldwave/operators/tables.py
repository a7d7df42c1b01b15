"""Work on collected result tables: metadata, quality, harmonics and phases columns, limits and unions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.functions.columns import base_name, finite


@dataclass(frozen=True)
class WaveThresholds:
    """Limits for wave sources; a limit of 0 or less is off, but for the frequency range and the least power."""

    min_freq: float = 0.0
    max_freq: float = 2000.0
    max_clipped: float = 0.01
    max_phases: int = 4
    max_noise: float = 0.0
    max_rms_error: float = 0.05
    min_power: float = -100.0
    max_thd: float = 0.0
    max_db_diff: float = 20.0
    max_relampl_h1: float = 0.0
    max_relampl_h2: float = 0.0
    max_relampl_h3: float = 0.0


@dataclass(frozen=True)
class PulseThresholds:
    max_clipped: float = 0.01
    max_rms_error: float = 0.05


def adjust_to_temperature(df: DataFrame, meta: DataFrame, freq: str, temp: str, key: str, q10: float = 1.62, t_ref: float = 25.0) -> DataFrame:
    """Adds ``mean_temp`` (mean over the metadata, rounded to 0.1) and ``<freq>_adjusted`` (from each row's own temperature to the mean)."""
    from fieldwave.functions.columns import adjust_q10

    mean = meta.where(finite(F.col(temp))).agg(F.round(F.avg(temp), 1).alias("mean_temp"))
    rows = df.join(meta.select(key, temp), key, "left").crossJoin(F.broadcast(mean))  # one row
    ok = finite(F.col(temp)) & F.col("mean_temp").isNotNull()
    exact = F.col(freq) * F.pow(F.lit(q10), (F.col("mean_temp") - F.col(temp)) / 10)
    return rows.withColumn(f"{freq}_adjusted", F.when(ok, exact).otherwise(F.col(freq))).withColumn(f"{freq}_ref", adjust_q10(F.col(freq), F.col(temp), t_ref, q10))


def wave_quality(df: DataFrame, limits: WaveThresholds = WaveThresholds()) -> DataFrame:
    """Adds ``remove`` and ``skip_reason`` from the columns EODf, clipped, nphases, noise, rmserror, power, thd, dbdiff and relampl1..3."""
    c = F.col
    out_of_range = (c("EODf") < limits.min_freq) | (c("EODf") > limits.max_freq)
    rules = [("invalid EODf", out_of_range), ("weak power", c("power") < limits.min_power)]
    for name, col, most in (
        ("clipped", "clipped", limits.max_clipped),
        ("many phases", "nphases", limits.max_phases),
        ("noisy", "noise", limits.max_noise),
        ("bad fit", "rmserror", limits.max_rms_error),
        ("distorted", "thd", limits.max_thd),
        ("not smooth", "dbdiff", limits.max_db_diff),
        ("strong harmonic 1", "relampl1", limits.max_relampl_h1),
        ("strong harmonic 2", "relampl2", limits.max_relampl_h2),
        ("strong harmonic 3", "relampl3", limits.max_relampl_h3),
    ):
        if most > 0 and col in df.columns:
            rules.append((name, c(col) > most))
    reasons = F.concat_ws(", ", *(F.when(test, name) for name, test in rules))
    rough = c("dbdiff") > limits.max_db_diff if limits.max_db_diff > 0 and "dbdiff" in df.columns else F.lit(False)
    return df.withColumn("remove", F.coalesce(out_of_range | rough, F.lit(False))).withColumn("skip_reason", reasons)


def pulse_quality(df: DataFrame, limits: PulseThresholds = PulseThresholds()) -> DataFrame:
    """Adds ``skipped_clipped`` and ``skip_reason``; the clipped test is always on."""
    clipped = F.col("clipped") >= limits.max_clipped
    bad = F.col("rmserror") > limits.max_rms_error if limits.max_rms_error > 0 else F.lit(False)
    return df.withColumn("skipped_clipped", F.coalesce(clipped, F.lit(False))).withColumn("skip_reason", F.concat_ws(", ", F.when(clipped, "clipped"), F.when(bad, "bad fit")))


def quality_filter(fish: DataFrame, spectrum: DataFrame, keys: Sequence[str], limits: WaveThresholds = WaveThresholds()) -> DataFrame:
    """Rows of ``fish`` without a skip reason, judged with their first three harmonics."""
    first = spectrum.where(F.col("h").between(1, 3)).groupBy(*keys).pivot("h", [1, 2, 3]).agg(F.first("relampl"))
    first = first.select(*keys, *(F.col(str(h)).alias(f"relampl{h}") for h in (1, 2, 3)))
    return wave_quality(fish.join(first, list(keys), "left"), limits).where("skip_reason = ''").drop("remove", "skip_reason", "relampl1", "relampl2", "relampl3")


#: Named groups of property columns of wave and of pulse sources: fixed values.
WAVE_GROUPS = {
    "noise": ["noise", "rmserror", "power", "thd", "dbdiff", "ppampl", "relampl1", "relampl2", "relampl3"],
    "timing": ["peakwidth", "troughwidth", "ppdist", "phaseslope"],
    "time": ["peakwidth", "troughwidth", "ppdist", "phaseslope"],
    "wave": ["thd", "minwidth", "minppdist", "relmaxampl", "power2", "phaseslope"],
    "allpower": ["power", "thd", "power2"],
    "all": ["thd", "minwidth", "minppdist", "relmaxampl", "power2", "phaseslope"],
}
PULSE_GROUPS = {
    "noise": ["noise", "rmserror", "ppampl"],
    "timing": ["tstart", "tend", "width", "tau", "ppdist", "nphases", "firstphase", "lastphase", "iqrange"],
    "power": ["peakfreq", "peakenergy", "troughfreq", "troughenergy", "energyatt5", "energyatt50", "lowcutoff", "highcutoff"],
    "phases": ["nphases", "firstphase", "lastphase"],
    "area": ["polaritybalance"],
}
_HARMONIC = {"ampl": [(0, "ampl")], "relampl": [(1, "relampl")], "power": [(1, "relpower")], "relpower": [(1, "relpower")], "phase": [(1, "phase")], "all": [(1, "relampl"), (1, "phase")], "allpower": [(1, "relpower"), (1, "phase")]}


def select_property_columns(df: DataFrame, kind: str, groups: Sequence[str], *, n: int = 3, extra: Sequence[str] = ()) -> DataFrame:
    """Columns of named groups of ``wave`` or ``pulse`` sources, with n numbered ones where a group has these.

    Columns that don't exist are left out, one that is named twice is removed,
    and phase columns stay only where all their values are finite.
    """
    names: list[str] = []
    for g in groups:
        if g == "none":
            names = []
        elif kind == "wave" and (g in WAVE_GROUPS or g in _HARMONIC):
            names += WAVE_GROUPS.get(g, [])
            names += [f"{c}{k}" for k in range(n + 1) for least, c in _HARMONIC.get(g, []) if k >= least]
        elif kind == "pulse" and g in PULSE_GROUPS:
            names += PULSE_GROUPS[g] + ([f"P{k}area" for k in range(1, n + 1)] if g == "area" else [])
        elif kind == "pulse" and g in ("ampl", "relampl", "time", "width"):
            names += [f"P{k}{g}" for k in range(1, n + 1) if k != 1 or g in ("ampl", "width")]
        elif kind == "pulse" and g == "all":
            names += PULSE_GROUPS["phases"] + [f"P{k}{c}" for k in range(1, n + 1) for c in ("relampl", "time", "width") if k != 1 or c == "width"]
            names += ["tau", "ppdist", *PULSE_GROUPS["power"]]
        else:
            raise ValueError(f"{g!r} is no group of {kind} columns")
    names += list(extra)
    names = [c for c in names if c in df.columns and names.count(c) == 1]
    phases = [c for c in names if c[0] == "P" and c[1:2].isdigit()]
    if phases:
        whole = df.agg(*(F.bool_and(finite(F.col(c))).alias(c) for c in phases)).first()
        names = [c for c in names if c not in phases or whole[c]]
    return df.select(*names)


def strip_common_prefix(df: DataFrame, path: str) -> DataFrame:
    """``path`` without the leading folders that all rows share (the file name always stays)."""
    parts = df.select(F.posexplode(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)).alias("pos", "part"))
    same = parts.groupBy("pos").agg(F.count_distinct("part").alias("kinds"), F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(path).alias("total"))
    bad = same.crossJoin(F.broadcast(total)).where("kinds > 1 or rows < total").agg(F.min("pos").alias("cut"))
    length = same.agg((F.max("pos") + 1).alias("longest"))
    cut = bad.crossJoin(length).select(F.coalesce("cut", "longest", F.lit(0)).alias("_cut"))
    pieces = F.split(path, "/")
    return df.crossJoin(F.broadcast(cut)).withColumn(path, F.array_join(F.slice(pieces, F.col("_cut") + 1, F.size(pieces)), "/")).drop("_cut")


def join_metadata(fish: DataFrame, meta: DataFrame, rec_col: str, recording: str = "recording", *, order: str | None = None, skip: bool = False) -> DataFrame:
    """Metadata by base name of the recording, first row of a name wins; with ``skip`` rows without metadata go."""
    once = meta.withColumn("_key", F.lower(base_name(F.col(rec_col))))
    once = once.withColumn("_n", F.row_number().over(W.partitionBy("_key").orderBy(order or rec_col))).where("_n = 1").drop("_n", rec_col)
    return fish.withColumn("_key", F.lower(base_name(F.col(recording)))).join(once, "_key", "inner" if skip else "left").drop("_key")


def metadata_coverage(meta: DataFrame, fish: DataFrame, rec_col: str, recording: str = "recording") -> DataFrame:
    """Metadata rows without any recording, as rows of type ``none``."""
    seen = fish.select(F.lower(base_name(F.col(recording))).alias("_key"))
    rest = meta.withColumn("_key", F.lower(base_name(F.col(rec_col)))).join(seen, "_key", "left_anti").drop("_key")
    return rest.withColumn("type", F.lit("none")).withColumn("index", F.lit(None).cast("int")).withColumn("EODf", F.lit(None).cast("double"))


def attach_harmonics(fish: DataFrame, spectrum: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Adds ampl0..n and relampl, relpower, phase columns; the fundamental (h=0) has no relative ones."""
    wide = spectrum.where(F.col("h") <= n).groupBy(*keys).pivot("h", list(range(n + 1))).agg(*(F.first(c).alias(c) for c in ("amplitude", "relampl", "relpower", "phase")))
    cols = [F.col(f"{h}_amplitude").alias(f"ampl{h}") for h in range(n + 1)]
    for h in range(n + 1):
        cols += [F.col(f"{h}_{c}").alias(f"{c}{h}") for c in (("relampl", "relpower", "phase") if h else ("phase",))]
    return fish.join(wide.select(*keys, *cols), list(keys), "left")


def attach_phases(fish: DataFrame, phases: DataFrame, keys: Sequence[str], p0: int, p1: int) -> DataFrame:
    """Adds P<p>time, ampl, relampl, width for phases p0..p1; the first phase has no time and relampl."""
    wide = phases.where(F.col("p").between(p0, p1)).groupBy(*keys).pivot("p", list(range(p0, p1 + 1))).agg(*(F.first(c).alias(c) for c in ("time", "amplitude", "relampl", "width")))
    cols = []
    for p in range(p0, p1 + 1):
        for c, short in (("time", "time"), ("amplitude", "ampl"), ("relampl", "relampl"), ("width", "width")):
            if p != 1 or short in ("ampl", "width"):
                cols.append(F.col(f"{p}_{c}").alias(f"P{p}{short}"))
    return fish.join(wide.select(*keys, *cols), list(keys), "left")


def top_fish(df: DataFrame, n: int, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first n rows of each file (0: all)."""
    if n <= 0:
        return df
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def order_index(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "index") -> DataFrame:
    """Adds the position in the given order, from 0, within each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def renumber_fish(pulse: DataFrame, wave: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Pulse sources first, then wave sources, under one running index."""
    both = pulse.withColumn("type", F.lit("pulse")).unionByName(wave.withColumn("type", F.lit("wave")), allowMissingColumns=True)
    return order_index(both, keys, ["type", *order])


def all_table(wave: DataFrame, pulse: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The shared columns of both kinds, with their type."""
    pick = lambda df, kind: df.select(*(F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns), F.lit(kind).alias("type"))
    return pick(wave, "wave").unionByName(pick(pulse, "pulse"))


def union_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables of many files; columns missing in one are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def table_statistics(df: DataFrame, columns: Sequence[str], nbins: int = 4096) -> DataFrame:
    """One row per column: count, mean, std, min, exact quartiles (interpolated) and max.

    Three passes, each with map-side sums: range and moments; counts in even bins
    of the range; counts of the different values of those bins that hold a
    quartile, so no task sees more of a column than one bin's different values.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("s")).select("s.*")
    basic = df.agg(F.array(*(F.struct(
        F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
    ) for c in columns)).alias("all")).select(F.explode("all").alias("s")).select("s.*")
    span = F.broadcast(basic.select("column", "n", "min", "max"))  # a row per column
    bin_ = F.when(F.col("max") > F.col("min"), F.least(F.lit(nbins - 1), F.floor((F.col("x") - F.col("min")) / (F.col("max") - F.col("min")) * nbins))).otherwise(0)
    placed = long.where("x is not null").join(span, "column").select("column", "x", "n", bin_.alias("b"))
    w = W.partitionBy("column").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    bins = placed.groupBy("column", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))  # at most nbins a column
    bins = bins.withColumn("ahead", F.coalesce(F.sum("c").over(w), F.lit(0)))
    want = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("n") - 1)).alias("rank")) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))))
    ranks = basic.select("column", "n", want.alias("r")).select("column", "r.*")
    spots = ranks.select("column", "name", "rank", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("k")).distinct()
    hit = bins.join(spots, "column").where((F.col("k") >= F.col("ahead")) & (F.col("k") < F.col("ahead") + F.col("c"))).select("column", "b", "ahead", "name", "rank", "k")
    values = placed.join(F.broadcast(hit.select("column", "b", "ahead").distinct()), ["column", "b"]).groupBy("column", "b", "ahead", "x").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("column", "b").orderBy("x"))
    values = values.withColumn("stop", F.col("ahead") + upto).withColumn("start", F.col("stop") - F.col("c"))
    found = hit.drop("ahead").join(values.select("column", "b", "x", "start", "stop"), ["column", "b"]).where("k >= start and k < stop")
    low, high = F.min_by("x", "k"), F.max_by("x", "k")
    each = found.groupBy("column", "name").agg((low + (high - low) * (F.first("rank") - F.min("k"))).alias("q"))
    wide = each.groupBy("column").pivot("name", ["q1", "median", "q3"]).agg(F.first("q"))
    return basic.join(wide, "column", "left").select("column", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def parse_analysis_path(df: DataFrame, path: str) -> DataFrame:
    """Adds recording, base_path, channel, time, ftype, index and ext from names like ``DIR/REC-c1-t4s-wavefish-0.csv``.

    What a name leaves out is -1 (channel, index) or null (time).
    """
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    ext = F.regexp_extract(name, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    kinds = "waveeodfs|wavefish|pulsefish|eodwaveform|wavespectrum|wavephases|pulsespectrum|pulsephases|pulsegaussians|pulsetimes"
    tail = rf"^(.*?)(?:-c(\d+))?(?:-t([0-9.]+)s)?(?:-?({kinds}))?(?:-(\d+))?$"
    num = lambda k: F.regexp_extract(stem, tail, k)
    whole = lambda x: F.when(x == "", -1).otherwise(x.cast("int"))
    return (
        df.withColumn("recording", num(1))
        .withColumn("base_path", F.when(F.contains(p, F.lit("/")), F.regexp_replace(p, r"[^/]*$", "")).otherwise(F.lit("")))
        .withColumn("channel", whole(num(2)))
        .withColumn("time", F.when(num(3) == "", None).otherwise(num(3).cast("double")))
        .withColumn("ftype", num(4))
        .withColumn("index", whole(num(5)))
        .withColumn("ext", ext)
    )
