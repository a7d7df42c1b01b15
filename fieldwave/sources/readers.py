"""Readers and writers of recordings and analysis tables; inside the library all values are in SI units and fractions."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwave.operators.tables import parse_analysis_path
from fieldwave.sources.recordings import PcmDataSource, filesystem

_HELD = 4 << 20  # bytes of small members that a task hands on at once

#: Columns of each analysis table and the factor from file units to library units: fixed values.
TABLES: dict[str, dict[str, float | None]] = {
    "waveeodfs": {"index": 1, "EODf": 1, "datapower": 1},
    "eodwaveform": {"time": 1e-3, "mean": 1, "sem": 1, "fit": 1, "tailfit": 1},
    "wavespectrum": {"harmonics": 1, "frequency": 1, "amplitude": 1, "relampl": 1e-2, "relpower": 1, "phase": 1, "datapower": 1},
    "wavephases": {"index": 1, "time": 1e-3, "amplitude": 1, "relampl": 1e-2, "width": 1e-3, "zeros": 1e-3},
    "pulsephases": {"type": None, "index": 1, "time": 1e-3, "amplitude": 1, "relampl": 1e-2, "width": 1e-3, "area": 1, "relarea": 1e-2, "zeros": 1e-3},
    "pulsespectrum": {"frequency": 1, "energy": 1, "gaussian": 1},
    "pulsegaussians": {"times": 1e-3, "amplitudes": 1, "stdevs": 1e-3},
    "pulsetimes": {"time": 1},
    "wavefish": {
        "twin": 1, "window": 1, "channel": 1, "winclipped": 1e-2, "samplerate": 1e3, "nfft": 1, "dfreq": 1, "index": 1, "n": 1, "flipped": 1, "EODf": 1, "period": 1e-3, "ppampl": 1, "relmaxampl": 1e-2, "power": 1,
        "datapower": 1, "noise": 1e-2, "rmserror": 1e-2, "clipped": 1e-2, "ppdist": 1e-2, "minppdist": 1e-2, "peakwidth": 1e-2, "troughwidth": 1e-2, "minwidth": 1e-2, "phasethresh": 1e-2, "nphases": 1, "thd": 1e-2,
        "maxharmonics": 1, "power2": 1, "dbdiff": 1, "phaseslope": 1,
    },
    "pulsefish": {
        "twin": 1, "window": 1, "channel": 1, "winclipped": 1e-2, "samplerate": 1e3, "nfft": 1, "dfreq": 1, "index": 1, "n": 1, "flipped": 1, "EODf": 1, "period": 1e-3, "aoffs": 1, "ppampl": 1, "relmaxampl": 1e-2, "noise": 1e-2,
        "rmserror": 1e-2, "clipped": 1e-2, "ppdist": 1e-3, "startendthresh": 1e-2, "tstart": 1e-3, "tend": 1e-3, "width": 1e-3, "totalarea": 1, "polaritybalance": 1e-2, "median": 1e-3, "quartile1": 1e-3, "quartile3": 1e-3,
        "iqrange": 1e-3, "phasethresh": 1e-2, "nphases": 1, "firstphase": 1, "lastphase": 1, "tau": 1e-3, "taustart": 1e-3, "peakfreq": 1, "peakenergy": 1, "troughfreq": 1, "troughenergy": 1, "eodfenergy": 1,
        "energyatt5": 1, "energyatt50": 1, "lowcutoff": 1, "highcutoff": 1,
    },
}


def _named(df: DataFrame, ftype: str) -> DataFrame:
    """Text cells of a table file to typed columns in library units; '-' and 'nan' are null."""
    out = []
    for name, factor in TABLES[ftype].items():
        if name not in df.columns:
            continue
        c = F.trim(F.col(name))
        c = F.when(~F.lower(c).isin("-", "nan", ""), c)
        out.append((c if factor is None else F.try_multiply(c.try_cast("double"), F.lit(float(factor)))).alias(name))
    return df.select("path", *out)


def _lines(df: DataFrame, ftype: str, sep: str) -> DataFrame:
    """(path, cells by name) of table files given as their lines (path, lines): the first line that begins with a known column is the head, the next one holds units if it has other text than '-', 'nan' or 'p'.

    All later lines are rows; a cell that is no number is null in a number's column.
    Head and units are found in the file's own row, so files are read once and never meet.
    """
    names = list(TABLES[ftype])
    clean = lambda x: F.trim(F.regexp_replace(x, r"^#|\(.*\)$|/.*$", ""))
    cells = lambda line: F.transform(F.split(line, sep), clean)
    first = lambda ok: F.array_min(F.transform("lines", lambda x, n: F.when((F.trim(x) != "") & ok(x, n), n)))
    files = df.withColumn("_at", first(lambda x, n: clean(F.get(F.split(x, sep, 2), F.lit(0))).isin(names))).where("_at is not null")
    files = files.withColumn("_second", first(lambda x, n: n > F.col("_at"))).withColumn("_head", cells(F.get("lines", F.col("_at"))))
    rows = files.select("path", "_at", "_second", "_head", F.posexplode("lines").alias("n", "value")).where("n > _at and trim(value) <> ''")
    rows = rows.select("path", "n", "_second", "_head", cells(F.col("value")).alias("cells"))
    unit = F.exists("cells", lambda x: x.try_cast("double").isNull() & ~F.lower(x).isin("-", "nan", "", "p"))
    body = rows.where(~((F.col("n") == F.col("_second")) & unit))
    byname = F.map_from_arrays(F.col("_head"), F.slice("cells", F.lit(1), F.size("_head")))
    return body.withColumn("m", byname).select("path", *(F.try_element_at("m", F.lit(n)).alias(n) for n in names))


def read_analysis(spark: SparkSession, path: str, ftype: str, sep: str = ",") -> DataFrame:
    """A kind of analysis table from its files, with recording, channel, time and index from the file names."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter=f"*{ftype}*").select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return _keyed(_named(_lines(text, ftype, sep), ftype))


def _keyed(df: DataFrame) -> DataFrame:
    keyed = parse_analysis_path(df.withColumnsRenamed({"index": "_index", "channel": "_channel", "time": "_time"}), "path").drop("base_path", "ftype", "ext", "path")
    names = {"index": "fish", "channel": "rec_channel", "time": "rec_time"}
    return keyed.withColumnsRenamed(names).withColumnsRenamed({"_index": "index", "_channel": "channel", "_time": "time"})


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bundle_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, ftype, bytes): what the central directories of the zip archives in a folder list; nothing is unpacked.

    An archive that is none has a row without member, with its ``error``.
    """

    def listed(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            rows = []
            for uri in pdf["path"]:
                store, at = filesystem(uri)
                with store.open_input_file(at) as fh:
                    try:
                        if fh.size() < 22:  # the shortest archive, an empty one
                            raise zipfile.BadZipFile("File is not a zip file")
                        rows += [(uri, m.filename, m.file_size, None) for m in zipfile.ZipFile(fh).infolist() if not m.is_dir()]
                    except zipfile.BadZipFile as e:
                        rows.append((uri, None, None, str(e)))
            yield pd.DataFrame({"archive": [r[0] for r in rows], "member": [r[1] for r in rows], "bytes": pd.array([r[2] for r in rows], "Int64"), "error": [r[3] for r in rows]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")  # names only: contents are not read
    found = files.mapInPandas(listed, "archive string, member string, bytes long, error string")
    kind = parse_analysis_path(found.withColumnRenamed("error", "_error"), "member").select("archive", "member", F.when(F.col("ftype") != "", F.col("ftype")).alias("ftype"), "bytes", "_error")
    return kind.withColumnRenamed("_error", "error")


def read_bundles(spark: SparkSession, path: str, ftype: str, sep: str = ",") -> DataFrame:
    """A kind of analysis table out of zip archives, one per recording.

    Members of other kinds are not opened.  Members, not archives, are dealt
    to tasks, so a large archive is read by many.
    """

    def unpack(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            held, size = [], 0
            for uri, members in pdf.groupby("archive")["member"]:
                store, at = filesystem(uri)
                with store.open_input_file(at) as fh, zipfile.ZipFile(fh) as z:
                    for name in members:
                        raw = z.read(name)
                        held.append((f"{uri.rsplit('/', 1)[0]}/{name}", raw.decode().splitlines()))
                        size += len(raw)
                        if size > _HELD:
                            yield pd.DataFrame(held, columns=["path", "lines"])
                            held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "lines"])

    wanted = bundle_members(spark, path).where(F.col("ftype") == ftype).select("archive", "member")
    dealt = wanted.repartition(_parts(spark), "archive", "member").sortWithinPartitions("archive", "member")
    text = dealt.mapInPandas(unpack, "path string, lines array<string>")
    return _keyed(_named(_lines(text, ftype, sep), ftype))


def write_analysis(df: DataFrame, path: str, ftype: str, fmt: str = "parquet", by: Sequence[str] = ("recording",)) -> None:
    """A table in file units, partitioned by recording.

    Only the recordings in ``df`` are replaced, those written before stay.  Files
    are put in place when all are written, so a write that fails leaves what was there.
    """
    factors = TABLES[ftype]
    cols = [(F.col(c) / float(factors[c])).alias(c) if factors.get(c) not in (None, 1) else F.col(c) for c in df.columns]
    writer = df.select(*cols).write.partitionBy(*by).format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.options(**({"header": True} if fmt == "csv" else {})).save(path)


def read_wav(spark: SparkSession, path: str, block_seconds: float = 1.0, overlap: int = 0, errors: str = "report", partition_bytes: int = 128 << 20) -> DataFrame:
    """blocks(recording, channel, block, idx0, rate, v, error) of PCM files; values are fractions of full scale.

    A file of any size is cut into ranges of ``partition_bytes``, read by as many
    tasks, block by block.  One that can't be decoded is a row with its ``error`` and no
    block, or stops the job with ``errors="raise"``.
    """
    return _pcm(spark.read, spark, path, block_seconds, overlap, partition_bytes).option("errors", errors).load()


def stream_wav(spark: SparkSession, path: str, block_seconds: float = 1.0, overlap: int = 0, partition_bytes: int = 128 << 20) -> DataFrame:
    """The same as a stream of recordings that grow: a block comes once, when it is complete with its overlap."""
    return _pcm(spark.readStream, spark, path, block_seconds, overlap, partition_bytes).load()


def _pcm(reader, spark: SparkSession, path: str, block_seconds: float, overlap: int, partition_bytes: int):
    spark.dataSource.register(PcmDataSource)
    return reader.format("pcm").options(path=path, blockSeconds=str(block_seconds), overlap=str(overlap), partitionBytes=str(partition_bytes))


def read_samples(spark: SparkSession, path: str, fmt: str = "parquet", block: int = 65_536) -> DataFrame:
    """blocks(recording, channel, block, idx0, v) from a table samples(recording, channel, idx, v)."""
    reader = spark.read.schema("recording string, channel int, idx long, v double") if fmt == "csv" else spark.read
    rows = (reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)).select("recording", "channel", "idx", "v")
    got = rows.groupBy("recording", "channel", F.floor(F.col("idx") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"))
    return got.select("recording", "channel", "block", F.col("s")[0]["idx"].alias("idx0"), F.transform("s", lambda x: x["v"]).alias("v"))


def exploded(blocks: DataFrame) -> DataFrame:
    """samples(recording, channel, idx, v) of blocks."""
    return blocks.select("recording", "channel", "idx0", F.posexplode("v").alias("k", "v")).select("recording", "channel", (F.col("idx0") + F.col("k")).alias("idx"), "v")


def read_templates(spark: SparkSession, species_file: str, waveforms: DataFrame, spectra: DataFrame) -> DataFrame:
    """templates(kind, species, EODf, ttime, tv) from a species list and the tables it names.

    Lines are ``name: file [: EODf]`` under the sections ``wavefish:`` and ``pulsefish:``;
    wave templates are in periods, their EODf from the line or else from the first
    row of the spectrum; what is unknown is skipped.
    ``waveforms(file, time, v)``, ``spectra(file, frequency)``.
    """
    from pyspark.sql import Window as W

    lines = spark.read.text(species_file, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "value"))
    lines = lines.withColumn("section", F.when(F.lower(F.trim("value")).isin("wavefish:", "pulsefish:"), F.regexp_replace(F.lower(F.trim("value")), ":", "")))
    rows = lines.withColumn("kind", F.last("section", ignorenulls=True).over(W.orderBy("n"))).where("section is null and kind is not null and value like '%:%'")  # one short file
    part = lambda k: F.trim(F.get(F.split("value", ":"), F.lit(k)))
    rows = rows.select("kind", part(0).alias("species"), part(1).alias("file"), part(2).try_cast("double").alias("given"))
    first = spectra.groupBy("file").agg(F.min("frequency").alias("f0"))
    rows = rows.join(first, "file", "left").withColumn("EODf", F.coalesce("given", "f0")).where("kind = 'pulsefish' or EODf is not null")
    waves = waveforms.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("time", "v"))).alias("s"))
    scale = F.when(F.col("kind") == "wavefish", F.col("EODf")).otherwise(F.lit(1.0))
    return rows.join(waves, "file").select("kind", "species", "EODf", F.transform("s", lambda x: x["time"] * scale).alias("ttime"), F.transform("s", lambda x: x["v"]).alias("tv"))
