"""Queries over files: recordings, analysis tables, archives and templates are written by tasks, then read by the sources."""

from __future__ import annotations

import io
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldwave.operators import waveforms as A
from fieldwave.operators.stretches import each_stretch
from fieldwave.sources import readers as IO
from fieldwave.sources.recordings import filesystem
from fieldwave.sources.shared import scratch

from .bind import SAMPLES, WAVES, r6, samples, waveforms


def _files(rows, keys, target, contents):
    """Writes what ``contents(pdf)`` gives, (name, bytes), of each group of rows, a channel each; returns the folder."""

    def write(parts: list[pd.DataFrame]) -> list[tuple]:
        store, root = filesystem(target)
        store.create_dir(root, recursive=True)
        made = contents(pd.concat(parts))
        for name, raw in made:
            with store.open_output_stream(f"{root}/{name}") as fh:
                fh.write(raw)
        return [(len(made),)]

    held = each_stretch(rows.repartition(*keys), keys, ["idx"], "n int", list, lambda parts, pdf: parts.append(pdf) or [], write)
    held.write.format("noop").mode("overwrite").save()
    return target


def _rows(spark, sf_dir):
    return samples(spark, sf_dir).select(F.col("channel").cast("int").alias("channel"), "idx", "v")


def pcm_files(spark, sf_dir):
    """Each channel's samples as a 16-bit recording of two channels, the second turned, read in blocks of 16 with the next 4 at their end."""

    def recording(pdf):
        x, out = np.floor(pdf["v"].to_numpy() * 16).clip(-32767, 32767).astype("<i2"), io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(2)
            f.setframerate(1600)
            f.writeframes(np.column_stack([x, -x]).tobytes())
        return [(f"rec{pdf['channel'].iloc[0]}.wav", out.getvalue())]

    path = _files(_rows(spark, sf_dir), ["channel"], scratch(spark, "pcm"), recording)
    blocks = IO.read_wav(spark, path, 0.01, 4).where("error is null")
    return blocks.select("recording", "channel", "block", F.posexplode("v").alias("pos", "v"), "rate")


def _table(pdf, offset=0.0):
    lines = "".join(f"{i},{v + offset!r},{-i / 4}\n" for i, v in zip(pdf["idx"].tolist(), pdf["v"].tolist()))
    return f"index,EODf,datapower\n-,Hz,dB\n{lines}".encode()


def analysis_files(spark, sf_dir):
    """Each channel's samples as a table file, beside one of another kind, read as one table."""

    def tables(pdf):
        k = pdf["channel"].iloc[0]
        return [(f"rec{k}-c{k % 4}-t{k / 2}s-waveeodfs.csv", _table(pdf)), (f"rec{k}-c{k % 4}-wavephases-{k % 3}.csv", b"index,time\n-,ms\n1,2\n")]

    path = _files(_rows(spark, sf_dir), ["channel"], scratch(spark, "tables"), tables)
    return IO.read_analysis(spark, path, "waveeodfs").select("recording", "rec_channel", "rec_time", F.col("index").cast("int").alias("index"), "EODf", "datapower")


def bundles(spark, sf_dir):
    """The same out of one archive per channel."""

    def archive(pdf):
        k, out = pdf["channel"].iloc[0], io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"rec{k}-c{k % 4}-waveeodfs.csv", _table(pdf, 1.0))
            z.writestr(f"rec{k}-c{k % 4}-wavephases-1.csv", b"index,time\n-,ms\n1,2\n")
        return [(f"rec{k}.zip", out.getvalue())]

    path = _files(_rows(spark, sf_dir), ["channel"], scratch(spark, "bundles"), archive)
    return IO.read_bundles(spark, path, "waveeodfs").select("recording", "rec_channel", F.col("index").cast("int").alias("index"), "EODf", "datapower")


def templates(spark, sf_dir):
    """Templates of a species list: even labels as waves in periods, odd ones as pulses, of mean waveforms."""
    mean = A.mean_waveform(waveforms(spark, sf_dir).withColumnRenamed("id", "event"), ["label"])
    files = mean.select(F.concat(F.lit("file"), "label").alias("file"), "label", (F.col("pos") / 64).alias("time"), F.col("mean").alias("v"))
    lines = files.select("label", "file").distinct().select((F.col("label") % 2).alias("kind"), F.concat(F.lit(" A. kind "), "label", F.lit(" : "), "file", F.when(F.col("label") % 4 == 0, F.concat(F.lit(" : "), (F.col("label") + 10).cast("string"))).otherwise("")).alias("line"))
    text = lines.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")).select("kind", F.concat(F.when(F.col("kind") == 0, "wavefish:\n").otherwise("pulsefish:\n"), "lines").alias("value"))
    path = scratch(spark, "species")
    text.orderBy("kind").coalesce(1).select("value").write.text(path)
    spectra = files.where("label % 2 = 0 and label % 4 <> 0").select("file", F.explode(F.array(F.col("label") + 20.0, F.col("label") + 40.0)).alias("frequency")).distinct()
    found = IO.read_templates(spark, path, files.select("file", "time", "v"), spectra)
    return found.select("kind", "species", "EODf", F.posexplode(F.arrays_zip("ttime", "tv")).alias("pos", "s")).select("kind", "species", "EODf", "pos", r6("s.ttime").alias("t"), r6("s.tv").alias("v"))


QUERIES = {
    "s1_pcm_files": pcm_files,
    "s3_analysis_files": analysis_files,
    "s4_bundles": bundles,
    "s9_templates": templates,
}
SQL = {
    "s1_pcm_files": f"""WITH {SAMPLES}, q AS (SELECT 'rec' || channel AS recording, idx, greatest(-32767, least(32767, floor(v * 16)))::INT AS x FROM s),
c AS (SELECT recording, 0 AS channel, idx, x / 32768 AS v FROM q UNION ALL SELECT recording, 1, idx, -x / 32768 FROM q),
o AS (SELECT unnest([0, 1]) AS back)
SELECT recording, channel::INT AS channel, (idx >> 4) - back AS block, ((idx & 15) + 16 * back)::INT AS pos, v, 1600.0::DOUBLE AS rate FROM c, o WHERE back = 0 OR (idx & 15) < 4 AND idx >= 16""",
    "s3_analysis_files": f"WITH {SAMPLES} SELECT 'rec' || channel AS recording, (channel % 4)::INT AS rec_channel, (channel / 2)::DOUBLE AS rec_time, idx::INT AS index, v AS EODf, -idx / 4 AS datapower FROM s",
    "s4_bundles": f"WITH {SAMPLES} SELECT 'rec' || channel AS recording, (channel % 4)::INT AS rec_channel, idx::INT AS index, v + 1 AS EODf, -idx / 4 AS datapower FROM s",
    "s9_templates": f"""WITH {WAVES}, m AS (SELECT label, pos, avg(v) AS v FROM w GROUP BY ALL),
f AS (SELECT *, CASE WHEN label % 4 = 0 THEN label + 10.0 WHEN label % 2 = 0 THEN label + 20.0 END::DOUBLE AS f FROM m)
SELECT CASE WHEN label % 2 = 0 THEN 'wavefish' ELSE 'pulsefish' END AS kind, 'A. kind ' || label AS species, f AS EODf, pos::INT AS pos, round(pos / 64 * coalesce(f, 1), 6) AS t, round(v, 6) AS v FROM f""",
}
