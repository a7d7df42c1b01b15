"""Readers and writers on small files."""

import tempfile
import wave
import zipfile
from pathlib import Path

import numpy as np
import pytest

from fieldwave.sources import readers as S

TABLE = "# a comment\nindex,EODf,datapower\n-,Hz,dB\n0,123.5,-40.1\n1,nan,-\n"
PHASES = "index, time , amplitude, relampl, width, zeros\n-,ms,mV,%,ms,ms\n1,0.5,2.0,100,0.25,nan\n"


def test_analysis_tables(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    (d / "rec1-c2-t4s-waveeodfs.csv").write_text(TABLE)
    (d / "rec1-c2-t4s-wavephases-3.csv").write_text(PHASES)
    rows = list(map(tuple, S.read_analysis(spark, str(d), "waveeodfs").select("recording", "rec_channel", "rec_time", "fish", "index", "EODf", "datapower").orderBy("index").collect()))
    assert rows == [("rec1", 2, 4.0, -1, 0.0, 123.5, -40.1), ("rec1", 2, 4.0, -1, 1.0, None, None)]
    p = S.read_analysis(spark, str(d), "wavephases").collect()[0]
    assert (p["fish"], p["time"], p["relampl"], p["width"], p["zeros"]) == (3, 5e-4, 1.0, 2.5e-4, None)


def test_rows_with_text_cells_stay(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    (d / "rec1-waveeodfs.csv").write_text("index,EODf,datapower\n-,Hz,dB\n0,123.5,loud\n1,99,-3\n")
    (d / "rec2-waveeodfs.csv").write_text("index,EODf,datapower\n7,50,-1\n")
    rows = sorted(map(tuple, S.read_analysis(spark, str(d), "waveeodfs").select("recording", "index", "EODf", "datapower").collect()))
    assert rows == [("rec1", 0.0, 123.5, None), ("rec1", 1.0, 99.0, -3.0), ("rec2", 7.0, 50.0, -1.0)]


def test_bundles(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    with zipfile.ZipFile(d / "rec9.zip", "w") as z:
        z.writestr("rec9-c1-waveeodfs.csv", TABLE)
        z.writestr("rec9-c1-other.csv", "x\n1\n")
    rows = S.read_bundles(spark, str(d), "waveeodfs").collect()
    assert {(r["recording"], r["rec_channel"], r["EODf"]) for r in rows} == {("rec9", 1, 123.5), ("rec9", 1, None)}


def test_write_in_file_units(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    df = spark.createDataFrame([("r", 1, 0.5, 0.25)], "recording string, index int, time double, relampl double")
    S.write_analysis(df, d, "wavephases")
    back = spark.read.parquet(d).collect()[0]
    assert (back["time"], back["relampl"], back["recording"]) == (500.0, 25.0, "r")


def test_wav_blocks(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    x = (np.sin(np.arange(2500) / 9) * 20_000).astype("<i2")
    with wave.open(str(d / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(1000)
        f.writeframes(np.column_stack([x, -x]).astype("<i2").tobytes())
    (d / "bad.wav").write_bytes(b"no audio")
    for width, raw in ((1, bytes([0, 128, 255])), (3, b"\x00\x00\x40" * 3), (4, b"\x00\x00\x00\xc0" * 3)):
        with wave.open(str(d / f"w{width}.wav"), "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(width)
            f.setframerate(1000)
            f.writeframes(raw)
    every = S.read_wav(spark, str(d), 1.0)
    assert {r["recording"]: list(np.round(r["v"], 6)) for r in every.where("recording like 'w%'").collect()} == {"w1": [-1.0, 0.0, 0.992188], "w3": [0.5] * 3, "w4": [-0.5] * 3}
    (bad,) = every.where("error is not null").collect()
    assert bad["recording"] == "bad" and bad["v"] is None and bad["block"] is None
    with pytest.raises(Exception, match="bad.wav"):
        S.read_wav(spark, str(d), errors="raise").count()
    blocks = every.where("recording = 'a'")
    assert {(r["channel"], r["block"], r["idx0"], len(r["v"])) for r in blocks.collect()} == {(c, b, b * 1000, min(1000, 2500 - b * 1000)) for c in (0, 1) for b in (0, 1, 2)}
    samples = S.exploded(blocks).where("channel = 1").orderBy("idx").collect()
    assert np.allclose([r["v"] for r in samples], -x / 32768)


def test_templates(spark):
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    (d / "species.cfg").write_text("wavefish:\n A. one : fa : 100\n B. two: fb\n C. lost: fc\npulsefish:\n G. three: fp\n")
    waves = spark.createDataFrame([(f, t * 0.001, float(t)) for f in ("fa", "fb", "fc", "fp") for t in range(3)], "file string, time double, v double")
    spectra = spark.createDataFrame([("fb", 50.0), ("fb", 100.0)], "file string, frequency double")
    got = {r["species"]: (r["kind"], r["EODf"], round(r["ttime"][2], 6)) for r in S.read_templates(spark, str(d / "species.cfg"), waves, spectra).collect()}
    assert got == {"A. one": ("wavefish", 100.0, 0.2), "B. two": ("wavefish", 50.0, 0.1), "G. three": ("pulsefish", None, 0.002)}


def test_table_files_are_read_without_a_join(spark):
    """Heads and units stand in a file's own row: nothing that grows with the number of files is broadcast or shuffled for them."""
    d = Path(tempfile.mkdtemp(prefix="spark-"))
    for k in range(3):
        text = f"# made by hand\n\n{TABLE}" if k else "index,EODf\n5,7\n"
        (d / f"rec{k}-waveeodfs.csv").write_text(text)
        with zipfile.ZipFile(d / f"rec{k}.zip", "w") as z:
            z.writestr(f"rec{k}-waveeodfs.csv", text)
    for rows in (S.read_analysis(spark, str(d), "waveeodfs"), S.read_bundles(spark, str(d), "waveeodfs")):
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r["recording"], r["index"], r["EODf"], r["datapower"]) for r in rows.collect()), key=str)
        assert got == sorted([("rec0", 5.0, 7.0, None), *((f"rec{k}", i, f, p) for k in (1, 2) for i, f, p in ((0.0, 123.5, -40.1), (1.0, None, None)))], key=str)
