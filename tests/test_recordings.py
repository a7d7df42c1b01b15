"""Recordings cut into ranges, growing recordings, archives by member, writes that keep what others wrote."""

import struct
import tempfile
import wave
import zipfile
from pathlib import Path

import numpy as np
import pytest

from fieldwave.sources import readers as S
from fieldwave.sources import recordings as R

KEYS = ["recording", "channel", "block", "idx0"]


def folder():
    return Path(tempfile.mkdtemp(prefix="spark-"))


def write_wav(path, x, rate=1000, width=2):
    x = np.atleast_2d(x.T).T
    with wave.open(str(path), "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(x.astype(f"<i{width}").tobytes())


def blocks(df):
    return sorted((r.recording, r.channel, r.block, r.idx0, r.rate, tuple(r.v)) for r in df.collect())


def test_ranges_of_any_size_give_the_same_blocks(spark):
    """Four partitions and more, overlap over the cuts, several channels and rates, small files in one task."""
    d, rng = folder(), np.random.default_rng(1)
    write_wav(d / "long.wav", rng.integers(-9000, 9000, (10_123, 2)))
    write_wav(d / "fast.wav", rng.integers(-9000, 9000, 5000), rate=4410, width=4)
    for k in range(5):
        write_wav(d / f"small{k}.wav", rng.integers(-9000, 9000, 90 + k))
    write_wav(d / "none.wav", np.zeros(0))
    want = blocks(S.read_wav(spark, str(d), 0.5, 30))
    assert len(want) == 2 * 21 + 3 + 5
    for most in (9_000, 2_500, 777):
        df = S.read_wav(spark, str(d), 0.5, 30, partition_bytes=most)
        assert blocks(df) == want
    tasks = R.PcmReader(R.Options(str(d), 0.5, 30, 9_000, "report")).partitions()
    assert sum(any("long" in p[0] for p in t.parts) for t in tasks) >= 4
    assert len(R.PcmReader(R.Options(str(d / "small*.wav"), 0.5, 0, 64 << 20, "report")).partitions()) == 1
    assert blocks(S.read_wav(spark, str(d / "long.wav"), 0.5, 30)) == [b for b in want if b[0] == "long"]
    with wave.open(str(d / "long.wav")) as f:
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, 2) / 32768
    for _, c, b, i, _, v in (w for w in want if w[0] == "long"):
        assert i == 500 * b and np.array_equal(v, x[i : i + 530, c])


def test_headers():
    import io

    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    body = struct.pack("<5h", 1, 2, 3, 4, 5)
    riff = lambda *parts: b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"".join(parts)
    frames = lambda raw: R.read_header(io.BytesIO(raw), len(raw)).frames
    assert frames(riff(b"LIST" + struct.pack("<I", 3) + b"abc\0", fmt, b"data" + struct.pack("<I", 10), body)) == 5
    assert frames(riff(fmt, b"data" + struct.pack("<I", 4), body)) == 2
    assert frames(riff(fmt, b"data" + struct.pack("<I", 0), body)) == 5  # not filled in yet
    assert frames(riff(fmt, b"data" + struct.pack("<I", 0xFFFFFFFF), body[:-1])) == 4
    ds64 = b"ds64" + struct.pack("<IQQQI", 28, 0, 6, 3, 0)
    assert frames(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + ds64 + fmt + b"data" + struct.pack("<I", 0xFFFFFFFF) + body) == 3
    extensible = b"fmt " + struct.pack("<IHHIIHHHHIH14s", 40, 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 0, 1, b"\0" * 14)
    assert frames(riff(extensible, b"data" + struct.pack("<I", 10), body)) == 5
    for bad in (b"", b"no audio", riff(), riff(fmt), riff(b"data" + struct.pack("<I", 2) + b"ab"), riff(fmt.replace(struct.pack("<H", 1), struct.pack("<H", 3), 1), b"data" + struct.pack("<I", 0))):
        with pytest.raises((R.Unreadable, struct.error)):
            frames(bad)


def test_a_growing_recording_as_a_stream(spark):
    """A block comes once, when its overlap is there too; a second file and bad files on the way; a restart goes on where it stopped."""
    d, out, rng = folder(), folder(), np.random.default_rng(2)
    x = rng.integers(-9000, 9000, (2300, 2)).astype("<i2")
    head = lambda n: b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 1000, 4000, 4, 16) + b"data" + struct.pack("<I", n)
    (d / "bad.wav").write_bytes(b"RI")

    def run():
        stream = S.stream_wav(spark, str(d), 0.25, 20, partition_bytes=3000)
        q = stream.writeStream.format("parquet").option("path", str(out / "data")).option("checkpointLocation", str(out / "state")).trigger(once=True).start()
        q.awaitTermination()

    for n in (0, 100, 1000, 1019, 1020, 2300):
        (d / "a.wav").write_bytes(head(0) + x[:n].tobytes())
        if n == 1019:
            write_wav(d / "b.wav", x[:600])
        run()
        done = max(0, (n - 20) // 250)
        got = blocks(spark.read.schema(R.SCHEMA).parquet(str(out / "data"))) if n > 100 else []
        assert sorted({b[2] for b in got if b[0] == "a"}) == list(range(done))
    assert len(got) == len(set(got)) == 2 * (9 + 2)
    for name, c, b, i, _, v in got:
        assert np.array_equal(v, x[i : i + 270, c] / 32768)


def test_members_of_other_kinds_are_not_opened(spark):
    d = folder()
    table = "index,EODf,datapower\n-,Hz,dB\n0,123.5,-40.1\n"
    for k in range(3):
        with zipfile.ZipFile(d / f"r{k}.zip", "w") as z:
            z.writestr(f"sub/r{k}-c1-waveeodfs.csv", table)
            z.writestr(f"sub/r{k}-c1-wavephases-2.csv", "index,time\n-,ms\n1,2\n")
            z.writestr("notes.txt", "hello")
        raw = (d / f"r{k}.zip").read_bytes()
        (d / f"r{k}.zip").write_bytes(raw.replace(b"1,2\n", b"9,9\n"))  # its checksum is wrong: opening it fails
    (d / "broken.zip").write_bytes(b"PK nothing")
    members = S.bundle_members(spark, str(d))
    assert sorted((r.archive.rsplit("/", 1)[-1], r.ftype or "") for r in members.where("member is not null").collect()) == sorted((f"r{k}.zip", t) for k in range(3) for t in ("waveeodfs", "wavephases", ""))
    assert [r.archive.rsplit("/", 1)[-1] for r in members.where("error is not null").collect()] == ["broken.zip"]
    got = S.read_bundles(spark, str(d), "waveeodfs").collect()
    assert sorted((r.recording, r.EODf) for r in got) == [(f"r{k}", 123.5) for k in range(3)]
    with pytest.raises(Exception, match="CRC"):
        S.read_bundles(spark, str(d), "wavephases").collect()
    scan = [line for line in members._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in line]
    assert scan and all("content" not in line.split("ReadSchema")[1] for line in scan)  # names come without contents


def test_writes_replace_their_own_recordings_only(spark):
    d = str(folder() / "t")
    rows = lambda rec, xs: spark.createDataFrame([(rec, i, float(x)) for i, x in enumerate(xs)], "recording string, index int, time double")
    read = lambda: sorted((r["recording"], r["index"], r["time"]) for r in spark.read.parquet(d).collect())
    S.write_analysis(rows("a", [1, 2]), d, "wavephases")
    S.write_analysis(rows("b", [3]), d, "wavephases")
    assert read() == [("a", 0, 1000.0), ("a", 1, 2000.0), ("b", 0, 3000.0)]
    S.write_analysis(rows("a", [5]), d, "wavephases")
    assert read() == [("a", 0, 5000.0), ("b", 0, 3000.0)]
    from pyspark.sql import functions as F

    failing = rows("a", [6, 7]).repartition(2).withColumn("time", F.when(F.col("index") == 1, F.raise_error(F.lit("stopped")).cast("double")).otherwise(F.col("time")))
    with pytest.raises(Exception, match="stopped"):
        S.write_analysis(failing, d, "wavephases")
    assert read() == [("a", 0, 5000.0), ("b", 0, 3000.0)]
