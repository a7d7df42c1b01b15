"""A data source for PCM recordings: a file is cut into byte ranges, each a partition, whatever its size.

Planning needs file sizes only; a task reads a file's header and then the blocks
that begin in its range.  As a stream the same source gives the blocks of
recordings that grow, once they are complete.
"""

from __future__ import annotations

import fnmatch
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "recording string, channel int, block bigint, idx0 bigint, rate double, v array<double>, error string"
_ARROW = pa.schema([("recording", pa.string()), ("channel", pa.int32()), ("block", pa.int64()), ("idx0", pa.int64()), ("rate", pa.float64()), ("v", pa.list_(pa.float64())), ("error", pa.string())])
_OPEN = 1 << 20  # what opening a file counts for, in bytes


class Unreadable(ValueError):
    """A file that is no PCM recording."""


def filesystem(uri: str):
    """A file system that tasks can open, and the path in it (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def list_files(uri: str, pattern: str = "*.wav") -> list[tuple[str, int]]:
    """(path, size) of a file, of the files in a folder that match ``pattern``, or of those that match a pattern in the last part of the path."""
    from pyarrow import fs

    store, path = filesystem(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    folder, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        path, pattern = folder, last
    info = store.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(prefix + path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = store.get_file_info(fs.FileSelector(path))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


@dataclass(frozen=True)
class Header:
    rate: int
    channels: int
    width: int  # bytes per sample
    start: int  # where the samples begin
    frames: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def read_header(fh, size: int) -> Header:
    """Header of a RIFF or RF64 file of that size; a length that was not filled in, or reaches beyond the end, gives what is there."""
    head = fh.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise Unreadable("file does not start with RIFF id" if head[:4] not in (b"RIFF", b"RF64") else "not a WAVE file")
    kind, long, at = None, None, 12
    while True:
        fh.seek(at)
        name, n = (struct.unpack("<4sI", raw) if len(raw := fh.read(8)) == 8 else (b"", 0))
        if not name:
            raise Unreadable("fmt chunk and/or data chunk missing")
        if name == b"ds64":
            long = struct.unpack("<QQ", fh.read(16))[1]
        elif name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", fh.read(16))
            if tag == 0xFFFE and n >= 40:
                tag = struct.unpack("<H", fh.read(24)[8:10])[0]
            if tag != 1 or not channels or bits not in (8, 16, 24, 32):
                raise Unreadable(f"unknown format: {tag}, {bits} bits")
            kind = (rate, channels, bits // 8)
        elif name == b"data":
            if kind is None:
                raise Unreadable("data chunk before fmt chunk")
            there, said = size - at - 8, long if n == 0xFFFFFFFF and long else n
            used = there if said in (0, 0xFFFFFFFF) else min(said, there)
            return Header(*kind, at + 8, max(0, used) // (kind[1] * kind[2]))
        at += 8 + n + (n & 1)


def samples_of(raw: bytes, header: Header) -> np.ndarray:
    """(frames, channels): samples of 8, 16, 24 or 32 bits as fractions of full scale."""
    width = header.width
    raw = raw[: len(raw) // header.frame * header.frame]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    return x.reshape(-1, header.channels)


def recording_name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, end) of the ranges of a task, or (path, size, first block, end) where ``blocks``."""

    parts: list[tuple[str, int, int, int]]
    blocks: bool = False


@dataclass
class Options:
    """seconds of a block, samples of the next one at its end, bytes of a partition, and what becomes of files that can't be read."""

    path: str
    seconds: float
    overlap: int
    most: int
    errors: str

    def size(self, header: Header) -> int:
        return max(1, int(self.seconds * header.rate))

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        for path, size, first, end in task.parts:
            store, at = filesystem(path)
            with store.open_input_file(at) as fh:
                try:
                    header = read_header(fh, size)
                except (Unreadable, struct.error) as e:
                    if self.errors == "raise":
                        raise ValueError(f"{path}: {e}") from e
                    if first == 0:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([recording_name(path), None, None, None, None, None, str(e)], _ARROW.types)], schema=_ARROW)
                    continue
                n, width = self.size(header), self.size(header) * header.frame
                begin = lambda byte: 0 if byte <= 0 else max(0, -(-(byte - header.start) // width))  # the first block that begins at or behind a byte  # noqa: B023, E731
                blocks = range(first, end) if task.blocks else range(begin(first), min(begin(end), -(-header.frames // n)))
                for b in blocks:
                    fh.seek(header.start + b * width)
                    want = min(n + self.overlap, header.frames - b * n)
                    x = samples_of(fh.read(want * header.frame), header)
                    c = header.channels
                    flat = pa.ListArray.from_arrays(np.arange(c + 1, dtype=np.int32) * len(x), pa.array(np.ascontiguousarray(x.T).ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([recording_name(path)] * c), pa.array(range(c), pa.int32()), pa.array([b] * c, pa.int64()), pa.array([b * n] * c, pa.int64()), pa.array([float(header.rate)] * c), flat, pa.nulls(c, pa.string())], schema=_ARROW)


class PcmReader(DataSourceReader):
    def __init__(self, options: Options):
        self.options = options

    def partitions(self) -> list[Ranges]:
        """Ranges of at most ``most`` bytes; small files share a task."""
        tasks, held, used = [], [], 0
        for path, size in list_files(self.options.path):
            for a in range(0, max(size, 1), self.options.most):
                z = min(a + self.options.most, max(size, 1))
                if held and used + z - a + _OPEN > self.options.most:
                    tasks.append(Ranges(held))
                    held, used = [], 0
                held.append((path, size, a, z if z < size else 1 << 62))
                used += z - a + _OPEN
        return tasks + ([Ranges(held)] if held else [])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)


class PcmStream(DataSourceStreamReader):
    """Blocks of files that grow.  The offset holds, per file, how many blocks are complete with their overlap; files that can't be read yet are left for later."""

    def __init__(self, options: Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        done = {}
        for path, size in list_files(self.options.path):
            store, at = filesystem(path)
            with store.open_input_file(at) as fh:
                try:
                    header = read_header(fh, size)
                except (Unreadable, struct.error):
                    continue
            there = (size - header.start) // header.frame  # the header is written before the samples
            done[path] = max(0, (there - self.options.overlap) // self.options.size(header))
        return {"files": json.dumps(done, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        before, after, tasks = json.loads(start["files"]), json.loads(end["files"]), []
        sizes = dict(list_files(self.options.path))
        for path, n in after.items():
            store, at = filesystem(path)
            with store.open_input_file(at) as fh:
                header = read_header(fh, sizes[path])
            per = max(1, self.options.most // (self.options.size(header) * header.frame))
            tasks += [Ranges([(path, sizes[path], b, min(b + per, n))], True) for b in range(before.get(path, 0), n, per)]
        return tasks

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return self.options.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class PcmDataSource(DataSource):
    """``spark.read.format("pcm")`` and ``readStream``; options: path, blockSeconds, overlap, partitionBytes, errors (report or raise)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> Options:
        o = self.options
        return Options(o["path"], float(o.get("blockSeconds", 1.0)), int(o.get("overlap", 0)), int(o.get("partitionBytes", 128 << 20)), o.get("errors", "report"))

    def reader(self, schema) -> DataSourceReader:
        return PcmReader(self._options())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PcmStream(self._options())
