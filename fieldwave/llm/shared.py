"""Tables and files in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  It is chosen here only
where the session leaves it unset and runs in local mode, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: The white space that separates words in every operator here.
SPACES = " \t\n\x0b\x0c\r"
#: One word, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault("base", tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """A file system that tasks can open, and the path in it (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def settle(fs, temp: str, final: str) -> None:
    """Gives a whole file its final name; where another attempt has left its copy, which has the same bytes, that one stays."""
    try:
        fs.move(temp, final)
    except OSError:
        if not fs.get_file_info([final])[0].is_file:
            raise
        fs.delete_file(temp)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of ``df`` (Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(sizes: list[int], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of stretches that hold about ``most`` characters, a longer text by itself."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def by_hash(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """``df`` where it has at most ``most`` rows, else the rows whose id's hash lies below the share that leaves that many (expected)."""
    n, steps = df.count(), 1 << 30
    return df if n <= most else df.where(F.pmod(F.xxhash64(id_col), F.lit(steps)) < int(most / n * steps))


_emptying: dict[str, object] = {}


def use_table(name: str, empty=None) -> None:
    """Called by a task: a Python worker keeps the word table of one operator at a time; those of others are emptied and unused memory is given back."""
    for other in [k for k in _emptying if k != name]:
        _emptying.pop(other)()
        pa.default_memory_pool().release_unused()
    if empty is not None:
        _emptying[name] = empty


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in what tasks hand to Python at once, as texts can be long; a session with a size of its own keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
