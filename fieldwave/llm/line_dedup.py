"""Line dedup with levelled sorted runs of line hashes.

Documents come in batches.  A run is a table of line hashes, each with the
number of documents of its batches that hold it, cut into buckets by hash and
sorted in each, one file a bucket.  A new batch is counted, hot lines within each
task first, and merge-anti-joined with the runs of frequent hashes: what is known
to be frequent is not stored again.  It is merge-joined with all other runs, so
that hashes that reach the limit move to a run of frequent ones, and the rest is
added as a run.  When a level has ``fan_in`` runs, they are merged into one run of
the next level, without what has become frequent.  All runs have the same
buckets and order, so none of these joins moves or sorts a run again.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, ascii_lower, partitions, shared_dir, small_batches, use_table

_STRIP = SPACES.encode()
#: With these, Spark reads a bucket's only file as sorted, and joins runs bucket by bucket.
_RUN_SETTINGS = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def line_keys(text: Column) -> Column:
    """Hashes (MD5, 16 bytes) of the distinct, non-empty keys of a text's lines."""
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ascii_lower(F.btrim(x, F.lit(SPACES))))
    return F.transform(F.array_distinct(F.filter(keys, lambda k: k != "")), lambda k: F.unhex(F.md5(k)))


def line_table(docs: DataFrame, n_batches: int) -> DataFrame:
    """(batch, doc_id, key) for every distinct line key of every document."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch")
    return docs.select("doc_id", batch, F.explode(line_keys(F.col("text"))).alias("key"))


@contextmanager
def run_settings(spark):
    """The session's settings while runs are written and merged; its own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in _RUN_SETTINGS}
    for k, v in _RUN_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """The levels of runs (key, n); every run is a bucketed, sorted table in the shared folder."""

    def __init__(self, spark, min_docs: int = 10, fan_in: int = 2):
        self.spark, self.min_docs, self.fan_in, self.buckets = spark, min_docs, fan_in, partitions(spark)
        self.levels: list[list[DataFrame]] = [[]]
        self.frequent: list[DataFrame] = []
        self.names: list[str] = []

    def _run(self, rows: DataFrame, kind: str) -> DataFrame:
        """``rows(key, n)`` as a run; rows of a key must stand in one partition."""
        name = f"{kind}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", shared_dir(self.spark, kind)).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def _without_frequent(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda left, hot: left.join(hot.select("key"), "key", "left_anti"), self.frequent, rows)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Merges sorted runs two at a time, bucket by bucket, without keys that have become frequent."""
        runs = [self._without_frequent(r) for r in runs]
        while len(runs) > 1:
            a, b, *runs = runs
            both = a.join(b.select("key", F.col("n").alias("more")), "key", "full_outer")
            both = both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
            runs.append(self._run(both, "line_run") if runs else both)
        return runs[0]

    def counted(self, lines: DataFrame) -> DataFrame:
        """(key, n) of a batch of (doc_id, key), dealt into the runs' buckets."""
        once = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))  # lines of a document stand together: mostly done within tasks
        return once.groupBy("key").agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, "key")

    def against_runs(self, counts: DataFrame) -> DataFrame:
        """(key, n, total) of a batch's keys that are not known to be frequent; ``total`` is over all runs."""
        rows = self._without_frequent(counts).withColumn("total", F.col("n"))
        for run in (run for level in self.levels for run in level):
            known = run.select("key", F.col("n").alias("known"))
            rows = rows.join(known, "key", "left").select("key", "n", (F.col("total") + F.coalesce("known", F.lit(0))).alias("total"))
        return rows

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (doc_id, key); batches must not share documents."""
        with run_settings(self.spark):
            whole = self._run(self.against_runs(self._run(self.counted(lines), "line_batch")), "line_totals")
            hot = self._run(whole.where(F.col("total") >= self.min_docs).select("key", F.col("total").alias("n")), "line_frequent")
            self.frequent.append(hot)
            if len(self.frequent) > self.fan_in:  # compacted too: keys of frequent runs are distinct
                runs, self.frequent = self.frequent, []
                self.frequent = [self._run(self.merged(runs), "line_frequent")]
            self.levels[0].append(whole.where(F.col("total") < self.min_docs).select("key", "n"))
            level = 0
            while len(self.levels[level]) >= self.fan_in:
                run = self._run(self.merged(self.levels[level]), "line_run")
                self.levels[level] = []
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(run)
                level += 1

    def complete(self) -> DataFrame:
        """The keys found in at least ``min_docs`` documents, as a plain table."""
        rows = [self.spark.read.parquet(*t.inputFiles()) for t in self.frequent if t.inputFiles()]
        out = reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "key binary, n long")
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")  # the catalog's entry; files stay in the shared folder
        return out.select("key")


def drop_lines(text: str | None, keys: set[bytes]) -> tuple[str, int, int]:
    """The text without lines whose key is in ``keys``; its lines before; the lines dropped."""
    lines = (text or "").split("\n")
    if not keys:
        return text or "", len(lines), 0
    kept = [x for x in lines if not ((k := x.encode().strip(_STRIP).lower()) and hashlib.md5(k, usedforsecurity=False).digest() in keys)]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


_CLEANED = "struct<text:string,n_lines:long,n_dropped:long>"


def _cleaned(rows: list[tuple[str, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])


def _by_broadcast(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    keys = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.key) for r in frequent.collect()))

    @F.pandas_udf(_CLEANED)
    def clean(texts: pd.Series) -> pd.DataFrame:
        use_table("")
        return _cleaned([drop_lines(t, keys.value) for t in texts])

    return docs.select("doc_id", clean("text").alias("c"))


def _by_join(docs: DataFrame, lines: DataFrame, frequent: DataFrame, salts: int = 32) -> DataFrame:
    """Each document meets the frequent keys of its own lines; hot lines are dealt over ``salts`` copies of a key."""
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(salted, ["key", "salt"])
    hits = met.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_set("key").alias("keys"))

    @F.pandas_udf(_CLEANED)
    def clean(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        use_table("")
        return _cleaned([drop_lines(t, set(map(bytes, k)) if k is not None else set()) for t, k in zip(texts, keys)])

    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", clean("text", "keys").alias("c"))


def line_dedup(docs: DataFrame, *, min_docs: int = 10, n_batches: int = 4, fan_in: int = 2, max_broadcast: int = 500_000) -> DataFrame:
    """One row per document: doc_id, text (kept lines), n_lines, n_dropped.

    A line's key is the line stripped of white space with A-Z lower-cased; empty
    keys stay.  Keys in at least ``min_docs`` documents lose their lines
    everywhere.  A document is a doc_id: rows that repeat one count once, and a
    null id is one document.  Null text is one empty line.  An empty table stays
    empty; extra columns are not read.

    Only hashes are counted.  Up to ``max_broadcast`` frequent keys (of 16 bytes
    each) are broadcast, and texts stay where they are; beyond that each text moves
    once, to meet the keys of its own document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    lines = line_table(docs, n_batches)
    path = shared_dir(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)
    runs = LineRuns(spark, min_docs, fan_in)
    for b in range(n_batches):
        runs.add(lines.where(F.col("batch") == b))
    frequent = runs.complete()
    done = _by_broadcast(docs, frequent) if frequent.count() <= max_broadcast else _by_join(docs, lines, frequent)
    return done.select("doc_id", "c.text", "c.n_lines", "c.n_dropped")


def query(spark, sf_dir: str) -> DataFrame:
    rows = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) + bool_or(doc_id IS NULL)::INT >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
