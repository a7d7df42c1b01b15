"""Exact dedup by a tree-merge of sorted digest runs.

Rows are dealt to runs of bounded length by a hash of their key, each a run of
digests, sorted and free of repeats.  In rounds, ``fan_in`` runs at a time are exchanged and merged into one, again
sorted; a run is split by digest prefix, so every round, the last included, is
spread over all tasks.  Each level keeps, per digest, the identifier that stays
and the number of documents, both final after the last round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, written

#: What must agree for two texts to count as one: SHA-256, length and a second, unrelated hash.
_SAME = ["digest", "n_bytes", "check"]


def digest_runs(docs: DataFrame, n_runs: int, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row (unique), run, digest of the normalised text, sorted by run and digest in each partition."""
    key = F.monotonically_increasing_id() if row is None else F.col(row)
    norm = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return (
        docs.select(F.col("doc_id"), key.alias("row"), norm.alias("norm"))
        .select(
            "doc_id",
            "row",
            F.pmod(F.xxhash64("row"), F.lit(n_runs)).cast("int").alias("run"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").alias("n_bytes"),
            F.xxhash64("norm").alias("check"),
        )
        .sortWithinPartitions("run", "digest")
    )


def _best(keep: str):
    """Aggregates the identifier that stays: (doc_id, row) is unique, so exactly one row of a group stays."""
    return (F.max if keep == "largest" else F.min)("best").alias("best")


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int, keep: str) -> DataFrame:
    """Rounds of exchanges until one run (spread over tasks by digest prefix) is left."""
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .withColumn("prefix", F.substring("digest", 1, 2))
            .repartition("run", "prefix")
            .sortWithinPartitions("run", "prefix", *_SAME)
            .groupBy("run", "prefix", *_SAME)
            .agg(_best(keep), F.sum("n").alias("n"))
            .drop("prefix")
        )
    return runs


def exact_dedup(docs: DataFrame, *, keep: str = "largest", fan_in: int = 8, row: str | None = None, run_rows: int = 50_000, min_runs: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after lower-casing A-Z; null is empty.
    ``keep`` names which doc_id of a group stays, "largest" or "smallest"; of
    repeated rows with that doc_id exactly one stays, and null ids count as
    smallest.  An empty table gives an empty one.  Other columns are not read.
    ``row`` names a column of unique integers that tells rows apart, else one is
    made.

    There are ``min_runs`` runs, or as many as hold ``run_rows`` rows each.  A hot
    text is one row per run after the first, local step.  The way back to
    documents goes through (run, digest): no group is larger than a run.
    """
    n_runs = max(1, min_runs, -(-docs.count() // run_rows))
    base = written(digest_runs(docs, n_runs, row), "digests")
    if keep == "largest":
        best = F.struct("doc_id", "row")
    else:
        best = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    local = base.withColumn("best", best).groupBy("run", *_SAME).agg(_best(keep), F.count(F.lit(1)).alias("n"))
    whole = merge_runs(local, n_runs, fan_in, keep).drop("run")
    per_run = base.select("run", *_SAME).distinct().join(whole, _SAME)
    rows = base.join(per_run, ["run", *_SAME])
    return rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row",
    )


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the copies, all columns kept; rows are told apart by a key of their own, written with them."""
    key, kept = fresh(docs, "row_key", "kept_key")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    rows = exact_dedup(keyed, row=key, **options).where("kept").select(F.col("row").alias(kept))
    return keyed.join(rows, F.col(key) == F.col(kept), "left_semi").drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
