"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key.  The keys are uniform, so equal key
intervals are balanced ranges: rows are grouped by (source, range), each range
is sorted and summed by itself, and the ranges' totals, which are few, give the
offset of each.  Prefix sum and budget then decide what each document gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh, partitions, word_count


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Word targets from ``sizes(_src, source_size)``.

    Sources take the given weights in turn by code point, null last.  A target
    stops at ``max_epochs`` times its source's size and the excess is shared
    again by weight: with sources ordered by cap over weight, the first whose
    cap is not below its share of what is left fixes the share of all after it.
    One row per source comes in, so the windows here are over sources only.
    """
    by_name, by_cap = W.orderBy("_src"), W.orderBy("_ratio", "_src")
    before, every = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("_cap", max_epochs * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    rows = rows.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    rows = rows.withColumn("_share", F.col("_left") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    share = F.min(F.when(F.col("_ratio") >= F.col("_share"), F.struct("_ratio", "_src", "_share"))).over(every)["_share"]
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * share)
    return rows.select("_src", "source_size", F.round(target, 6).alias("target"))


def mix_sources(docs: DataFrame, *, max_epochs: int = 3, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words that the mix takes).

    Whole epochs take every document; of the last, begun one, documents are
    taken in key order up to the exact word budget, so the document on the cut
    gives its first words only.  ``taken`` never exceeds ``max_epochs * size``.
    Null text has size 0, null source is a source of its own, the key of a null
    doc_id is drawn from its text, so they are spread too, ties of the key
    are ordered by doc_id, size and a hash of the text, equal rows are
    interchangeable, an empty table stays empty.  Columns named like the new
    ones are replaced; all others pass through.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    src, key, rng, tie, here, offset = fresh(docs, "mix_src", "mix_key", "mix_range", "mix_tie", "mix_here", "mix_offset")
    n = max(1, partitions(docs.sparkSession))
    rows = (
        docs.withColumn(src, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z")))
        .withColumn("size", word_count(F.col("text")))
        .withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.sha2(F.coalesce("text", F.lit("")), 256))))))
        .withColumn(rng, F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * n / F.lit(2**32)).cast("int"))
    )
    totals = rows.groupBy(F.col(src).alias("_src"), F.col(rng).alias("_range")).agg(F.sum("size").alias("_sum"))
    earlier = W.partitionBy("_src").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    targets = source_targets(totals.groupBy("_src").agg(F.sum("_sum").alias("source_size")), max_epochs, weights)
    ranges = totals.withColumn(offset, F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum").join(targets, "_src")
    order = W.partitionBy(src, rng).orderBy(key, F.col("doc_id"), F.col("size"), F.col(tie)).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn(tie, F.xxhash64(F.col("text"))).withColumn(here, F.sum("size").over(order) - F.col("size"))
    rows = rows.join(ranges, (F.col(src) == F.col("_src")) & (F.col(rng) == F.col("_range")))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size") - F.col(offset) - F.col(here)
    taken = (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")
    return rows.withColumn("taken", taken).select(*docs.columns, "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a document stands in it once for each epoch that takes any of its words.

    The document on a source's cut is emitted whole, never a piece of it.
    """
    taken = mix_sources(docs, **options)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    (step,) = fresh(docs, "mix_step")
    return taken.where(copies > 0).withColumn(step, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null' || sha256(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (
  SELECT src, source_size, (1 + (row_number() OVER (ORDER BY src) - 1) % 3)::DOUBLE AS w,
         3 * source_size AS cap FROM s),
r AS (
  SELECT *, cap / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS share
  FROM w WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT src, source_size, round(least(cap::DOUBLE, w * (
    SELECT share FROM r WHERE ratio >= share ORDER BY ratio, src LIMIT 1)), 6) AS target FROM r),
p AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY src ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (src))
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken
FROM p
"""
