"""A training corpus from raw documents: five operators in a row.

Each stage is a function of (spark, docs, sf_dir) and works on all that the
stage before it kept; ``run`` writes each stage's rows as Parquet into the
shared folder and reads them again for the next.  All but the last return the
columns of ``docs``, whatever they are called.  Long texts are read whole in every
stage, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldwave.llm import decontaminate, mixing, near_dedup, quality, token_files
from fieldwave.llm.shared import written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others; repeated rows share their fate;
    without labels of both kinds all documents get one score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("predicted = 1").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Of repeated rows one stays, of null ids too; texts without words all stay.
    """
    return near_dedup.without_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none, repeated rows share their fate."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the mix once for each epoch that takes them, that on a source's cut whole.

    Texts without words are never taken; a null source is a source of its own;
    repeated rows are documents of their own.
    """
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order (null first); one row per document of the mix, repeated ones too, as the files hold it."""
    return token_files.token_digests(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_to_targets),
    ("token files", write_token_files),
]

#: Trained weights and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
