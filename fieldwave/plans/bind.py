"""The driver's tables in the shapes that the operators take, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microseconds of the first instant of the event stream's year.
T0 = 1704067200000000

#: Common table expressions of the same shapes.
SAMPLES = f"""s AS (
  SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    epoch_us(ts) - {T0} AS us, (epoch_us(ts) - {T0}) / 1e6 AS t, value AS v, event_type AS kind_of, event_id
  FROM events)"""
WAVES = """w AS (
  SELECT vec_id AS id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"""
FREQS = f"""f AS (
  SELECT 'rec' || user_id AS recording, (epoch_us(ts) - {T0}) // 86400000000 AS element, event_id AS id, value AS f,
    ((event_id * 7919) % 1000) / 10.0 AS power FROM events WHERE value > 0)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples(channel, idx, us, t, v, kind_of, event_id)."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - T0
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), us.alias("us"), (us / 1e6).alias("t"), F.col("value").alias("v"), F.col("event_type").alias("kind_of"), "event_id")
    return rows.withColumn("idx", F.row_number().over(W.partitionBy("channel").orderBy("us", "event_id")) - 1)


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as waveforms(id, label, pos, v)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frequencies(recording, element, id, f, power): a user's are a recording, whose days are the elements; there is no frequency of zero."""
    rows = table(spark, sf_dir, "events").where("value > 0")
    power = (F.col("event_id") * 7919 % 1000) / 10.0
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - T0) / 86_400_000_000)
    return rows.select(F.concat(F.lit("rec"), "user_id").alias("recording"), day.alias("element"), F.col("event_id").alias("id"), F.col("value").alias("f"), power.alias("power"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded as SQL rounds a double: times a power of ten, to the nearest whole number, halves away from zero, and divided again.

    ``F.round`` takes the decimal digits that a double is printed with instead, so it sees other halves.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    scaled = F.abs(x * 10.0**digits)
    low = F.floor(scaled).cast("double")
    made = F.signum(x) * (low + F.when(scaled - low >= 0.5, 1.0).otherwise(0.0)) / 10.0**digits
    return F.when(scaled < 2.0**52, made).otherwise(x)  # larger ones are whole, infinite or no number


def r6(c: Column | str) -> Column:
    return rounded(c)
