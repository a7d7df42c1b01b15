"""The whole pulse jobs, on pulses that events lay out on a time axis."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwave.operators import harmonic_groups as H
from fieldwave.operators import jobs as J

from .bind import r6, samples

#: Samples between hours, and the samples of a pulse around its middle: two sources, a narrow one and one twice as wide.
_HOUR, _REACH, _NARROW, _WIDE = 40, 16, 1.5, 3.0
RATE = 1000.0
_PULSES = {"left": 10, "right": 10, "max_width": 0.02}


def recordings(spark, sf_dir):
    """samples(channel, idx, t, v): in every hour with events of a channel stands one biphasic pulse, wide where the hour is divisible by three; its height varies with the value of the hour's first event.

    Between pulses, where nothing is, there are no samples.
    """
    hours = samples(spark, sf_dir).groupBy("channel", F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.min_by("v", F.struct("us", "event_id")).alias("v"))
    wide = F.col("hour") % 3 == 0
    rows = hours.withColumn("k", F.explode(F.sequence(F.lit(-_REACH), F.lit(_REACH))))
    u = F.col("k") / F.when(wide, _WIDE).otherwise(_NARROW)
    height = F.when(wide, 1.0).otherwise(3.0) * (1 + F.pmod("v", F.lit(1.0)) / 20)
    idx = F.col("hour") * _HOUR + _REACH + F.col("k")
    return rows.select("channel", idx.alias("idx"), (idx / RATE).alias("t"), (-height * u * F.exp(-u * u / 2)).alias("v"))


def pulses(spark, sf_dir):
    """Every pulse with its cluster; clusters that reach the clipping limit go."""
    rows = J.extract_pulses(recordings(spark, sf_dir), ["channel"], RATE, 0.3, clip=10.0, **_PULSES)
    return rows.select("channel", "idx", r6("height").alias("height"), r6("width").alias("width"), "label")


def sources(spark, sf_dir):
    """Pulse and wave sources of the most stable twenty seconds."""
    limits = recordings(spark, sf_dir).select("channel").distinct().select("channel", F.lit(10.0).alias("low"), F.lit(20.0).alias("high"))
    params = H.GroupParams(max_harmonics_db=5.0)
    rows = J.detect_sources(recordings(spark, sf_dir), ["channel"], RATE, 4.0, 0.3, "wp", limits, params, window=20.0, clip=(-10.0, 10.0), pulses=_PULSES)
    return rows.select("channel", "type", "index", r6("EODf").alias("EODf"), r6("strength").alias("strength"), r6("ppampl").alias("ppampl"), r6("clipped").alias("clipped"), "skip_reason")


QUERIES = {
    "c3_extract_pulses": pulses,
    "c5_detect_sources": sources,
}
SQL: dict[str, str] = {}
