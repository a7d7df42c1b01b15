"""Logger queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.operators import logger as L

from fieldwave.sources.shared import written

from .bind import SAMPLES, T0, r6, samples, table

_DAY = 86_400_000_000
_RATE, _CUTOFF = 1000.0, 50.0
#: (keys, std, n) of filtered(keys, i, v) in SQL: the high-pass written out as the sum of its weighted steps.
_K = f"tan(pi() * {_CUTOFF} / {_RATE})"
FILTERED_STD = f"""xi AS (SELECT *, row_number() OVER (PARTITION BY channel, "window" ORDER BY us, v) - 1 AS i, count(*) OVER (PARTITION BY channel, "window") AS n FROM x),
dd AS (SELECT channel, "window", i, n, (v - coalesce(lag(v) OVER (PARTITION BY channel, "window" ORDER BY i), v)) / (1 + {_K}) AS d FROM xi),
yy AS (SELECT a.channel, a."window", a.i, a.n, sum(b.d * pow((1 - {_K}) / (1 + {_K}), a.i - b.i)) AS y FROM dd a JOIN dd b ON a.channel = b.channel AND a."window" = b."window" AND b.i <= a.i GROUP BY ALL),
ps AS (SELECT channel, "window", stddev_pop(y) AS std, count(*) AS n FROM yy GROUP BY ALL)"""
_POWER = f"""{SAMPLES},
x AS (SELECT channel, v, us // {_DAY} - k AS "window" FROM s, range(2) r(k)),
p AS (SELECT channel, "window", stddev_pop(v) AS std, count(v) AS n FROM x GROUP BY ALL)"""


def _hist_sql(source: str, keys: str, value: str, fac: float, nbins: int, name: str = "") -> str:
    return f"""
{name}span AS (SELECT {keys}, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY {keys}),
{name}h AS (SELECT {keys}, lo, hi, least({nbins - 1}, floor(({value} - lo) / ((hi - lo) / {nbins})))::BIGINT AS b, count(*) AS n
  FROM {source} JOIN {name}span USING ({keys}) WHERE hi > lo GROUP BY ALL),
{name}t AS (SELECT *, max(n) OVER (PARTITION BY {keys}) AS top FROM {name}h),
{name}m AS (SELECT {keys}, any_value(lo) AS lo, any_value(hi) AS hi, min(b) FILTER (n = top) AS mode,
  min(b) FILTER (n >= top / exp(0.5)) AS a, max(b) FILTER (n >= top / exp(0.5)) AS z FROM {name}t GROUP BY {keys}),
{name}th AS (SELECT {keys}, lo + (mode + 0.5) * (hi - lo) / {nbins} AS center, (z - a + 1) / 2.0 * (hi - lo) / {nbins} AS width,
  lo + (mode + 0.5) * (hi - lo) / {nbins} + {fac} * ((z - a + 1) / 2.0 * (hi - lo) / {nbins}) AS threshold FROM {name}m)"""


def power(spark, sf_dir):
    return L.signal_power(samples(spark, sf_dir), ["channel"], "us", "v", 2 * _DAY, _DAY, ties=["event_id"])


def signal_power(spark, sf_dir):
    out = L.signal_power(samples(spark, sf_dir), ["channel"], "us", "v", 2 * _DAY, _DAY, rate=_RATE, cutoff=_CUTOFF)
    return out.select("channel", "window", r6("std").alias("std"), "n")


def _loud(spark, sf_dir):
    rows = written(power(spark, sf_dir), "power")  # read three times
    limit = L.hist_threshold(rows, ["channel"], "std", fac=0.5, nbins=20)
    return rows.join(limit, "channel").where("std > threshold")


def logger_power_summary(spark, sf_dir):
    """Windows louder than their channel's threshold, joined to intervals, summarised per channel."""
    loud = _loud(spark, sf_dir)
    occ = L.sessionize(loud, ["channel"], "window", 1, [F.avg("std").alias("EODf")])
    out = L.occurrence_summary(occ.withColumn("source", F.col("channel")), ["source"], min_range=1.0)
    return out.select("source", r6("min_EODf").alias("min_std"), r6("max_EODf").alias("max_std"), F.col("first").alias("first_window"), F.col("last").alias("last_window"), F.col("total").alias("total_windows"), "is_range")


def power_threshold(spark, sf_dir):
    return L.hist_threshold(power(spark, sf_dir), ["channel"], "std", fac=0.5, nbins=20).select("channel", *(r6(c).alias(c) for c in ("center", "width", "threshold")))


def price_threshold(spark, sf_dir):
    rows = L.hist_threshold(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", fac=3.0, nbins=100)
    return rows.select("l_suppkey", *(r6(c).alias(c) for c in ("center", "width", "threshold")))


def sessions(spark, sf_dir):
    out = L.sessionize(samples(spark, sf_dir), ["channel"], "us", 6 * 3_600_000_000, [F.max("v").alias("max_v")])
    return out.select("channel", "session", "tstart", "tend", "n", r6("max_v").alias("max_v"))


def file_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return L.file_time_offsets(rows, ["o_custkey"], ["o_orderkey"], "cents").select("o_custkey", "o_orderkey", "offset")


def shifted_times(spark, sf_dir):
    occ = L.sessionize(samples(spark, sf_dir), ["channel"], "us", 6 * 3_600_000_000)
    return L.shift_start_time(occ, ["tstart", "tend"], F.lit(1_000_000)).select("channel", "session", "tstart", "tend")


def power_round_trip(spark, sf_dir):
    """Channels in loggers of four, each a wide table."""
    device, channel = F.floor(F.col("channel") / 4).alias("device"), (F.col("channel") % 4).cast("int").alias("channel")
    long = power(spark, sf_dir).select("window", device, channel, r6("std").alias("std"), F.col("n").cast("int").alias("supra"))
    return L.read_power(L.write_power(long, ["window", "device"], [0, 1, 2, 3]), ["window", "device"], [0, 1, 2, 3])


def occurrence_times(spark, sf_dir):
    occ = L.sessionize(samples(spark, sf_dir), ["channel"], "us", 6 * 3_600_000_000)
    stamp = lambda c: F.timestamp_micros(F.col(c) + T0)
    rows = L.format_occurrences(occ.select("channel", "session", stamp("tstart").alias("tstart"), stamp("tend").alias("tend")))
    back = L.parse_occurrences(rows)
    return rows.join(back.select("channel", "session", F.unix_seconds("tstart").alias("start_s"), F.unix_seconds("tend").alias("end_s")), ["channel", "session"])


_SESS = f"""{SAMPLES},
g AS (SELECT *, us - lag(us) OVER (PARTITION BY channel ORDER BY us) > 21600000000 AS new FROM s),
h AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY channel ORDER BY us) AS session FROM g),
o AS (SELECT channel, session, min(us) AS tstart, max(us) AS tend, count(*) AS n, max(v) AS max_v FROM h GROUP BY ALL)"""

QUERIES = {
    "logger_power_summary": logger_power_summary,
    "a1_signal_power": signal_power,
    "a2_power_threshold": power_threshold,
    "a2_price_threshold": price_threshold,
    "r3_sessions": sessions,
    "w21_file_offsets": file_offsets,
    "s8_shifted_times": shifted_times,
    "s6_power_round_trip": power_round_trip,
    "s7_occurrence_times": occurrence_times,
}
SQL = {
    "a1_signal_power": f'WITH {_POWER.replace("SELECT channel, v, us", "SELECT channel, v, us, us")}, {FILTERED_STD} SELECT channel, "window", round(std, 6) AS std, n FROM ps',
    "a2_power_threshold": f"WITH {_POWER}, {_hist_sql('p', 'channel', 'std', 0.5, 20)} SELECT channel, round(center, 6) AS center, round(width, 6) AS width, round(threshold, 6) AS threshold FROM th",
    "a2_price_threshold": f"WITH {_hist_sql('lineitem', 'l_suppkey', 'l_extendedprice', 3.0, 100)} SELECT l_suppkey, round(center, 6) AS center, round(width, 6) AS width, round(threshold, 6) AS threshold FROM th",
    "logger_power_summary": f"""WITH {_POWER}, {_hist_sql('p', 'channel', 'std', 0.5, 20)},
l AS (SELECT p.* FROM p JOIN th USING (channel) WHERE std > threshold),
i AS (SELECT *, "window" - row_number() OVER (PARTITION BY channel ORDER BY "window") AS run FROM l),
o AS (SELECT channel, run, min("window") AS tstart, max("window") AS tend, avg(std) AS f FROM i GROUP BY ALL)
SELECT channel AS source, round(min(f), 6) AS min_std, round(max(f), 6) AS max_std, min(tstart) AS first_window,
  max(tend) AS last_window, sum(tend - tstart)::BIGINT AS total_windows, max(f) - min(f) > 1 AS is_range FROM o GROUP BY channel""",
    "r3_sessions": f"WITH {_SESS} SELECT channel, session::BIGINT AS session, tstart, tend, n, round(max_v, 6) AS max_v FROM o",
    "w21_file_offsets": """SELECT o_custkey, o_orderkey, coalesce(sum(round(o_totalprice * 100)::BIGINT) OVER (
  PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM orders""",
    "s8_shifted_times": f"WITH {_SESS} SELECT channel, session::BIGINT AS session, 1000000 + tstart - (SELECT min(tstart) FROM o) AS tstart, 1000000 + tend - (SELECT min(tstart) FROM o) AS tend FROM o",
    "s6_power_round_trip": f'WITH {_POWER} SELECT "window", channel // 4 AS device, (channel % 4)::INT AS channel, round(std, 6) AS std, n::INT AS supra FROM p WHERE std IS NOT NULL',
    "s7_occurrence_times": f"""WITH {_SESS} SELECT channel, session::BIGINT AS session,
  strftime(make_timestamp(tstart + {T0}), '%Y-%m-%dT%H:%M:%S') AS tstart, strftime(make_timestamp(tend + {T0}), '%Y-%m-%dT%H:%M:%S') AS tend,
  (tstart + {T0}) // 1000000 AS start_s, (tend + {T0}) // 1000000 AS end_s FROM o""",
}
