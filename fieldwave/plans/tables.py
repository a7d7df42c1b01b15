"""Queries over collected result tables: orders are the sources, customers their metadata, lineitem the harmonics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwave.operators import tables as T

from .bind import r6, table


def _fish(spark, sf_dir):
    """orders as sources: recording path, EODf and quality properties."""
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("data/field/"), F.col("o_orderpriority"), F.lit("/Rec"), F.col("o_custkey"), F.lit("-c"), F.col("o_orderkey") % 4, F.lit("-t"), F.col("o_orderkey") % 7, F.lit("s-wavefish-"), F.col("o_orderkey") % 3, F.lit(".csv"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("fish"), F.concat(F.lit("Rec"), F.col("o_custkey"), F.lit(".wav")).alias("recording"), path.alias("path"), F.col("o_custkey").alias("cust"), (F.col("o_totalprice") / 100).alias("EODf"),
        (k % 50 / 1000.0).alias("clipped"), (k % 7).alias("nphases"), (k % 100 / 1000.0).alias("rmserror"), (-(k % 130)).cast("double").alias("power"), (k % 30).cast("double").alias("dbdiff"),
    )


_FISH = """f AS (SELECT o_orderkey AS fish, 'Rec' || o_custkey || '.wav' AS recording, o_custkey AS cust, o_totalprice / 100 AS EODf,
  'data/field/' || o_orderpriority || '/Rec' || o_custkey || '-c' || (o_orderkey % 4) || '-t' || (o_orderkey % 7) || 's-wavefish-' || (o_orderkey % 3) || '.csv' AS path,
  o_orderkey % 50 / 1000.0 AS clipped, o_orderkey % 7 AS nphases, o_orderkey % 100 / 1000.0 AS rmserror, -(o_orderkey % 130)::DOUBLE AS power, (o_orderkey % 30)::DOUBLE AS dbdiff FROM orders)"""


def _meta(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("field/REC"), F.col("c_custkey"), F.lit(".mp3")).alias("file"), F.col("c_mktsegment").alias("segment"), (F.col("c_acctbal") / 1000 + 20).alias("temp"), F.col("c_custkey").alias("cust"))


_META = "m AS (SELECT 'rec' || c_custkey AS k, c_mktsegment AS segment, c_acctbal / 1000 + 20 AS temp, c_custkey AS cust FROM customer WHERE c_custkey % 3 <> 0)"


def _spectrum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fish"), F.col("l_linenumber").alias("h"))
    agg = rows.agg(F.max("l_extendedprice").alias("amplitude"), F.max("l_discount").alias("relampl"), F.max("l_tax").alias("phase"), F.max("l_quantity").alias("time"))
    return agg.withColumn("h", F.col("h") - 1).withColumn("relpower", F.round(20 * F.log10(F.col("relampl") + 0.01), 6))


_SPEC = """sp AS (SELECT l_orderkey AS fish, l_linenumber - 1 AS h, max(l_extendedprice) AS amplitude, max(l_discount) AS relampl, max(l_tax) AS phase,
  max(l_quantity) AS time, round(20 * log10(max(l_discount) + 0.01), 6) AS relpower FROM lineitem GROUP BY ALL)"""


def adjusted(spark, sf_dir):
    out = T.adjust_to_temperature(_fish(spark, sf_dir), _meta(spark, sf_dir), "EODf", "temp", "cust")
    return out.select("fish", "mean_temp", r6("EODf_adjusted").alias("EODf_adjusted"), r6("EODf_ref").alias("EODf_ref"))


def wave_quality(spark, sf_dir):
    return T.wave_quality(_fish(spark, sf_dir)).select("fish", "remove", "skip_reason")


def pulse_quality(spark, sf_dir):
    return T.pulse_quality(_fish(spark, sf_dir)).select("fish", "skipped_clipped", "skip_reason")


def quality_filter(spark, sf_dir):
    limits = T.WaveThresholds(max_relampl_h1=0.08, max_relampl_h2=0.09)
    return T.quality_filter(_fish(spark, sf_dir), _spectrum(spark, sf_dir), ["fish"], limits).select("fish", r6("EODf").alias("EODf"))


def parsed_paths(spark, sf_dir):
    return T.parse_analysis_path(_fish(spark, sf_dir), "path").select("fish", "recording", "base_path", "channel", "time", "ftype", "index", "ext")


def stripped_paths(spark, sf_dir):
    return T.strip_common_prefix(_fish(spark, sf_dir).select("fish", "path"), "path")


def with_metadata(spark, sf_dir):
    return T.join_metadata(_fish(spark, sf_dir), _meta(spark, sf_dir).select("file", "segment"), "file").select("fish", "segment")


def coverage(spark, sf_dir):
    out = T.metadata_coverage(_meta(spark, sf_dir).drop("cust"), _fish(spark, sf_dir).where("cust % 7 <> 1"), "file")
    return out.select("file", "segment", "type", "index", "EODf")


def harmonics(spark, sf_dir):
    out = T.attach_harmonics(_fish(spark, sf_dir).select("fish"), _spectrum(spark, sf_dir), ["fish"], 2)
    return out.select("fish", "ampl0", "ampl1", "ampl2", "phase0", "relampl1", "relpower1", "phase1", "relampl2", "relpower2", "phase2")


def phases(spark, sf_dir):
    rows = _spectrum(spark, sf_dir).withColumn("p", F.col("h") + 1).withColumn("width", F.col("phase") * 2)
    return T.attach_phases(_fish(spark, sf_dir).select("fish"), rows, ["fish"], 1, 2).select("fish", "P1ampl", "P1width", "P2time", "P2ampl", "P2relampl", "P2width")


def top_fish(spark, sf_dir):
    return T.top_fish(_fish(spark, sf_dir), 3, ["recording"], ["fish"]).select("recording", "fish")


def ordered(spark, sf_dir):
    return T.order_index(_fish(spark, sf_dir), ["recording"], ["EODf", "fish"]).select("recording", "fish", "index")


def _kinds(spark, sf_dir):
    f = _fish(spark, sf_dir)
    return f.where("fish % 3 = 0").select("recording", "fish", "EODf", "nphases"), f.where("fish % 3 <> 0").select("recording", "fish", "EODf", "dbdiff")


def renumbered(spark, sf_dir):
    pulse, wave = _kinds(spark, sf_dir)
    return T.renumber_fish(pulse, wave, ["recording"], ["fish"]).select("recording", "fish", "type", "index", "nphases", "dbdiff")


def both_kinds(spark, sf_dir):
    pulse, wave = _kinds(spark, sf_dir)
    return T.all_table(wave, pulse, ["recording", "fish", "EODf", "nphases"]).withColumn("EODf", r6("EODf"))


def unions(spark, sf_dir):
    pulse, wave = _kinds(spark, sf_dir)
    return T.union_tables([pulse, wave]).withColumn("EODf", r6("EODf"))


def statistics(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    out = T.table_statistics(table(spark, sf_dir, "lineitem"), cols)
    return out.select("column", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")))


_REASON = """concat_ws(', ', CASE WHEN EODf < 0 OR EODf > 2000 THEN 'invalid EODf' END, CASE WHEN power < -100 THEN 'weak power' END,
  CASE WHEN clipped > 0.01 THEN 'clipped' END, CASE WHEN nphases > 4 THEN 'many phases' END, CASE WHEN rmserror > 0.05 THEN 'bad fit' END, CASE WHEN dbdiff > 20 THEN 'not smooth' END)"""

QUERIES = {
    "p1_adjust_q10": adjusted,
    "p3_wave_quality": wave_quality,
    "p4_pulse_quality": pulse_quality,
    "p5_quality_filter": quality_filter,
    "s2_parse_paths": parsed_paths,
    "p7_strip_prefix": stripped_paths,
    "j1_join_metadata": with_metadata,
    "j2_metadata_coverage": coverage,
    "j3_attach_harmonics": harmonics,
    "j4_attach_phases": phases,
    "t1_top_fish": top_fish,
    "t3_order_by_frequency": ordered,
    "t4_renumber_fish": renumbered,
    "u1_all_table": both_kinds,
    "u2_union_tables": unions,
    "a23_table_statistics": statistics,
}
SQL = {
    "p1_adjust_q10": f"""WITH {_FISH}, {_META}, t AS (SELECT round(avg(temp), 1) AS mean_temp FROM m)
SELECT fish, mean_temp, round(CASE WHEN temp IS NOT NULL THEN EODf * pow(1.62, (mean_temp - temp) / 10) ELSE EODf END, 6) AS EODf_adjusted,
  round(CASE WHEN temp IS NOT NULL THEN EODf * pow(1.62, (25 - temp) / 10) ELSE EODf END, 6) AS EODf_ref FROM f LEFT JOIN m USING (cust), t""",
    "p3_wave_quality": f"WITH {_FISH} SELECT fish, EODf > 2000 OR dbdiff > 20 AS remove, {_REASON} AS skip_reason FROM f",
    "p4_pulse_quality": f"WITH {_FISH} SELECT fish, clipped >= 0.01 AS skipped_clipped, concat_ws(', ', CASE WHEN clipped >= 0.01 THEN 'clipped' END, CASE WHEN rmserror > 0.05 THEN 'bad fit' END) AS skip_reason FROM f",
    "p5_quality_filter": f"""WITH {_FISH}, {_SPEC} SELECT fish, round(EODf, 6) AS EODf FROM f LEFT JOIN (SELECT fish, max(relampl) FILTER (h = 1) AS r1, max(relampl) FILTER (h = 2) AS r2 FROM sp GROUP BY fish) USING (fish)
WHERE {_REASON} = '' AND coalesce(r1, 0) <= 0.08 AND coalesce(r2, 0) <= 0.09""",
    "s2_parse_paths": f"""WITH {_FISH} SELECT fish, 'Rec' || cust AS recording, regexp_extract(path, '^(.*/)[^/]*$', 1) AS base_path, (fish % 4)::INT AS channel,
  (fish % 7)::DOUBLE AS time, 'wavefish' AS ftype, (fish % 3)::INT AS index, 'csv' AS ext FROM f""",
    "p7_strip_prefix": f"WITH {_FISH} SELECT fish, replace(path, 'data/field/', '') AS path FROM f",
    "j1_join_metadata": f"WITH {_FISH}, {_META} SELECT fish, segment FROM f LEFT JOIN m ON m.cust = f.cust",
    "j2_metadata_coverage": f"""WITH {_FISH}, {_META} SELECT 'field/REC' || cust || '.mp3' AS file, segment, 'none' AS type, NULL::INT AS index, NULL::DOUBLE AS EODf
FROM m WHERE cust NOT IN (SELECT cust FROM f WHERE cust % 7 <> 1)""",
    "j3_attach_harmonics": f"""WITH {_SPEC} SELECT o_orderkey AS fish, {', '.join(f"max(amplitude) FILTER (h = {h}) AS ampl{h}, max(phase) FILTER (h = {h}) AS phase{h}" for h in range(3))},
  {', '.join(f"max(relampl) FILTER (h = {h}) AS relampl{h}, max(relpower) FILTER (h = {h}) AS relpower{h}" for h in (1, 2))}
FROM orders LEFT JOIN sp ON fish = o_orderkey GROUP BY o_orderkey""",
    "j4_attach_phases": f"""WITH {_SPEC} SELECT o_orderkey AS fish, max(amplitude) FILTER (h = 0) AS P1ampl, max(phase * 2) FILTER (h = 0) AS P1width, max(time) FILTER (h = 1) AS P2time,
  max(amplitude) FILTER (h = 1) AS P2ampl, max(relampl) FILTER (h = 1) AS P2relampl, max(phase * 2) FILTER (h = 1) AS P2width FROM orders LEFT JOIN sp ON fish = o_orderkey GROUP BY o_orderkey""",
    "t1_top_fish": f"WITH {_FISH} SELECT recording, fish FROM f QUALIFY row_number() OVER (PARTITION BY recording ORDER BY fish) <= 3",
    "t3_order_by_frequency": f'WITH {_FISH} SELECT recording, fish, (row_number() OVER (PARTITION BY recording ORDER BY EODf, fish) - 1)::INT AS "index" FROM f',
    "t4_renumber_fish": f"""WITH {_FISH}, k AS (SELECT *, CASE WHEN fish % 3 = 0 THEN 'pulse' ELSE 'wave' END AS type FROM f)
SELECT recording, fish, type, (row_number() OVER (PARTITION BY recording ORDER BY type, fish) - 1)::INT AS "index", CASE WHEN type = 'pulse' THEN nphases END AS nphases, CASE WHEN type = 'wave' THEN dbdiff END AS dbdiff FROM k""",
    "u1_all_table": f"WITH {_FISH} SELECT recording, fish, round(EODf, 6) AS EODf, CASE WHEN fish % 3 = 0 THEN nphases END AS nphases, CASE WHEN fish % 3 = 0 THEN 'pulse' ELSE 'wave' END AS type FROM f",
    "u2_union_tables": f"WITH {_FISH} SELECT recording, fish, round(EODf, 6) AS EODf, CASE WHEN fish % 3 = 0 THEN nphases END AS nphases, CASE WHEN fish % 3 <> 0 THEN dbdiff END AS dbdiff FROM f",
    "a23_table_statistics": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
}
