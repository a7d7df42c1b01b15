"""Event queries: users are channels, their events the samples of a signal."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldwave.operators import events as V
from fieldwave.operators import windows as N

from .bind import SAMPLES, r6, samples, table

_KEYS = ["channel"]


def _extrema(spark, sf_dir):
    """Strict local maxima and minima of every channel, as events."""
    w = W.partitionBy("channel").orderBy("idx")
    b, a, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
    rows = samples(spark, sf_dir).withColumn("kind", F.when((v > b) & (v > a), "peak").when((v < b) & (v < a), "trough"))
    return rows.where("kind is not null").select("channel", "idx", "t", "v", "kind")


_EXT = f"""{SAMPLES},
n AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM s WINDOW w AS (PARTITION BY channel ORDER BY idx)),
e AS (SELECT channel, idx, t, v, CASE WHEN v > b AND v > a THEN 'peak' WHEN v < b AND v < a THEN 'trough' END AS kind FROM n WHERE (v > b AND v > a) OR (v < b AND v < a))"""


def detect(spark, sf_dir):
    return V.detect_peaks(samples(spark, sf_dir), 10.0, _KEYS).select("channel", "idx", "v", "kind")


def trimmed(spark, sf_dir):
    return V.trim_events(_extrema(spark, sf_dir), _KEYS).select("channel", "n", "peak_idx", "trough_idx")


def trimmed_to_peak(spark, sf_dir):
    return V.trim_events(_extrema(spark, sf_dir), _KEYS, to_peak=True).select("channel", "n", "peak_idx", "trough_idx")


def _sides(spark, sf_dir):
    return V.assign_side_peaks(_extrema(spark, sf_dir), _KEYS)


def side_peaks(spark, sf_dir):
    return _sides(spark, sf_dir).select("channel", "idx", "trough_idx", r6("height").alias("height"), r6("width").alias("width"))


def shared_troughs(spark, sf_dir):
    return V.resolve_shared_troughs(_sides(spark, sf_dir), _KEYS).select("channel", "idx", "trough_idx")


def heights(spark, sf_dir):
    return V.make_events(_extrema(spark, sf_dir), _KEYS, 20_000.0).select("channel", "idx", r6("height").alias("height"))


def nearby(spark, sf_dir):
    rows = V.make_events(_extrema(spark, sf_dir), _KEYS, 20_000.0).select("channel", "idx", "t", "height")
    return V.discard_nearby(rows, 40_000.0, _KEYS).select("channel", "idx", r6("height").alias("height"))


def intervals(spark, sf_dir):
    out = V.interval_stats(samples(spark, sf_dir), _KEYS)
    return out.select("channel", "n", *(r6(c).alias(c) for c in ("median", "mean", "std", "cv")), F.round("EODf", 9).alias("EODf"))


def rates(spark, sf_dir):
    out = V.instant_rate(samples(spark, sf_dir), _KEYS, max_jump=0.5)
    return out.select("channel", "idx", F.round("rate", 9).alias("rate"), "steady")


def central(spark, sf_dir):
    return V.central_events(samples(spark, sf_dir), _KEYS, 10).select("channel", "idx")


def pulse_or_wave(spark, sf_dir):
    pairs = V.trim_events(_extrema(spark, sf_dir), _KEYS, to_peak=True)
    at = _extrema(spark, sf_dir).select("channel", "idx", "t")
    pairs = pairs.join(at.select("channel", F.col("idx").alias("peak_idx"), F.col("t").alias("peak_t")), ["channel", "peak_idx"]).join(at.select("channel", F.col("idx").alias("trough_idx"), F.col("t").alias("trough_t")), ["channel", "trough_idx"])
    return V.classify_pulse_wave(pairs, _KEYS, 0.3).select("channel", "n", r6("ratio").alias("ratio"), "is_pulse")


def _clusters(spark, sf_dir):
    rows = samples(spark, sf_dir)
    return rows.select("channel", "t", "event_id", (F.col("idx") % 7 * F.col("idx") % 5).alias("label"), (F.col("v") * 100).alias("width"))


_CLUST = f"{SAMPLES}, c AS (SELECT channel, t, event_id, idx % 7 * idx % 5 AS label, v * 100 AS width FROM s)"


def pruned(spark, sf_dir):
    return V.prune_clusters(_clusters(spark, sf_dir), 8, 0.15, _KEYS).select("channel", "event_id", "label")


def sparse(spark, sf_dir):
    return V.drop_sparse_clusters(_clusters(spark, sf_dir), 30 * 86_400.0, _KEYS, rho=0.004).select("channel", "event_id", "label")


def unreliable(spark, sf_dir):
    return V.drop_unreliable_clusters(_clusters(spark, sf_dir), _KEYS, 0.5).select("channel", "event_id", "label")


def wide(spark, sf_dir):
    return V.discard_wide_pulses(None, _clusters(spark, sf_dir).withColumn("width", F.col("width") * 10), _KEYS).select("channel", "event_id", "label")


def width_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("width", F.col("v") / 1000).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("channel")))
    return V.filter_pulses(rows, 500.0, 0.002, 0.01, n_samples="n").select("channel", "idx")


def _snips(spark, sf_dir):
    """Samples around every peak."""
    peaks = _extrema(spark, sf_dir).where("kind = 'peak'").select("channel", "idx")
    return V.snippets(samples(spark, sf_dir), peaks, _KEYS, 3, 5, block=16)


_SNIP = f"""{_EXT}, l AS (SELECT channel, max(idx) AS last FROM s GROUP BY channel),
sn AS (SELECT s.channel, e.idx AS event, s.idx - e.idx AS pos, s.v FROM s JOIN e ON s.channel = e.channel AND e.kind = 'peak' AND s.idx BETWEEN e.idx - 3 AND e.idx + 4
  JOIN l ON l.channel = s.channel WHERE e.idx >= 3 AND e.idx + 4 <= last)"""


def snippets(spark, sf_dir):
    return _snips(spark, sf_dir).select("channel", "event", "pos", r6("v").alias("v"))


def clipped(spark, sf_dir):
    return V.clipped_fraction(_snips(spark, sf_dir), _KEYS, 0.5, 120.0).select("channel", r6("clipped").alias("clipped"), "n")


def clip_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("channel"), (F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1).alias("idx"), F.greatest(F.lit(8.0), F.least(F.lit(43.0), F.col("l_quantity"))).alias("v"))
    out = N.clip_amplitudes(rows, _KEYS, 100, 8.0, 43.0)
    return out.select("channel", r6("min_clip").alias("min_clip"), r6("max_clip").alias("max_clip"))


def percentiles(spark, sf_dir):
    out = N.percentile_threshold(samples(spark, sf_dir), _KEYS, 16, 0.5, 0.1)
    return out.select("channel", "window", r6("threshold").alias("threshold"))


def median_std(spark, sf_dir):
    return N.median_std_threshold(samples(spark, sf_dir), _KEYS, 8, 2.0).select("channel", r6("threshold").alias("threshold"))


def std(spark, sf_dir):
    return N.std_threshold(samples(spark, sf_dir), _KEYS, 3.0).select("channel", r6("threshold").alias("threshold"))


def floor_std(spark, sf_dir):
    return N.floor_std_threshold(samples(spark, sf_dir), _KEYS, 16, 60.0).select("channel", "window", r6("threshold").alias("threshold"))


def _pairs(spark, sf_dir):
    e = _extrema(spark, sf_dir)
    p = V.trim_events(e, _KEYS, to_peak=True)
    t = lambda kind: e.where(F.col("kind") == kind).select("channel", F.col("idx").alias(f"{kind}_idx"), F.col("t").alias(f"{kind}_t"))
    return p.join(t("peak"), ["channel", "peak_idx"]).join(t("trough"), ["channel", "trough_idx"])


_START, _SIZE, _SHIFT, _DAY = 0.0, 864_000.0, 432_000.0, 86_400.0


def _criteria(spark, sf_dir):
    """Windows up to the end of the day of the last event."""
    last = samples(spark, sf_dir).agg(F.max("t")).first()[0] or 0.0
    return N.window_criteria(_pairs(spark, sf_dir), _KEYS, _START, -(-last // _DAY) * _DAY, _SIZE, _SHIFT, 0.6, 100.0)


def criteria(spark, sf_dir):
    return _criteria(spark, sf_dir).select("channel", "window", *(r6(c).alias(c) for c in ("cv_interv", "mean_ampl", "cv_ampl", "clipped")))


def best_window(spark, sf_dir):
    out = N.best_window(_criteria(spark, sf_dir), _KEYS, w_mean=0.01, tolerance=0.2, expand=True)
    return out.select("channel", "first", "last", r6("cost").alias("cost"), r6("clipped").alias("clipped"))


def analysis_window(spark, sf_dir):
    return N.analysis_window(samples(spark, sf_dir), _KEYS, 2.0, 30.0, "center")


_SIDES = f"""{_EXT},
q AS (SELECT *, CASE WHEN lag(kind) OVER w = 'trough' THEN lag(idx) OVER w END AS li, CASE WHEN lag(kind) OVER w = 'trough' THEN v - lag(v) OVER w END AS lh, CASE WHEN lag(kind) OVER w = 'trough' THEN abs(t - lag(t) OVER w) END AS lw,
  CASE WHEN lead(kind) OVER w = 'trough' THEN lead(idx) OVER w END AS ri, CASE WHEN lead(kind) OVER w = 'trough' THEN v - lead(v) OVER w END AS rh, CASE WHEN lead(kind) OVER w = 'trough' THEN abs(t - lead(t) OVER w) END AS rw
  FROM e WINDOW w AS (PARTITION BY channel ORDER BY idx)),
z AS (SELECT *, CASE WHEN ri IS NULL THEN true WHEN li IS NULL THEN false WHEN abs(lh / lw - rh / rw) <= 0.25 * (lh / lw + rh / rw) / 2 THEN lh >= rh ELSE lh / lw > rh / rw END AS le
  FROM q WHERE kind = 'peak' AND (li IS NOT NULL OR ri IS NOT NULL)),
sp AS (SELECT channel, idx, CASE WHEN le THEN li ELSE ri END AS trough_idx, CASE WHEN le THEN lh ELSE rh END AS height, CASE WHEN le THEN lw ELSE rw END AS width, CASE WHEN le THEN lh / lw ELSE rh / rw END AS slope FROM z)"""
_TRIM = """p AS (SELECT channel, kind, idx, t, v, row_number() OVER (PARTITION BY channel, kind ORDER BY idx) - 1 AS n FROM {0})"""
_FROM_PEAK = "e2 AS (SELECT e.* FROM e JOIN (SELECT channel, min(idx) AS f FROM e WHERE kind = 'peak' GROUP BY channel) USING (channel) WHERE idx >= f)"
_PAIRS = f"""{_EXT}, {_FROM_PEAK}, {_TRIM.format('e2')},
pr AS (SELECT a.channel, a.n, a.idx AS peak_idx, b.idx AS trough_idx, a.t AS peak_t, b.t AS trough_t, a.v AS peak_v, b.v AS trough_v FROM p a JOIN p b USING (channel, n) WHERE a.kind = 'peak' AND b.kind = 'trough')"""
_STEP = _SHIFT / 2
_WINDOWS = f"wn AS (SELECT unnest(range(0, greatest(0, floor((ceil(max(t) / {_DAY}) * {_DAY} - {_SIZE}) / {_STEP} + 1e-9)::BIGINT + 1))) AS i FROM s)"


def _side_sql(kind: str, beyond: str) -> str:
    return f"""{kind}_w AS (SELECT channel, i AS "window", {kind}_t AS t, {kind}_v AS v FROM pr, wn WHERE {kind}_t BETWEEN i * {_STEP} AND i * {_STEP} + {_SIZE}),
{kind}_d AS (SELECT *, t - lag(t) OVER (PARTITION BY channel, "window" ORDER BY t) AS d FROM {kind}_w),
{kind}_s AS (SELECT channel, "window", count(d) AS nd, avg(d) AS m, stddev_pop(d) AS s, min(t) AS a, max(t) AS b, count(*) FILTER ({beyond}) AS c FROM {kind}_d GROUP BY ALL),
{kind}_c AS (SELECT channel, "window", c, CASE WHEN nd > 2 THEN s / m * CASE WHEN a - "window" * {_STEP} > m THEN (a - "window" * {_STEP}) / m ELSE 1 END
  * CASE WHEN "window" * {_STEP} + {_SIZE} - b > m THEN ("window" * {_STEP} + {_SIZE} - b) / m ELSE 1 END END AS cv FROM {kind}_s)"""


_CRIT = f"""{_PAIRS}, {_WINDOWS}, {_side_sql('peak', 'v > 100')}, {_side_sql('trough', 'v < 0.6')},
am AS (SELECT channel, i AS "window", count(*) AS n, avg(peak_v - trough_v) AS mh, stddev_pop(peak_v - trough_v) AS sh FROM pr, wn
  WHERE peak_t BETWEEN i * {_STEP} AND i * {_STEP} + {_SIZE} AND trough_t BETWEEN i * {_STEP} AND i * {_STEP} + {_SIZE} GROUP BY ALL),
cr AS (SELECT channel, "window", coalesce((p.cv + t.cv) / 2, 1000) AS cv_interv, (coalesce(p.c, 0) + coalesce(t.c, 0)) / 2.0 / n AS cl, n, mh, sh FROM am LEFT JOIN peak_c p USING (channel, "window") LEFT JOIN trough_c t USING (channel, "window")),
cc AS (SELECT channel, "window", cv_interv, CASE WHEN n > 2 THEN mh * pow(1 - cl, 2) ELSE 0 END AS mean_ampl, CASE WHEN n > 2 THEN sh / mh ELSE 1000 END AS cv_ampl, CASE WHEN n > 2 THEN cl ELSE 1 END AS clipped FROM cr)"""

QUERIES = {
    "w1_detect_peaks": detect,
    "w2_trim_events": trimmed,
    "w2_trim_to_peak": trimmed_to_peak,
    "w3_side_peaks": side_peaks,
    "w4_shared_troughs": shared_troughs,
    "w5_event_heights": heights,
    "w6_discard_nearby": nearby,
    "w13_instant_rate": rates,
    "w17_wide_pulses": wide,
    "a6_interval_stats": intervals,
    "a9_central_events": central,
    "a16_pulse_or_wave": pulse_or_wave,
    "a17_prune_clusters": pruned,
    "a18_sparse_clusters": sparse,
    "a19_unreliable_clusters": unreliable,
    "p9_filter_pulses": width_filter,
    "j14_snippets": snippets,
    "j15_clipped_fraction": clipped,
    "a3_clip_limits": clip_limits,
    "a4_percentile_threshold": percentiles,
    "a5_median_std_threshold": median_std,
    "a5_std_threshold": std,
    "a5_floor_std_threshold": floor_std,
    "a15_window_criteria": criteria,
    "w9_best_window": best_window,
    "w10_analysis_window": analysis_window,
}
SQL = {
    "w1_detect_peaks": f"""WITH RECURSIVE {SAMPLES}, c AS MATERIALIZED (SELECT channel, idx, v FROM s),
r AS (SELECT channel, idx, 0 AS way, v AS hv, idx AS hi, v AS lv, idx AS li, NULL::VARCHAR AS kind, idx AS at_idx, v AS at_v FROM c WHERE idx = 0
  UNION ALL SELECT channel, idx, CASE kind WHEN 'peak' THEN -1 WHEN 'trough' THEN 1 ELSE way END, CASE kind WHEN 'trough' THEN v ELSE hv END, CASE kind WHEN 'trough' THEN idx ELSE hi END,
    CASE kind WHEN 'peak' THEN v ELSE lv END, CASE kind WHEN 'peak' THEN idx ELSE li END, kind, CASE kind WHEN 'peak' THEN hi WHEN 'trough' THEN li END, CASE kind WHEN 'peak' THEN hv WHEN 'trough' THEN lv END
  FROM (SELECT *, CASE WHEN way >= 0 AND hv - v > 10 THEN 'peak' WHEN way <= 0 AND v - lv > 10 THEN 'trough' END AS kind FROM (
    SELECT r.channel, c.idx, c.v, way, CASE WHEN way >= 0 AND c.v > hv THEN c.v ELSE hv END AS hv, CASE WHEN way >= 0 AND c.v > hv THEN c.idx ELSE hi END AS hi,
      CASE WHEN way <= 0 AND c.v < lv THEN c.v ELSE lv END AS lv, CASE WHEN way <= 0 AND c.v < lv THEN c.idx ELSE li END AS li FROM r JOIN c ON c.channel = r.channel AND c.idx = r.idx + 1)))
SELECT channel, at_idx::INT AS idx, at_v AS v, kind FROM r WHERE kind IS NOT NULL""",
    "w2_trim_events": f"WITH {_EXT}, {_TRIM.format('e')} SELECT a.channel, a.n::INT AS n, a.idx::INT AS peak_idx, b.idx::INT AS trough_idx FROM p a JOIN p b USING (channel, n) WHERE a.kind = 'peak' AND b.kind = 'trough'",
    "w2_trim_to_peak": f"WITH {_PAIRS} SELECT channel, n::INT AS n, peak_idx::INT AS peak_idx, trough_idx::INT AS trough_idx FROM pr",
    "w3_side_peaks": f"WITH {_SIDES} SELECT channel, idx::INT AS idx, trough_idx::INT AS trough_idx, round(height, 6) AS height, round(width, 6) AS width FROM sp",
    "w4_shared_troughs": f"""WITH {_SIDES},
y AS (SELECT *, lag(trough_idx) OVER w AS bi, lag(slope) OVER w AS bs, lag(height) OVER w AS bh, lead(trough_idx) OVER w AS ai, lead(slope) OVER w AS as_, lead(height) OVER w AS ah FROM sp WINDOW w AS (PARTITION BY channel ORDER BY idx))
SELECT channel, idx::INT AS idx, trough_idx::INT AS trough_idx FROM y
WHERE NOT coalesce(trough_idx = bi AND CASE WHEN abs(slope - bs) <= 0.25 * (slope + bs) / 2 THEN height <= bh ELSE slope < bs END, false)
  AND NOT coalesce(trough_idx = ai AND CASE WHEN abs(slope - as_) <= 0.25 * (slope + as_) / 2 THEN height < ah ELSE slope < as_ END, false)""",
    "w5_event_heights": f"""WITH {_EXT}, q AS (SELECT *, CASE WHEN lag(kind) OVER w = 'trough' AND abs(t - lag(t) OVER w) <= 20000 THEN v - lag(v) OVER w END AS l,
  CASE WHEN lead(kind) OVER w = 'trough' AND abs(t - lead(t) OVER w) <= 20000 THEN v - lead(v) OVER w END AS r FROM e WINDOW w AS (PARTITION BY channel ORDER BY t))
SELECT channel, idx::INT AS idx, round((coalesce(l, r) + coalesce(r, l)) / 2, 6) AS height FROM q WHERE kind = 'peak' AND coalesce(l, r) IS NOT NULL""",
    "w6_discard_nearby": f"""WITH RECURSIVE {_EXT}, q AS (SELECT *, CASE WHEN lag(kind) OVER w = 'trough' AND abs(t - lag(t) OVER w) <= 20000 THEN v - lag(v) OVER w END AS l,
  CASE WHEN lead(kind) OVER w = 'trough' AND abs(t - lead(t) OVER w) <= 20000 THEN v - lead(v) OVER w END AS r FROM e WINDOW w AS (PARTITION BY channel ORDER BY t)),
h AS MATERIALIZED (SELECT channel, idx, t, (coalesce(l, r) + coalesce(r, l)) / 2 AS height FROM q WHERE kind = 'peak' AND coalesce(l, r) IS NOT NULL),
it AS (SELECT 0 AS k, channel, idx, t, height FROM h
  UNION ALL SELECT k + 1, channel, idx, t, height FROM (SELECT *, bool_or(gone) OVER () AS more FROM (
    SELECT *, coalesce(lead(t) OVER w - t < 40000 AND height < lead(height) OVER w, false) OR coalesce(t - lag(t) OVER w < 40000 AND NOT lag(height) OVER w < height, false) AS gone
    FROM it WINDOW w AS (PARTITION BY channel ORDER BY t))) WHERE more AND NOT gone)
SELECT channel, idx::INT AS idx, round(height, 6) AS height FROM it WHERE k = (SELECT max(k) FROM it)""",
    "w13_instant_rate": f"""WITH {SAMPLES}, r AS (SELECT channel, idx, 1 / (lead(t) OVER w - t) AS rate FROM s WINDOW w AS (PARTITION BY channel ORDER BY t))
SELECT channel, idx::INT AS idx, round(rate, 9) AS rate, abs(rate / lag(rate) OVER (PARTITION BY channel ORDER BY idx) - 1) < 0.5 AS steady FROM r""",
    "w17_wide_pulses": f"""WITH {_CLUST}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY channel, label ORDER BY t) AS d FROM c), m AS (SELECT channel, label, avg(d) AS m FROM d GROUP BY ALL),
b AS (SELECT channel, label FROM d JOIN m USING (channel, label) GROUP BY ALL HAVING avg((width * 10 > 0.1 * m.m)::INT) > 0.5)
SELECT channel, event_id, label::INT AS label FROM c ANTI JOIN b USING (channel, label)""",
    "a6_interval_stats": f"""WITH {SAMPLES}, d AS (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t) AS d FROM s), i AS (SELECT * FROM d WHERE d IS NOT NULL),
f AS (SELECT channel, stddev_pop(d) / avg(d) AS cv, quantile_cont(d, 0.3) AS p FROM i GROUP BY channel),
u AS (SELECT channel, CASE WHEN cv < 0.5 OR d < p THEN d END AS d FROM i JOIN f USING (channel))
SELECT channel, count(d) AS n, round(quantile_cont(d, 0.5), 6) AS median, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(stddev_pop(d) / avg(d), 6) AS cv, round(1 / quantile_cont(d, 0.5), 9) AS EODf FROM u GROUP BY channel""",
    "a9_central_events": f"""WITH {SAMPLES}, c AS (SELECT channel, idx, count(*) OVER (PARTITION BY channel) AS n FROM s)
SELECT channel, idx::INT AS idx FROM c WHERE idx >= greatest(0, floor((n - 10) / 2.0)) AND idx < greatest(0, floor((n - 10) / 2.0)) + 10""",
    "a16_pulse_or_wave": f"""WITH {_PAIRS}, q AS (SELECT *, lead(peak_t) OVER w AS np, lead(trough_t) OVER w AS nt FROM pr WINDOW w AS (PARTITION BY channel ORDER BY n)),
x AS (SELECT channel, abs((trough_t - peak_t) / (np - peak_t)) AS d, abs((np - trough_t) / (nt - trough_t)) AS u FROM q),
y AS (SELECT channel, CASE WHEN d > 0.5 THEN 1 - d ELSE d END AS d, CASE WHEN u > 0.5 THEN 1 - u ELSE u END AS u FROM x)
SELECT channel, count(d) AS n, round((median(d) + median(u)) / 2, 6) AS ratio, (median(d) + median(u)) / 2 < 0.3 AS is_pulse FROM y GROUP BY channel HAVING count(d) > 0""",
    "a17_prune_clusters": f"""WITH {_CLUST} SELECT channel, event_id, CASE WHEN count(*) OVER (PARTITION BY channel, label) < 8 OR count(*) OVER (PARTITION BY channel, label) / count(*) OVER (PARTITION BY channel) < 0.15 THEN -1 ELSE label END::INT AS label FROM c""",
    "a18_sparse_clusters": f"WITH {_CLUST}, g AS (SELECT channel, label FROM c GROUP BY ALL HAVING count(*) * median(width) >= 2592000 * 0.004) SELECT channel, event_id, label::INT AS label FROM c SEMI JOIN g USING (channel, label)",
    "a19_unreliable_clusters": f"""WITH {_CLUST}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY channel, label ORDER BY t) AS d FROM c),
g AS (SELECT channel, label FROM d GROUP BY ALL HAVING count(*) >= 2 AND NOT median(width) / min(d) > 0.5) SELECT channel, event_id, label::INT AS label FROM c SEMI JOIN g USING (channel, label)""",
    "p9_filter_pulses": f"WITH {SAMPLES}, c AS (SELECT *, count(*) OVER (PARTITION BY channel) AS n FROM s) SELECT channel, idx::INT AS idx FROM c WHERE v / 1000 > 0.002 AND v / 1000 < 0.01 AND idx > 5 AND idx < n - 5",
    "j14_snippets": f"WITH {_SNIP} SELECT channel, event::INT AS event, pos::INT AS pos, round(v, 6) AS v FROM sn",
    "j15_clipped_fraction": f"WITH {_SNIP}, c AS (SELECT channel, event, (max(v) >= 120 OR min(v) <= 0.5)::INT AS c FROM sn GROUP BY ALL) SELECT channel, round(avg(c), 6) AS clipped, count(*) AS n FROM c GROUP BY channel",
    "a3_clip_limits": """WITH s AS (SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx, greatest(8.0, least(43.0, l_quantity)) AS v FROM lineitem),
n AS (SELECT channel, max(idx) + 1 AS n FROM s GROUP BY channel),
h AS (SELECT channel, idx // 100 AS w, least(18, greatest(0, floor((v - 8.0) / (35.0 / 19)))) AS b FROM s JOIN n USING (channel) WHERE (idx // 100 + 1) * 100 < n),
k AS (SELECT channel, w, CASE WHEN count(*) FILTER (b = 0) > 2 * count(*) FILTER (b = 2) THEN 8.0 + 35.0 / 19 ELSE 8.0 END AS lo, CASE WHEN count(*) FILTER (b = 18) > 2 * count(*) FILTER (b = 16) THEN 43.0 - 35.0 / 19 ELSE 43.0 END AS hi FROM h GROUP BY ALL)
SELECT channel, round(max(lo)::DOUBLE, 6) AS min_clip, round(min(hi)::DOUBLE, 6) AS max_clip FROM k GROUP BY channel""",
    "a4_percentile_threshold": f'WITH {SAMPLES} SELECT channel, idx // 16 AS "window", round(0.5 * (quantile_cont(v, 0.9) - quantile_cont(v, 0.1)), 6) AS threshold FROM s GROUP BY ALL',
    "a5_median_std_threshold": f"WITH {SAMPLES}, x AS (SELECT channel, idx // 8 AS w, stddev_pop(v) AS s FROM s GROUP BY ALL) SELECT channel, round(2 * median(s), 6) AS threshold FROM x GROUP BY channel",
    "a5_std_threshold": f"WITH {SAMPLES} SELECT channel, round(3 * stddev_pop(v), 6) AS threshold FROM s GROUP BY channel",
    "a5_floor_std_threshold": f'WITH {SAMPLES} SELECT channel, idx // 16 AS "window", round(greatest(4 * stddev_pop(v), 60), 6) AS threshold FROM s GROUP BY ALL',
    "a15_window_criteria": f'WITH {_CRIT} SELECT channel, "window"::INT AS "window", round(cv_interv, 6) AS cv_interv, round(mean_ampl, 6) AS mean_ampl, round(cv_ampl, 6) AS cv_ampl, round(clipped, 6) AS clipped FROM cc',
    "w9_best_window": f"""WITH {_CRIT}, k AS (SELECT *, cv_interv + cv_ampl - 0.01 * mean_ampl AS cost FROM cc), m AS (SELECT *, min(cost) OVER (PARTITION BY channel) AS least FROM k),
g AS (SELECT *, "window" - row_number() OVER (PARTITION BY channel ORDER BY "window") AS run FROM m WHERE cost <= least + 0.2),
r AS (SELECT channel, run, count(*) AS n, min("window") AS first, max("window") AS last, min(cost) AS cost, avg(clipped) AS clipped FROM g GROUP BY ALL)
SELECT channel, first::INT AS first, last::INT AS last, round(cost, 6) AS cost, round(clipped, 6) AS clipped FROM r QUALIFY row_number() OVER (PARTITION BY channel ORDER BY n DESC, first) = 1""",
    "w10_analysis_window": f"WITH {SAMPLES}, n AS (SELECT channel, max(idx) + 1 AS n FROM s GROUP BY channel) SELECT channel, floor((n - 60) / 2.0)::BIGINT AS first, floor((n - 60) / 2.0)::BIGINT + 60 AS last FROM n WHERE n >= 60",
}
