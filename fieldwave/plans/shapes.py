"""Queries over aligned waveforms, components of property tables and spectra of pulse trains."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwave.operators import spectra as S
from fieldwave.operators import waveforms as A

from .bind import WAVES, r6, samples, table, waveforms
from .kernels import _spectrum_sql


def aligned(spark, sf_dir):
    """Waveforms moved once to the mean of their label."""
    arrays = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return S.align_to_mean(arrays, ["id"], ["label"], rounds=1).select("id", F.posexplode("v").alias("pos", "v")).withColumn("v", r6("v"))


def properties(spark, sf_dir):
    """Two properties of line items, of which one is missing in every third line, on their components, raw and scaled."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fish"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).cast("double").alias("q"), (F.col("l_extendedprice") / 1000).cast("double").alias("p"))
    made = [S.property_pca(rows, ["fish", "line"], ["q", "p"], 2, scaled=scaled).select("fish", "line", F.lit(scaled).alias("scaled"), F.round(F.abs(F.col("scores")[0]), 4).alias("first"), F.round(F.abs(F.col("scores")[1]), 4).alias("second")) for scaled in (False, True)]
    return made[0].unionByName(made[1])


def train_spectrum(spark, sf_dir):
    """Each channel's hours with events are the times of the mean pulse of its label, the channel's last digit; the spectrum of these trains."""
    events = samples(spark, sf_dir).select("channel", F.floor(F.col("us") / 3_600_000_000).alias("idx")).distinct()
    mean = A.mean_waveform(waveforms(spark, sf_dir).withColumnRenamed("id", "event"), ["label"]).select(F.col("label").cast("long").alias("label"), (F.col("pos") - 32).alias("pos"), F.col("mean").alias("v"))
    waves = events.select("channel", (F.col("channel") % 10).alias("label")).distinct().join(mean, "label")
    return S.pulse_train_spectrum(events, waves, ["channel"], 64.0, 1.0).select("channel", "freq", F.round("power", 9).alias("power"))


QUERIES = {
    "m17_aligned_waveforms": aligned,
    "m16_property_pca": properties,
    "m3_train_spectrum": train_spectrum,
}
SQL = {
    "m17_aligned_waveforms": f"""WITH {WAVES}, m AS (SELECT label, pos, avg(v) AS m FROM w GROUP BY ALL),
c2 AS (SELECT id, m.pos - w.pos AS d, v * m AS x FROM w JOIN m ON m.label = w.label AND abs(m.pos - w.pos) <= 8),
lag AS (SELECT id, arg_max(d, (cc, -abs(d), -d)) AS d FROM (SELECT id, d, sum(x) AS cc FROM c2 GROUP BY ALL) GROUP BY id)
SELECT o.id, o.pos::INT AS pos, round(w.v, 6) AS v FROM w o JOIN lag USING (id) JOIN w ON w.id = o.id AND w.pos = greatest(0, least(63, o.pos - d))""",
    "m16_property_pca": """WITH r AS (SELECT l_orderkey AS fish, l_linenumber AS line, CASE WHEN l_linenumber <> 3 THEN l_quantity END::DOUBLE AS q, (l_extendedprice / 1000)::DOUBLE AS p FROM lineitem),
s AS (SELECT avg(q) AS mq, avg(p) AS mp, var_samp(q) AS a, var_samp(p) AS c, covar_samp(q, p) AS b FROM r),
e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM s),
x AS (SELECT fish, line, coalesce(q - mq, 0) AS x, coalesce(p - mp, 0) AS y, e.* FROM r, e)
SELECT fish, line, false AS scaled, round(abs(b * x + (l1 - a) * y) / sqrt(b * b + (l1 - a) ** 2), 4) AS first, round(abs(b * x + (l2 - a) * y) / sqrt(b * b + (l2 - a) ** 2), 4) AS second FROM x
UNION ALL SELECT fish, line, true, round(abs(x / sqrt(a) + sign(b) * y / sqrt(c)) / sqrt(2), 4), round(abs(x / sqrt(a) - sign(b) * y / sqrt(c)) / sqrt(2), 4) FROM x""",
    "m3_train_spectrum": f"""WITH e AS (SELECT DISTINCT user_id AS channel, (epoch_us(ts) - 1704067200000000) // 3600000000 AS idx FROM events),
n AS (SELECT *, lag(idx) OVER w AS b, lead(idx) OVER w AS a FROM e WINDOW w AS (PARTITION BY channel ORDER BY idx)),
w AS (SELECT label, pos - 32 AS pos, avg(v) AS v FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL),
t AS MATERIALIZED (SELECT channel, idx + pos AS idx, v FROM n JOIN w ON w.label = n.channel % 10 WHERE (b IS NULL OR pos > (b - idx) / 2) AND (a IS NULL OR pos <= (a - idx) / 2) AND idx + pos >= 0),
c AS (SELECT channel, greatest(1, (max(idx) + 1 - 64) // 32 + 1) AS n FROM t GROUP BY channel),
p AS MATERIALIZED (SELECT channel, s AS segment, idx - 32 * s AS k, v FROM (SELECT t.*, unnest([idx // 32, idx // 32 - 1]) AS s FROM t) JOIN c USING (channel) WHERE s >= 0 AND s < n),
{_spectrum_sql("SELECT g.channel, g.segment, k.k, coalesce(p.v, 0) AS x FROM (SELECT DISTINCT channel, segment FROM p) g CROSS JOIN range(64) k(k) LEFT JOIN p ON p.channel = g.channel AND p.segment = g.segment AND p.k = k.k", "channel, segment", 64, 64.0)}
SELECT channel, f * 1.0::DOUBLE AS freq, round(sum(power) / any_value(n), 9) AS power FROM spec JOIN c USING (channel) GROUP BY channel, f""",
}
