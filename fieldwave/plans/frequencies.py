"""Frequency queries: a user's events are the frequencies of a recording, whose days are its elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwave.operators import frequencies as Q

from .bind import FREQS, frequencies, r6, table

_TOL = 0.05


def diffs(spark, sf_dir):
    return Q.freq_diffs(frequencies(spark, sf_dir), ["recording", "element"]).select("recording", "i", "j", r6("diff").alias("diff"), r6("ratio").alias("ratio"))


def intervals(spark, sf_dir):
    out = Q.freq_intervals(frequencies(spark, sf_dir), ["recording", "element"])
    return out.select("recording", "i", "j", "interval", r6("deviation").alias("deviation"), r6("rel_deviation").alias("rel_deviation"))


def similar(spark, sf_dir):
    out = Q.similar_frequencies(frequencies(spark, sf_dir), _TOL, ["recording"])
    return out.select("recording", "element", "id", "element_b", "id_b")


def relative_power(spark, sf_dir):
    return Q.relative_power(frequencies(spark, sf_dir), ["recording", "element"]).select("element", "id", r6("relpower").alias("relpower"))


def ranks(spark, sf_dir):
    return Q.power_ranks(frequencies(spark, sf_dir), ["recording", "element"]).select("element", "id", "rank")


def unique(spark, sf_dir):
    return Q.unique_mask(frequencies(spark, sf_dir), _TOL, "power", ["recording"]).select("recording", "element", "id")


def unique_groups(spark, sf_dir):
    out = Q.unique_frequencies_index(frequencies(spark, sf_dir), _TOL, ["recording"])
    return out.select("recording", "unique", "element", "id", r6("f").alias("f"))


def _elements(spark, sf_dir):
    """Three elements per recording, for what must hold in all of them."""
    rows = frequencies(spark, sf_dir)
    return rows.withColumn("element", F.col("id") % 3)


def consistent(spark, sf_dir):
    return Q.consistent(_elements(spark, sf_dir), 0.5, ["recording"]).select("recording", "unique", "n", "element", "id", r6("f").alias("f"))


def closest(spark, sf_dir):
    return Q.closest(frequencies(spark, sf_dir), 0.5, 0.3, 2, ["recording"]).select("recording", "unique", "id", r6("f").alias("f"), "first", "last")


def _harmonics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("rec"), F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("h"), F.col("l_quantity").alias("freq"), F.col("l_extendedprice").alias("power"))


def fundamentals(spark, sf_dir):
    one = _harmonics(spark, sf_dir).groupBy("grp", "h").agg(F.min("freq").alias("freq"), F.sum("power").alias("power"))
    return Q.fundamentals(one, ["grp"]).select("grp", "f", r6("db").alias("db"))


def top_groups(spark, sf_dir):
    one = _harmonics(spark, sf_dir).groupBy("rec", "grp", "h").agg(F.min("freq").alias("freq"), F.sum(F.round(F.col("power") * 100).cast("long")).alias("power"))
    return Q.top_groups(one, ["rec"], "grp", 5).select("rec", "grp", "index", "f")


def mains(spark, sf_dir):
    return Q.drop_mains(frequencies(spark, sf_dir), "f", 5.0, 0.5).select("recording", "id", r6("f").alias("f"))


def match_power(spark, sf_dir):
    rows = _harmonics(spark, sf_dir)
    coeffs = rows.where("h <= 3").groupBy("grp", "h").agg(F.max("power").alias("amplitude")).withColumn("f0", F.lit(8.0))
    peaks = rows.groupBy("grp", "freq").agg(F.max("power").alias("power"))
    return Q.match_harmonic_power(coeffs, peaks, ["grp"]).select("grp", "h", r6("amplitude").alias("amplitude"), r6("datapower").alias("datapower"))


_SIM = f"""WITH {FREQS},
x AS (SELECT a.recording, a.element, a.id, b.element AS element_b, b.id AS id_b, abs(a.f - b.f) AS gap, a.power AS pa, b.power AS pb
  FROM f a JOIN f b ON a.recording = b.recording AND a.element < b.element AND abs(a.f - b.f) < {_TOL}),
y AS (SELECT *, row_number() OVER (PARTITION BY recording, element, id, element_b ORDER BY gap, id_b) AS n1,
  row_number() OVER (PARTITION BY recording, element_b, id_b, element ORDER BY gap, id) AS n2 FROM x),
z AS (SELECT * FROM y WHERE n1 = 1 AND n2 = 1)"""


def _unique_sql(element: str, tol: float) -> str:
    """g(recording, u, element, id, f, power): members of each distinct frequency, by the greedy pass."""
    return f"""WITH RECURSIVE {FREQS.replace("f AS (", "f0 AS (", 1)}, f AS (SELECT recording, {element} AS element, id, f, power FROM f0),
x AS (SELECT a.recording, a.element, a.id, b.element AS element_b, b.id AS id_b, abs(a.f - b.f) AS gap
  FROM f a JOIN f b ON a.recording = b.recording AND a.element < b.element AND abs(a.f - b.f) < {tol}),
z AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording, element, id, element_b ORDER BY gap, id_b) AS n1,
  row_number() OVER (PARTITION BY recording, element_b, id_b, element ORDER BY gap, id) AS n2 FROM x) WHERE n1 = 1 AND n2 = 1),
q AS (SELECT id, list(o) AS ps FROM (SELECT id, id_b AS o FROM z UNION ALL SELECT id_b, id FROM z) GROUP BY id),
o AS MATERIALIZED (SELECT recording, f.id, coalesce(ps, []) AS ps, row_number() OVER (PARTITION BY recording ORDER BY element, f, f.id) AS n FROM f LEFT JOIN q ON q.id = f.id),
r AS (SELECT DISTINCT recording, 0::BIGINT AS n, []::BIGINT[] AS taken, -1 AS u, []::BIGINT[] AS got FROM f
  UNION ALL SELECT recording, n, list_concat(taken, got) AS taken, u + (len(got) > 0)::INT AS u, got FROM (
    SELECT r.recording, o.n, r.taken, r.u, CASE WHEN list_contains(r.taken, o.id) THEN [] ELSE list_concat([o.id], list_filter(o.ps, lambda i: NOT list_contains(r.taken, i))) END AS got
    FROM r JOIN o ON o.recording = r.recording AND o.n = r.n + 1)),
g AS (SELECT m.recording, u, element, f.id, f, power FROM (SELECT recording, u, unnest(got) AS id FROM r) m JOIN f ON f.id = m.id)"""


_UP = "CASE WHEN ratio < 0.98 THEN 1 / ratio ELSE ratio END"
_TABLE = ", ".join(f"({k}, {num}/{den}::DOUBLE)" for _, num, den, k in Q.INTERVALS)

QUERIES = {
    "j6_freq_diffs": diffs,
    "j7_freq_intervals": intervals,
    "j8_similar_frequencies": similar,
    "j9_unique_groups": unique_groups,
    "j10_unique_mask": unique,
    "j11_consistent": consistent,
    "j12_closest": closest,
    "j13_match_power": match_power,
    "w7_relative_power": relative_power,
    "w8_power_ranks": ranks,
    "a10_fundamentals": fundamentals,
    "t2_top_groups": top_groups,
    "p8_drop_mains": mains,
}
SQL = {
    "j6_freq_diffs": f"WITH {FREQS} SELECT a.recording, a.id AS i, b.id AS j, round(a.f - b.f, 6) AS diff, round(a.f / b.f, 6) AS ratio FROM f a JOIN f b USING (recording, element)",
    "j7_freq_intervals": f"""WITH {FREQS}, p AS (SELECT a.recording, a.id AS i, b.id AS j, a.f / b.f AS ratio FROM f a JOIN f b USING (recording, element) WHERE a.id <> b.id),
q AS (SELECT *, {_UP} AS up FROM p WHERE ratio >= 0.5 AND ratio < 2.05), t(interval, pure) AS (VALUES {_TABLE})
SELECT recording, i, j, interval::DOUBLE AS interval, round(up - pure, 6) AS deviation, round((up - pure) / pure, 6) AS rel_deviation FROM q, t
QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY abs(up - pure), interval) = 1""",
    "j8_similar_frequencies": f"{_SIM} SELECT recording, element, id, element_b, id_b FROM z",
    "j10_unique_mask": f"""{_SIM} SELECT recording, element, id FROM f WHERE id NOT IN (SELECT CASE WHEN pa <= pb THEN id ELSE id_b END FROM z)""",
    "j9_unique_groups": f"{_unique_sql('element', _TOL)} SELECT recording, u AS \"unique\", element, id, round(f, 6) AS f FROM g",
    "j11_consistent": f"""{_unique_sql('id % 3', 0.5)}, e AS (SELECT recording, count(DISTINCT element) AS elements FROM f GROUP BY recording),
b AS (SELECT *, count(DISTINCT element) OVER (PARTITION BY recording, u) AS n, row_number() OVER (PARTITION BY recording, u ORDER BY power DESC, element) AS k FROM g)
SELECT recording, u AS "unique", n, element, id, round(f, 6) AS f FROM b JOIN e USING (recording) WHERE k = 1 AND n = elements""",
    "j12_closest": f"""{_unique_sql('element', 0.5)},
a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY recording, u, element ORDER BY power DESC, f, id) = 1),
s AS (SELECT *, CASE WHEN element - lag(element) OVER w = 1 THEN abs(f - lag(f) OVER w) END AS step FROM a WINDOW w AS (PARTITION BY recording, u ORDER BY element)),
d AS (SELECT *, arg_min(element, (step, element)) FILTER (step IS NOT NULL) OVER (PARTITION BY recording, u) AS seed FROM s),
c AS (SELECT *, sum(CASE WHEN step < 0.3 OR element = seed THEN 0 ELSE 1 END) OVER (PARTITION BY recording, u ORDER BY element) AS run FROM d WHERE seed IS NOT NULL),
k AS (SELECT *, max(CASE WHEN element = seed THEN run END) OVER (PARTITION BY recording, u) AS mid FROM c)
SELECT recording, u AS "unique", arg_max(id, (power, -element)) AS id, round(arg_max(f, (power, -element)), 6) AS f, min(element) AS first, max(element) AS last
FROM k WHERE run = mid GROUP BY recording, u HAVING count(*) >= 2""",
    "w7_relative_power": f"WITH {FREQS} SELECT element, id, round(power - max(power) OVER (PARTITION BY recording, element), 6) AS relpower FROM f",
    "w8_power_ranks": f"WITH {FREQS} SELECT element, id, (1 - row_number() OVER (PARTITION BY recording, element ORDER BY power DESC, id))::INT AS rank FROM f",
    "a10_fundamentals": """WITH g AS (SELECT l_orderkey AS grp, l_linenumber AS h, min(l_quantity) AS freq, sum(l_extendedprice) AS power FROM lineitem GROUP BY ALL)
SELECT grp, arg_min(freq, h) AS f, round(10 * log10(sum(power)), 6) AS db FROM g GROUP BY grp""",
    "t2_top_groups": """WITH g AS (SELECT l_suppkey AS rec, l_orderkey AS grp, l_linenumber AS h, min(l_quantity) AS freq, sum(round(l_extendedprice * 100)::BIGINT) AS power FROM lineitem GROUP BY ALL),
t AS (SELECT rec, grp, arg_min(freq, h) AS f, sum(power) AS power FROM g GROUP BY ALL),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY rec ORDER BY power DESC, grp) <= 5)
SELECT rec, grp, (row_number() OVER (PARTITION BY rec ORDER BY f, grp) - 1)::INT AS "index", f FROM b""",
    "p8_drop_mains": f"WITH {FREQS} SELECT recording, id, round(f, 6) AS f FROM f WHERE abs(f - round(f / 5.0) * 5.0) >= 0.5",
    "j13_match_power": """WITH c AS (SELECT l_orderkey AS grp, l_linenumber AS h, max(l_extendedprice) AS amplitude FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
b AS (SELECT grp, max(h) AS last FROM c GROUP BY grp), p AS (SELECT l_orderkey AS grp, l_quantity AS freq, max(l_extendedprice) AS power FROM lineitem GROUP BY ALL),
n AS (SELECT grp, last, floor(freq / 8.0 + 0.5)::BIGINT AS h, freq, power FROM p JOIN b USING (grp)),
i AS (SELECT grp, h, any_value(last) AS last, arg_min(power, freq) AS power FROM n WHERE freq > (h - 0.5) * 8.0 GROUP BY grp, h)
SELECT grp, c.h::BIGINT AS h, round(amplitude, 6) AS amplitude, round(i.power, 6) AS datapower FROM c LEFT JOIN i USING (grp, h)
UNION ALL SELECT grp, h, NULL, round(power, 6) FROM i WHERE h > last""",
}
