"""Operators whose inner step SQL can't say, on small tables with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwave.operators import clusters as C
from fieldwave.operators import events as V
from fieldwave.operators import harmonic_groups as H
from fieldwave.operators import spectra as S
from fieldwave.streaming import tracking as R


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_pulses_of_channels_are_grouped_around_the_highest(spark):
    data = [("a", c, t, h) for c, t, h in ((1, 1.0, 5.0), (2, 1.0001, 3.0), (2, 1.00005, 2.0), (3, 1.00015, 4.0), (1, 1.00035, 4.5), (2, 9.0, 0.01), (1, 20.0, 1.0))]
    got = C.group_across_channels(spark.createDataFrame(data, "rec string, channel int, t double, height double"), ["rec"])
    assert rows(got, "event", "channel", "t") == [(1, 1, 1.0), (1, 2, 1.0001), (1, 3, 1.00015), (2, 1, 1.00035), (3, 1, 20.0)]


def test_peak_and_trough_clusters_are_merged(spark):
    # peak cluster 0 has five events and touches trough 0 and 1, peak 1 is trough 2's, one event has a trough label only
    labels = [(0, 0), (0, 0), (0, 1), (0, 1), (0, -1), (1, 2), (1, 2), (-1, 2), (-1, 3), (-1, -1)]
    df = spark.createDataFrame([(1, k, p, t) for k, (p, t) in enumerate(labels)], "rec int, id int, peak_label long, trough_label long")
    got = {r.id: r.label for r in C.merge_peak_trough_clusters(df, ["rec"], "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 2}


def test_labels_go_on_over_blocks(spark):
    data = [(0, 0, [0.0, 0.0]), (0, 1, [1.0, 1.0]), (1, 0, [1.02, 1.0]), (1, 1, [0.03, 0.0]), (2, 0, [5.0, 5.0]), (3, 0, [0.05, 0.0]), (3, 1, [5.05, 5.0])]
    df = spark.createDataFrame([(1, *d) for d in data], "rec int, block int, label int, features array<double>")
    assert rows(R.align_block_labels(df, ["rec"]), "block", "label", "aligned") == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 2), (3, 0, 0), (3, 1, 2)]


def test_amplitudes_walk_slowly(spark):
    data = [(k, 0, 1.0 * 1.05**k if k % 2 else 10.0 / 1.05**k) for k in range(20)] + [(20, 1, 1.0), (100_000, 0, 2.5)]
    df = spark.createDataFrame([(1, *d) for d in data], "rec int, idx int, label int, height double")
    got = {i: w for i, w in rows(R.amplitude_walk(df, ["rec"]), "idx", "walk")}
    assert {got[k] for k in range(0, 20, 2)} == {0} and {got[k] for k in range(1, 20, 2)} == {1}
    assert got[20] == 2 and got[100_000] == 3  # another shape; too late for the open ones
    tie = spark.createDataFrame([(1, 0, 0, 0.0), (1, 1, 0, -1.0)], "rec int, idx int, label int, height double")
    assert len(rows(R.amplitude_walk(tie, ["rec"]), "walk")) == 2


def test_height_vectors_tell_sources(spark):
    data = [(0, 0.00, [1.0, 0.1]), (1, 0.01, [0.1, 1.0]), (2, 0.02, [1.02, 0.1]), (3, 0.021, [1.0, 0.1]), (4, 0.03, [0.1, 0.98]), (5, 0.9, [1.0, 0.1])]
    df = spark.createDataFrame([(1, *d) for d in data], "rec int, event int, t double, heights array<double>")
    assert rows(R.online_multichannel_cluster(df, ["rec"]), "event", "source") == [(0, 0), (1, 1), (2, 0), (3, 2), (4, 1), (5, 3)]  # too fast for its source; forgotten


def pulse(spark, v, dt):
    return spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v)], "id int, pos int, v double")


def test_phases_of_a_pulse(spark):
    t = np.arange(-200, 200) * 1e-5
    v = np.exp(-((t / 2e-4) ** 2)) - 0.5 * np.exp(-(((t - 7e-4) / 2e-4) ** 2))
    p1, p2 = H.pulse_phases(pulse(spark, v, 1e-5), ["id"], 1e-5).orderBy("p").collect()
    assert (p1.p, p2.p) == (1, 2) and abs(p1.amplitude - 1) < 0.01 and abs(p2.relampl + 0.5) < 0.01 and abs(p2.time - p1.time - 7e-4) < 3e-5
    assert abs(p1.width - 2 * 2e-4 * np.sqrt(np.log(2))) < 3e-5 and p1.area > 0 > p2.area and p1.time < p1.zeros < p2.time
    span = H.pulse_span(pulse(spark, v, 1e-5), ["id"], 1e-5, 0.1).first()
    assert span.tstart < p1.time and span.tend > p2.time and abs(span.pulse_width - (span.tend - span.tstart)) < 1e-12


def test_phases_of_a_wave(spark):
    t = np.arange(2000) / 10_000
    v = np.cos(2 * np.pi * 10 * (t - 0.05))
    one, two = H.wave_phases(pulse(spark, v, 1e-4), ["id"], 1e-4, 10.0).orderBy("p").collect()
    assert (one.p, two.p) == (1, 2) and one.time == 0 and abs(two.time - 0.05) < 1e-3
    assert abs(one.amplitude - 1) < 1e-3 and abs(two.amplitude + 1) < 1e-3 and abs(two.relampl - 1) < 1e-3
    assert abs(one.width - 0.05) < 1e-3 and abs(two.width - 0.05) < 1e-3 and abs(one.zeros - 0.025) < 1e-3
    still = H.wave_phases(pulse(spark, np.ones(50), 1e-4), ["id"], 1e-4, 10.0)
    assert still.count() == 0


def test_side_peaks_and_waves_are_told(spark):
    t = np.arange(-100, 100) * 1e-5
    centered, side, wave = np.exp(-((t / 1e-4) ** 2)), np.exp(-(((t - 7e-4) / 1e-4) ** 2)), np.sin(2 * np.pi * t / 3e-4)
    data = [(i, k, float(x)) for i, v in enumerate((centered, side, wave)) for k, x in enumerate(v)]
    got = {r.id: (r.side_peak, r.wave) for r in H.side_peak_or_wave(spark.createDataFrame(data, "id int, pos int, v double"), ["id"], 1e-5).collect()}
    assert got[0] == (False, False) and got[1][0] and got[2][1]


def test_chirps_are_dips_of_power_with_a_rise_above(spark):
    rng, t = np.random.default_rng(3), np.arange(400) / 100
    power = 1 + 0.01 * rng.normal(size=400)
    high = 1e-5 * (1 + 0.01 * rng.normal(size=400))
    power[198:203] *= [0.6, 0.2, 0.05, 0.2, 0.6]
    high[198:203] *= 40
    data = [(1, float(a), f, float(p)) for f, x in ((100.0, power), (150.0, high)) for a, p in zip(t, x)]
    spectra = spark.createDataFrame(data, "rec int, t double, freq double, power double")
    found = S.chirps(spectra, spark.createDataFrame([(1, 100.0)], "rec int, f double"), ["rec"])
    assert [round(r.t, 1) for r in found.collect()] == [2.0]
    assert S.chirp_rise_check(found, spectra, ["rec"]).count() == 1
    flat = spectra.withColumn("power", F.when(F.col("freq") == 150, F.lit(1e-5)).otherwise(F.col("power")))
    assert S.chirp_rise_check(found, flat, ["rec"]).count() == 0


def test_components_of_waveforms(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 12)) + 0.001 * rng.normal(size=(60, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, v array<double>")
    got = np.array([r.scores for r in S.waveform_pca(df, ["id"], 3).orderBy("id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(unit - unit.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(unit @ vt[:3].T), atol=1e-6)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearby_events_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data = [(k, float(t), float(h)) for k, (t, h) in enumerate(zip(np.sort(rng.uniform(0, 60, 80)), rng.integers(1, 6, 80)))]
    left = list(data)
    while True:
        gone = {(b if not a[2] < b[2] else a) for a, b in zip(left, left[1:]) if b[1] - a[1] < 1.0}
        if not gone:
            break
        left = [e for e in left if e not in gone]
    df = spark.createDataFrame([(1, *d) for d in data], "rec int, id int, t double, height double")
    assert rows(V.discard_nearby(df, 1.0, ["rec"]), "id") == sorted((e[0],) for e in left)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_peaks_do_not_depend_on_batches(spark, batch):
    rng = np.random.default_rng(12)
    series = {k: rng.normal(size=200).cumsum() for k in ("a", "b", "c")}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "rec string, idx int, v double").repartition(5)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, batch)
    try:
        got = rows(V.detect_peaks(df, 2.0, ["rec"]), "rec", "idx", "kind")
    finally:
        spark.conf.set(key, before)
    want = []
    for k, v in series.items():
        p, t = V.hysteresis_peaks(v, 2.0)
        want += [(k, i, "peak") for i in p] + [(k, i, "trough") for i in t]
    assert got == sorted(want) and len(got) > 20


def test_tables_without_rows(spark):
    none = spark.createDataFrame([], "rec int, id int, idx int, t double, v double, height double, label int, block int, features array<double>")
    assert V.detect_peaks(none, 1.0, ["rec"]).count() == 0
    assert V.discard_nearby(none, 1.0, ["rec"]).count() == 0
    assert R.align_block_labels(none, ["rec"]).count() == 0 and R.amplitude_walk(none, ["rec"]).count() == 0
    assert C.dbscan(none, ["rec"], "id", "features", 1.0).count() == 0 and C.mixture_1d(none, ["rec"], "id", "height", 3).count() == 0


def test_query_values_are_rounded_as_sql_rounds_doubles(spark):
    import duckdb

    from fieldwave.plans.bind import r6

    values = [24.214687499999998, 1.0000005, -1.0000005, 2.5000015, 0.1234565, 1e-7, -3e-6, 4.5e15, 1e300, 64.0314155, float("inf"), float("nan"), None]
    values += [k / 10**7 for k in range(5, 4000, 10)]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(r6("v")).collect()]
    want = [duckdb.sql("SELECT round($1::DOUBLE, 6)", params=[v]).fetchall()[0][0] for v in values]
    assert list(map(str, (x and x + 0.0 for x in got))) == list(map(str, (x and x + 0.0 for x in want)))


def test_signal_power_sums_in_order_to_the_last_bit(spark):
    """Row by row in order of time, however the rows are spread: SQL decides ties of thresholds by the last bits."""
    import math
    import random

    from fieldwave.operators import logger as L

    rng = random.Random(5)
    rows = [(c, i, rng.randrange(-300, 3000), None if rng.random() < 0.1 or 400 <= i < 420 else round(rng.expovariate(1 / 40), 2)) for c in range(4) for i in range(300)]
    rows += [(9, k, 50_000 + k, None) for k in range(3)] + [(9, 5, 90_000, 7.25)]
    got = {(r.c, r.window): (r.std, r.n) for r in L.signal_power(spark.createDataFrame(rng.sample(rows, len(rows)), "c int, id int, us long, v double").repartition(5), ["c"], "us", "v", 20, 10, ties=["id"]).collect()}
    want = {}
    for c, _, us, v in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        for window in (us // 10 - 1, us // 10):
            n, mean, squares = want.get((c, window), (0, 0.0, 0.0))
            if v is not None:
                new = mean + (v - mean) / (n + 1)
                n, mean, squares = n + 1, new, squares + (v - new) * (v - mean)
            want[c, window] = n, mean, squares
    assert got == {k: (math.sqrt(s / n) if n else None, n) for k, (n, _, s) in want.items()}
    assert got[9, 5000] == (None, 0) and got[9, 9000] == (0.0, 1)
