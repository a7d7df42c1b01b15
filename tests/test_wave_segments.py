"""Waveforms from segments: recordings that are cut give what whole series give."""

import numpy as np

from fieldwave.operators import jobs as J
from fieldwave.operators import wave_segments as G


def test_a_known_wave():
    rate, rng = 44_100.0, np.random.default_rng(1)
    t = np.arange(int(4 * rate)) / rate
    x = sum(a * np.sin(2 * np.pi * 800 * k * t + p) for k, a, p in ((1, 1.0, 0.3), (2, 0.5, 1.0), (3, 0.2, 2.0))) + rng.normal(0, 0.01, len(t))
    f, n, c, why = G.extract(x, rate, 799.8, 0.5, 0.99, 5)
    assert why == "" and abs(f - 800) < 0.3 and n > 2000
    assert np.allclose(np.abs(c[1:4]), [1.0, 0.5, 0.2], atol=0.02) and abs(np.angle(c[1])) < 1e-9


def test_one_segment_and_none():
    t = np.arange(60) / 1000
    f, n, c, why = G.extract(np.sin(2 * np.pi * 50 * t)[:7], 1000.0, 50.0, 0.5, 0.99, 3)
    assert why == G.TOO_SHORT and f is None and c is None
    one = [(50.0, np.array([0, 1.0, 0.2], complex))]
    assert G.choose(50.0, np.array([0]), 60, 1000.0, one, 0.99)[::3] == (50.0, "") and G.choose(50.0, np.array([0]), 60, 1000.0, [], 0.99)[3] == G.TOO_SHORT


def test_plans_halve_until_there_are_enough():
    for n in (9, 30, 100, 5000, 44_100):
        size, starts = G.plan(n, 1000.0, 100.0, 0.5)
        assert (len(starts) >= 6 or size <= 8) and (np.diff(starts) == size // 4).all() and starts[-1] <= max(0, n - size)
    assert G.plan(10_000, 1000.0, 900.0, 0.5)[0] == 1000  # high frequencies: shorter segments


def test_clusters_of_segments():
    """The limits: strictly beyond the upper median, more than half the largest count rounded down."""
    corr = np.full((6, 6), 0.2)
    for a, b, r in ((0, 1, 0.999), (0, 2, 0.998), (1, 2, 0.9985), (0, 3, 0.9981), (1, 3, 0.997), (2, 3, 0.9975), (4, 5, 0.9999)):
        corr[a, b] = corr[b, a] = r
    level = np.sort([0.999, 0.998, 0.9985, 0.9981, 0.997, 0.9975, 0.9999] * 2)[7]
    count = (corr > level).sum(1)
    assert level == 0.9981 and count.tolist() == [1, 2, 1, 0, 1, 1]
    assert sorted(G.stable(corr, 0.99)) == [0, 1]  # of the pairs, only one has a common member: segment 1, which brings its best
    assert G.stable(np.full((4, 4), 0.5), 0.99) == [] and G.stable(np.eye(3), 0.99) == []
    assert sorted(G.stable(np.full((5, 5), 0.999), 0.99)) == [0, 1, 2, 3, 4]  # all alike


def test_cut_recordings_give_what_whole_series_give(spark):
    """Sources of several frequencies in one recording, another that begins late, one too short, noise; samples cross chunks."""
    rate, rng = 2000.0, np.random.default_rng(4)
    t = np.arange(21_000) / rate
    two = np.sin(2 * np.pi * 97.3 * t) + 0.4 * np.sin(2 * np.pi * 194.6 * t) + 0.7 * np.sin(2 * np.pi * 410 * t + 1) + rng.normal(0, 0.01, len(t))
    series = {"two": (0, two), "late": (5000, np.sin(2 * np.pi * 60 * t[:7000])), "short": (0, np.ones(3)), "noise": (0, rng.normal(size=6000))}
    waves = [("two", 0, 97.0), ("two", 1, 410.5), ("late", 0, 60.0), ("short", 0, 50.0), ("noise", 0, 120.0)]
    samples = spark.createDataFrame([(k, a + i, float(v)) for k, (a, x) in series.items() for i, v in enumerate(x)], "rec string, idx long, v double").repartition(4)
    got = {(r.rec, r.grp): r for r in G.extract_waves(samples, spark.createDataFrame(waves, "rec string, grp int, freq double"), ["rec"], rate, 0.5, 0.99).collect()}
    assert len(got) == len(waves)
    for rec, grp, f in waves:
        eodf, n, c, why = G.extract(series[rec][1], rate, f, 0.5, 0.99, 5)
        r = got[rec, grp]
        assert (r.skip_reason, r.n) == (why, n) and (r.EODf is None) == (eodf is None)
        if c is not None:
            assert abs(r.EODf - eodf) < 1e-9 and np.allclose([x.re + 1j * x.im for x in r.coeffs], c)
    assert got["two", 0].skip_reason == "" and abs(got["two", 0].EODf - 97.3) < 0.3 and abs(got["two", 1].EODf - 410) < 0.5
    assert got["short", 0].skip_reason == G.TOO_SHORT and got["noise", 0].skip_reason == G.UNSTABLE
    plan = G.extract_waves(samples, spark.createDataFrame(waves, "rec string, grp int, freq double"), ["rec"], rate)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk" in plan
    assert J.extract_wave(spark.createDataFrame([(1, 60.0, np.sin(2 * np.pi * 60 * t[:4000]).tolist())], "id int, freq double, v array<double>"), ["id"], rate, "freq").first().skip_reason == ""
