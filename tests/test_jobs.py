"""Whole jobs on signals with known sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwave.functions.harmonics import GroupParams
from fieldwave.operators import jobs as J
from fieldwave.operators import spectra as S
from fieldwave.operators import tables as T

RATE = 20_000.0


def pulse_signal(rng, n):
    t = np.arange(n) / RATE
    x = rng.normal(0, 0.005, n)
    times = np.arange(0.004, t[-1] - 0.004, 1 / 200) + rng.normal(0, 2e-5, len(np.arange(0.004, t[-1] - 0.004, 1 / 200)))
    for a in times:
        u = (t - a) / 1.2e-4
        near = np.abs(u) < 12
        x[near] += -u[near] * np.exp(-(u[near] ** 2) / 2) * 1.5
    return x


def wave_signal(rng, n):
    t = np.arange(n) / RATE
    return sum(a * np.sin(2 * np.pi * 800 * k * t + k) for k, a in ((1, 1.0), (2, 0.5), (3, 0.3), (4, 0.1))) + rng.normal(0, 0.01, n)


@pytest.fixture(scope="module")
def recordings(spark):
    rng, n = np.random.default_rng(4), 30_000
    rows = [(name, k, k / RATE, float(v)) for name, x in (("pulse", pulse_signal(rng, n)), ("wave", wave_signal(rng, n))) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "rec string, idx int, t double, v double").repartition(4).cache()


def test_pulses_of_one_source_are_one_cluster(recordings):
    got = J.extract_pulses(recordings.where("rec = 'pulse'"), ["rec"], RATE, 0.4, left=12, right=12, min_dt=0.25).where("label >= 0").toPandas()
    assert got["label"].nunique() == 1 and len(got) > 250
    assert abs(np.median(np.diff(np.sort(got["t"]))) - 0.005) < 1e-4


def test_sources_of_a_pulse_and_of_a_wave(recordings):
    found = J.detect_sources(recordings, ["rec"], RATE, 5.0, 0.4, "wp", params=GroupParams(max_harmonics_db=0.0), window=1.0, clip=(-5.0, 5.0), pulses={"left": 12, "right": 12})
    rows = found.collect()
    pulses = [r for r in rows if r.rec == "pulse" and r.type == "pulse"]
    waves = [r for r in rows if r.rec == "wave" and r.type == "wave"]
    assert len(pulses) == 1 and abs(pulses[0].EODf - 200) < 1 and pulses[0].clipped == 0
    assert len(waves) == 1 and abs(waves[0].EODf - 800) < 2 and waves[0].skip_reason == "" and abs(waves[0].ppampl - 2.0) < 0.1
    assert min(r["index"] for r in rows if r.rec == "pulse") == 0 and pulses[0]["index"] == 0


def test_the_most_stable_stretch_is_taken(spark):
    rng = np.random.default_rng(6)
    t = np.arange(6000) / 1000
    x = np.sin(2 * np.pi * 20 * t) * np.where((t > 2) & (t < 4), 1.0, 0.2 + np.abs(np.sin(2 * np.pi * 0.9 * t))) + rng.normal(0, 0.002, len(t))
    rows = spark.createDataFrame([(1, k, k / 1000, float(v)) for k, v in enumerate(x)] + [(2, k, k / 1000, 0.0) for k in range(50)], "rec int, idx int, t double, v double")
    got = {r.rec: (r.a, r.z, r.n) for r in J.stable_window(rows, ["rec"], 1000.0, 1.0, 0.1).groupBy("rec").agg(F.min("t").alias("a"), F.max("t").alias("z"), F.count("*").alias("n")).collect()}
    assert 1.9 <= got[1][0] and got[1][1] <= 4.1 and got[1][2] == 1000
    assert got[2][2] == 50


def test_wave_rows_know_fit_and_data_power(spark):
    t = np.arange(640) / 64
    v = np.sin(2 * np.pi * 2 * t) + 0.3 * np.sin(2 * np.pi * 4 * t)
    waves = spark.createDataFrame([(1, k, float(x), 0.1) for k, x in enumerate(v)], "id int, pos int, v double, sem double")
    group = spark.createDataFrame([(1, 2.0, 10.0), (1, 4.0, 1.0)], "id int, freq double, power double")
    r = J.analyze_wave(waves, ["id"], 64.0, 2.0, 4, group=group).first()
    assert r.rmserror < 0.02 and abs(r.noise - 0.1 / r.ppampl) < 1e-9 and abs(r.datapower - 10 * np.log10(11)) < 1e-9 and r.clipped is None


def test_pulse_rows_know_start_and_end(spark):
    v = np.zeros(100)
    v[40:60] = np.hanning(20) * 2
    waves = spark.createDataFrame([(1, k - 50, float(x)) for k, x in enumerate(v)], "id int, pos int, v double")
    events = spark.createDataFrame([(1, k * 0.1) for k in range(20)], "id int, t double")
    r = J.analyze_pulse(waves, events, ["id"], 1000.0).first()
    assert r.tstart < 0 < r.tend and 0.012 < r.pulse_width < 0.02 and abs(r.EODf - 10) < 1e-6 and r.clipped is None


def test_unstable_waveforms_are_skipped(spark):
    rng = np.random.default_rng(8)
    t = np.arange(4000) / 1000
    rows = spark.createDataFrame([(1, 20.0, np.sin(2 * np.pi * 20 * t).tolist()), (2, 20.0, rng.normal(size=4000).tolist())], "id int, freq double, v array<double>")
    got = {r.id: r for r in J.extract_wave(rows, ["id"], 1000.0, "freq", 1.0).collect()}
    assert got[1].skip_reason == "" and abs(got[1].EODf - 20) < 0.3 and got[2].skip_reason == "waveforms not stable"


@pytest.mark.parametrize("block", [2, 1000])
def test_templates_in_blocks_give_the_nearest(spark, block):
    s = np.arange(-20, 20) / 1000
    shapes = {f"s{k}": np.exp(-((s / (0.002 * (k + 1))) ** 2)) * np.cos(s * 150 * k) for k in range(6)}  # s0 has one lobe only
    templates = spark.createDataFrame([(n, s.tolist(), v.tolist()) for n, v in shapes.items()], "species string, ttime array<double>, tv array<double>")
    fish = spark.createDataFrame([(n, s.tolist(), (-3 * v).tolist()) for n, v in shapes.items()] + [("none", s.tolist(), np.sin(s * 900).tolist())], "name string, time array<double>, v array<double>")
    got = {r.name: (r.species, r.rms) for r in S.assign_species(fish, templates, 0.05, block=block).collect()}
    assert all(got[n][0] == n for n in shapes) and got["none"][0] == "unknown" and got["none"][1] > 0.05
    none = S.assign_species(fish, templates.limit(0), 0.05).first()
    assert none.species == "unknown" and none.rms is None


def test_quartiles_are_exact(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.exponential(1, 500), np.full(300, 0.5), [1e6]])
    df = spark.createDataFrame([(float(v), 7, None) for v in x], "a double, b int, c double").repartition(5)
    got = {r.column: r for r in T.table_statistics(df, ["a", "b", "c"], nbins=16).collect()}
    assert np.allclose([got["a"].q1, got["a"].median, got["a"].q3], np.quantile(x, [0.25, 0.5, 0.75]))
    assert (got["b"].q1, got["b"].median, got["b"].q3, got["b"].n) == (7, 7, 7, len(x))
    assert got["c"].n == 0 and got["c"].median is None


def test_merged_sources_do_not_depend_on_where_stretches_end(spark):
    shape = np.sin(2 * np.pi * np.arange(64) / 64).tolist()
    freqs = [490.0, 499.0, 501.0, 520.0, 1000.5, 1001.0, 1499.9, 1500.1, 2100.0]
    rows = [(k, "wave", f, 0.0, float(k), 0.0, (np.arange(64) / 64 / f).tolist(), shape) for k, f in enumerate(freqs)]
    df = spark.createDataFrame(rows, "id int, type string, EODf double, ppdist double, ppampl double, noise double, time array<double>, v array<double>")
    got = J.merge_fish(df).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.source, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2], [3], [4, 5], [6, 7], [8]]  # each against the last that was kept
    assert sum(r.representative for r in got) == len(groups)


def test_pulse_jobs_send_no_table_through_the_driver(spark, sf_dir, monkeypatch):
    """Their steps are small as files and many as rows: every join is by shuffle, and the session's own settings come back."""
    from fieldwave import plans
    from fieldwave.operators import jobs

    made, write = [], jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, name: made.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    out = plans.queries()["c3_extract_pulses"](spark, sf_dir)
    made.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in made) and not any("BroadcastHashJoin" in p for p in made)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_pulse_jobs_call_python_for_many_classes_at_a_time(spark, sf_dir, monkeypatch):
    """Classes of pulses are small and many: no step has a call for each of them, and none makes a row for each sample of a snippet."""
    from fieldwave import plans
    from fieldwave.operators import jobs

    made, write = [], jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, name: made.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    plans.queries()["c3_extract_pulses"](spark, sf_dir)
    assert not [name for name, p in made if "FlatMapGroupsInPandas" in p]
    assert any("MapInArrow" in p for name, p in made if name == "pieces")


def test_snippets_as_arrays(spark):
    """They are the rows of snippets put together, also where samples are missing and blocks meet."""
    from fieldwave.operators import events as V

    rng = np.random.default_rng(3)
    samples = [(rec, int(k), float(rng.normal())) for rec, n in (("a", 300), ("b", 90), (None, 40)) for k in np.flatnonzero(rng.random(n) < 0.8)]
    events = [(rec, int(k)) for rec, n in (("a", 300), ("b", 90), ("c", 9)) for k in rng.choice(n, min(n, 60))]
    samples, events = spark.createDataFrame(samples, "rec string, idx long, v double").repartition(3), spark.createDataFrame(events, "rec string, idx long")
    want = {}
    for r in V.snippets(samples, events.distinct(), ["rec"], 5, 7).collect():
        want.setdefault((r.rec, r.event), []).append((r.pos, r.v))
    for block in (16, 1 << 14):
        got = {(r.rec, r.event): list(zip(r.pos, r.v)) for r in V.snippet_arrays(samples, events, ["rec"], 5, 7, block=block).collect()}
        assert got == {k: sorted(v) for k, v in want.items()} and len(got) > 50


def test_shape_clusters_of_large_classes_are_those_of_small_ones(spark):
    rng = np.random.default_rng(8)
    rows = [(rec, i, i / 7, (np.sin(np.linspace(0, 6, 20) * (1 + i % 2)) + rng.normal(0, 0.02, 20)).tolist()) for rec in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "rec string, id long, t double, v array<double>")
    found = []
    for most in (2048, 30):
        out = J.clusters_and_means(df, ["rec"], "id", 0.5, carry=["t"], most=most).collect()
        found.append(({(r.rec, r.id): (r.label, r.t) for r in out if r.mean is None}, {(r.rec, r.label): np.round(r.mean, 9).tolist() for r in out if r.mean is not None}))
    assert found[0] == found[1] and len(found[0][0]) == 80 and len(found[0][1]) == 4
    assert all(found[0][0]["a", i] == (i % 2, i / 7) for i in range(40))


def test_moving_sources_like_a_loop_over_windows(spark):
    """Whatever the windows, also with equal heights: fewest clusters, fewest sparse ones, highest mean height, the first of equals."""
    from fieldwave.operators import clusters as C

    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(3)) if t < 9 else 5, float(t), 1e-4, float(rng.choice([1.0, 2.0, 0.1]))) for k in range(6) for t in np.sort(rng.uniform(0, 12, 60))]
    got = {}
    out = C.moving_sources(spark.createDataFrame(rows, "k int, label int, t double, width double, height double"), ["k"], 0.5, 0.1)
    assert "explode(sequence" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        got.setdefault(r.k, set()).add(r.label)
    for k in range(6):
        own = [r for r in rows if r[0] == k]
        dt, t0, windows = max(0.5, 2000 * 1e-4), own[0][2], {}
        for _, label, t, _, h in own:
            first = max(0, int(np.ceil((t - t0 - dt) / 0.1 + 1e-9)))
            for w in range(first, max(first, int(np.floor((t - t0) / 0.1))) + 1):
                windows.setdefault(w, []).append((label, h))
        rank = lambda w: (len({x for x, _ in windows[w]}), sum(sum(y == x for y, _ in windows[w]) < 2 for x in {x for x, _ in windows[w]}), -round(sum(h for _, h in windows[w]) / len(windows[w]), 12), w)
        assert got[k] == {x for x, _ in windows[min(windows, key=rank)]}


def test_a_step_leaves_no_shuffle_files(spark):
    """Steps of long jobs end with a table in the shared folder; what they have shuffled goes at once."""
    import time

    from fieldwave.sources.shared import joins_by_shuffle, written

    names = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    before, key = names(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(key, None)
    with joins_by_shuffle(spark):
        rows = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")), "test")
        until = time.time() + 20
        while names() - before and time.time() < until:
            time.sleep(0.2)
        assert not names() - before and rows.count() == 7
    assert spark.conf.get(key, None) == own


def _files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(k) for k in range(found.size())]


def test_window_criteria_deal_out_pairs_not_windows(spark):
    from fieldwave.operators import windows as N

    rng = np.random.default_rng(12)
    t = np.sort(rng.uniform(0, 30, 400))
    rows = [(k, float(a), float(rng.uniform(1, 2)), float(a + 0.01), float(rng.uniform(-2, -1))) for k in range(3) for a in t]
    pairs = spark.createDataFrame(rows, "k int, peak_t double, peak_v double, trough_t double, trough_v double").repartition(3)
    tables = []
    for part in (64, 7, 1000):
        made = N.window_criteria(pairs, ["k"], 0.0, 30.0, 5.0, 0.2, -1.9, 1.9, part=part)
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert [x.strip(" +-:").split()[0] for x in plan if "explode(sequence" in x or "RepartitionByExpression" in x] == ["Generate", "RepartitionByExpression", "Generate"] * 3  # rows per window are made where pairs were dealt to
        tables.append(sorted(tuple(np.round(list(r), 9)) for r in made.collect()))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 3 * 251
