"""Clusters of classes of any size: grid cells against the grouped form, histograms against the values, components against union and find."""

import numpy as np
import pytest

from fieldwave.functions import kernels as K
from fieldwave.operators import clusters as C
from fieldwave.operators import density as D
from fieldwave.operators import events as V
from fieldwave.operators import frequencies as Q
from fieldwave.operators import harmonic_groups as H
from fieldwave.operators import spectra as S
from fieldwave.operators.stretches import whole_groups


def frame(spark, groups):
    rows = [(g, i, [float(x) for x in p]) for g, points in groups.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "rec string, id long, features array<double>")


def labels(df):
    return sorted((str(r.rec), r.id, r.label) for r in df.collect())


@pytest.mark.parametrize("tile, eps, share, least", [(7, 0.3, 0.05, 5), (512, 0.25, 0.0, 4), (512, 0.6, 0.1, 3)])
def test_cells_give_the_labels_of_one_group(spark, tile, eps, share, least):
    """Chains, blobs, noise, equal points, one axis and six; a key without a name; ties between clusters."""
    rng = np.random.default_rng(6)
    blob = lambda c, n, s, d=2: rng.normal(c, s, (n, d))
    groups = {
        "blobs": np.concatenate([blob(0, 60, 0.1), blob(1.2, 50, 0.15), rng.uniform(-3, 3, (60, 2))]),
        "chain": np.stack([np.linspace(0, 12, 150), np.sin(np.linspace(0, 12, 150))], 1)[rng.permutation(150)],
        None: np.zeros((40, 2)),
        "sparse": rng.uniform(0, 50, (50, 2)),
        "grid": np.array([(i * 0.25, j * 0.25) for i in range(12) for j in range(12)]),
        "few": blob(0, 3, 0.1),
    }
    df = frame(spark, groups)
    want = labels(C.dbscan(df, ["rec"], "id", "features", eps, share, least))
    assert labels(D.density_clusters(df, ["rec"], "id", "features", eps, share, least, tile=tile)) == want
    assert len({x[2] for x in want}) > 2


def test_axes_of_any_number(spark):
    rng = np.random.default_rng(9)
    for d, eps in ((1, 0.3), (4, 0.7), (6, 0.7)):
        groups = {"a": np.concatenate([rng.normal(0, 0.2, (80, d)), rng.normal(2, 0.3, (60, d)), rng.uniform(-2, 4, (40, d))])}
        df = frame(spark, groups)
        assert labels(D.density_clusters(df, ["rec"], "id", "features", eps)) == labels(C.dbscan(df, ["rec"], "id", "features", eps))


def test_a_class_of_a_hundred_thousand(spark):
    """No task holds it: cells are cut into parts, and the plan groups by no key alone."""
    rng = np.random.default_rng(1)
    disc = lambda c, n, r: c + r * rng.uniform(-1, 1, (n, 3))
    points = np.concatenate([disc(0, 60_000, 0.2), disc(5, 30_000, 0.2), rng.uniform(-40, 40, (10_000, 3))])
    near = [np.abs(points - c).max(1) for c in (0, 5)]
    points = points[(near[0] <= 0.2) | (near[1] <= 0.2) | (np.minimum(*near) > 2)]
    want = np.where(np.abs(points - 0).max(1) <= 0.2, 0, np.where(np.abs(points - 5).max(1) <= 0.2, 1, -1))
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"rec": "x", "id": np.arange(len(points)), "features": points.tolist()}), "rec string, id long, features array<double>").repartition(4)
    got = {r.id: r.label for r in C.dbscan(df, ["rec"], "id", "features", 0.8).collect()}
    assert [got[i] for i in range(len(points))] == want.tolist()
    _, tiles, cells = D.cut_into_tiles(df, ["rec"], "id", "features", 0.8 / 3**0.5, 512)
    assert cells.count() > 2 and tiles.selectExpr("max(size(xs)) m").first().m <= 512


def test_large_and_small_keys_together(spark):
    rng = np.random.default_rng(3)
    df = frame(spark, {"a": rng.normal(0, 1, (90, 2)), "b": rng.normal(0, 1, (20, 2)), None: rng.normal(0, 1, (70, 2))})
    assert labels(C.dbscan(df, ["rec"], "id", "features", 0.4, most=50)) == labels(C.dbscan(df, ["rec"], "id", "features", 0.4))


def test_rows_without_features(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, [0.0]), ("a", 3, [0.1]), ("b", 4, None)], "rec string, id long, features array<double>")
    assert labels(C.dbscan(df, ["rec"], "id", "features", 1.0, min_samples=2, most=0)) == [("a", 1, -1), ("a", 2, 0), ("a", 3, 0), ("b", 4, -1)]
    assert C.dbscan(df.limit(0), ["rec"], "id", "features", 1.0, most=0).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in D.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# ---------------------------------------------------------------- mixtures
def test_weights_count_like_rows():
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate([rng.normal(1, 0.1, 200), rng.normal(3, 0.2, 100), rng.normal(9, 0.5, 60)]), 1)
    values, count = np.unique(x, return_counts=True)
    label = K.mixture_1d(values, 3, weight=count)
    assert dict(zip(values, label)) == dict(zip(x, K.mixture_1d(x, 3)))
    merged = K.merge_neighbours(values, label, 0.5, 3, count)
    assert dict(zip(values, merged)) == dict(zip(x, K.merge_neighbours(x, K.mixture_1d(x, 3), 0.5, 3)))
    assert np.allclose(K._quantiles(values, count.astype(float), np.array([0.0, 0.1, 0.5, 0.99, 1.0])), np.quantile(x, [0.0, 0.1, 0.5, 0.99, 1.0]))


def mixture_rows(spark, groups):
    return spark.createDataFrame([(g, i, None if v is None else float(v)) for g, vs in groups.items() for i, v in enumerate(vs)], "rec string, id long, w double")


def test_mixture_on_small_groups_is_that_of_the_values(spark):
    rng = np.random.default_rng(4)
    groups = {"a": np.exp(np.concatenate([rng.normal(0, 0.1, 80), rng.normal(2, 0.1, 50)])), "b": [1.0] * 9, None: [1.0, 2.0, 50.0, 51.0, 49.0, 1.1], "c": [None, float("nan"), 2.0]}
    got = {(r.rec, r.id): r.label for r in C.mixture_1d(mixture_rows(spark, groups), ["rec"], "id", "w", 3, use_log=True, min_n=2).collect()}
    for g, v in groups.items():
        v = np.array([np.nan if x is None else x for x in v], float)
        known = np.flatnonzero(~np.isnan(v))
        want = np.full(len(v), -1)
        want[known] = K.merge_neighbours(v[known], K.mixture_1d(np.log(v[known]), 3), 0.5, 2)
        assert [got[g, i] for i in range(len(v))] == want.tolist()
    assert len(set(got.values())) > 2


def test_mixture_of_a_large_group_by_steps(spark):
    """A hundred thousand values in 64 steps: labels differ from those of the values within a step of a cut only."""
    import pandas as pd

    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(1.0, 0.1, 60_000), rng.normal(3.0, 0.2, 30_000), rng.normal(9.0, 0.4, 10_000)])
    df = spark.createDataFrame(pd.DataFrame({"rec": "x", "id": np.arange(len(v)), "w": v}))
    got = C.mixture_1d(df, ["rec"], "id", "w", 3, bins=64).toPandas().sort_values("id")["label"].to_numpy()
    want = K.merge_neighbours(v, K.mixture_1d(v, 3), 0.5)
    cuts = [v[want == k].max() for k in np.unique(want)[:-1]]
    step = (v.max() - v.min()) / 64
    wrong = v[got != want]
    assert set(want) == set(got) and len(cuts) == 1 and all(min(abs(x - c) for c in cuts) <= step for x in wrong) and len(wrong) < 0.01 * len(v)


def test_many_small_mixtures_at_a_time(spark):
    """Labels are those of a series alone, whatever it shares a step with; calls hold whole keys, and many of them."""
    rng = np.random.default_rng(12)
    parts = [rng.permutation(np.concatenate([rng.normal(0, 1, 30), rng.normal(6, 0.5, 20)])) if k % 3 else np.repeat(float(k), 1 + k % 4) for k in range(60)]
    cuts = np.append(0, np.cumsum([len(p) for p in parts]))
    weight = rng.integers(1, 4, cuts[-1])
    got = K.mixtures_1d(np.concatenate(parts), cuts, 3, weight)
    assert got.tolist() == [x for p, a in zip(parts, cuts) for x in K.mixture_1d(p, 3, weight=weight[a : a + len(p)])]
    assert K.mixtures_1d(np.zeros(0), np.zeros(1, int), 3, np.zeros(0)).tolist() == []

    import pandas as pd

    df = spark.range(30_000).selectExpr("if(id % 3000 = 0, null, id % 3000 + (1L << 60)) AS rec", "id").repartition(2)
    calls = whole_groups(df, ["rec"], ["id"], "keys long, rows long", lambda pdf, at: pd.DataFrame({"rec": pdf["rec"].iloc[:1], "keys": len(at) - 1, "rows": len(pdf)}), 2000).collect()
    assert sum(r["keys"] for r in calls) == 3000 and sum(r["rows"] for r in calls) == 30_000 and len(calls) < 30
    each = whole_groups(df, ["rec"], ["id"], "rows long", lambda pdf, at: pdf[["rec"]].iloc[at[:-1]].assign(rows=np.diff(at)), 2000).collect()
    assert {r["rec"] for r in each} == {None, *range((1 << 60) + 1, (1 << 60) + 3000)} and {r["rows"] for r in each} == {10}


@pytest.fixture
def no_group_alone(spark, monkeypatch):
    """A small key must not cost a call of its own."""

    def refused(*args, **kwargs):
        raise AssertionError("a call for each key")

    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInPandas", refused)


def test_distinct_frequencies_of_many_small_recordings(spark, no_group_alone):
    """The greedy pass, recording by recording, by plain loops."""
    rng = np.random.default_rng(5)
    rows = [(f"rec{k % 40}", int(rng.integers(0, 4)), k, float(rng.integers(0, 60)) / 4) for k in range(600)]
    df = spark.createDataFrame(rows, "recording string, element long, id long, f double")
    pairs = {}
    for r in Q.similar_frequencies(df, 0.6, ["recording"]).collect():
        pairs.setdefault(r.id, set()).add((r.element_b, r.id_b))
        pairs.setdefault(r.id_b, set()).add((r.element, r.id))
    want = []
    for rec in {r[0] for r in rows}:
        taken, unique = set(), 0
        for _, e, i, _ in sorted((r for r in rows if r[0] == rec), key=lambda r: (r[1], r[3], r[2])):
            if (e, i) not in taken:
                members = [(e, i)] + sorted(pairs.get(i, set()) - taken)
                taken.update(members)
                want += [(rec, unique, *m) for m in members]
                unique += 1
    got = Q.unique_frequencies_index(df, 0.6, ["recording"]).collect()
    assert sorted((r.recording, r.unique, r.element, r.id) for r in got) == sorted(want)


def test_two_labelings_of_many_small_series(spark, no_group_alone):
    rng = np.random.default_rng(8)
    rows = [(k % 30, k, int(rng.integers(-1, 4)), int(rng.integers(-1, 3))) for k in range(900)]
    df = spark.createDataFrame(rows, "rec long, id long, peak_label long, trough_label long")
    want = {}
    for rec in range(30):
        mine = [r[1:] for r in rows if r[0] == rec]
        left = {(s, r[s]) for r in mine for s in (1, 2) if r[s] >= 0}
        label = 0
        while left:
            best = min(left, key=lambda c: (-sum(r[c[0]] == c[1] for r in mine), c))
            for r in mine:
                if r[best[0]] == best[1]:
                    want.setdefault((rec, r[0]), label)
                    left.discard((3 - best[0], r[3 - best[0]]))
            left.discard(best)
            label += 1
    got = C.merge_peak_trough_clusters(df, ["rec"], "id").collect()
    assert {(r.rec, r.id): r.label for r in got} == want


def waves(spark, n=40, size=32):
    """Waveforms without regularity, two that are flat, some that rest at zero at times."""
    v = np.round(np.random.default_rng(4).normal(0, 2, (n, size)))
    v[3], v[4] = 0.0, 1.0
    rows = [(k, i, float(x)) for k, w in enumerate(v) for i, x in enumerate(w)]
    return v, spark.createDataFrame(rows, "id long, pos int, v double").repartition(3)


def test_wave_phases_of_many_waveforms_at_a_time(spark, no_group_alone):
    v, df = waves(spark)
    got = sorted(H.wave_phases(df, ["id"], 1 / 32, 2.0).collect())
    t, want = np.arange(32) / 32, []
    for k, x in enumerate(v):
        one = np.ptp(x[t <= 0.5])
        spots = sorted(sum(V.hysteresis_peaks(x, 0.05 * one), [])) if one > 0 else []
        half = [H._crossings(t[a : b + 1], x[a : b + 1], (x[a] + x[b]) / 2) for a, b in zip(spots, spots[1:])]
        ways = [None, *(c[len(c) // 2] if len(c) else None for c in half), None]
        near = [i for i in spots if t[i] < 0.375]
        if near:
            zero = t[max(near, key=lambda i: (x[i], -i))]
            inside = [n for n, i in enumerate(spots) if zero <= t[i] < zero + 0.5 - 1 / 64]
            less = lambda a, b: None if a is None or b is None else a - b
            want += [(k, p + 1, t[spots[n]] - zero, x[spots[n]], abs(x[spots[n]]) / max(abs(x[near])), less(ways[n + 1], ways[n]), less(ways[n + 1], zero)) for p, n in enumerate(inside)]
    assert [tuple(r) for r in got] == want and len({r.id for r in got}) > 30


def test_pulse_phases_of_many_waveforms_at_a_time(spark, no_group_alone):
    v, df = waves(spark)
    got = sorted(H.pulse_phases(df, ["id"], 1 / 32, 0.05, 0.04).collect())
    t = np.arange(32) / 32
    for k, x in enumerate(v):
        zeros = H._crossings(t, x, 0.0)
        for r in (r for r in got if r.id == k):
            i = round(r.time * 32)
            half = H._crossings(t, x * np.sign(x[i] or 1), abs(x[i]) / 2)
            last = lambda c, end: c[c < t[i]][-1] if (c < t[i]).any() else end  # noqa: B023, E731
            first = lambda c, end: c[c > t[i]][0] if (c > t[i]).any() else end  # noqa: B023, E731
            assert r.width == first(half, t[-1]) - last(half, t[0]) and r.zeros == first(zeros, None)
            assert r.amplitude == x[i] and r.area == x[(t >= last(zeros, t[0])) & (t <= first(zeros, t[-1]))].sum() / 32
    ones = [r for r in got if r.p == 1]
    assert len(ones) == 40 and all(r.amplitude == v[r.id].max() for r in ones) and len(got) > 300


def test_upsampling_holds_no_object_per_sample(spark):
    """Arrays of several lengths, empty, null and with nulls, cut into parts; columns beside stay as they are."""
    rng = np.random.default_rng(2)
    given = [None if k == 7 else [] if k == 9 else [1.0, None, 2.0, 3.0] if k == 11 else rng.normal(0, 1, k % 9).tolist() for k in range(300)]
    df = spark.createDataFrame([(None if k == 5 else (1 << 60) + k, f"n{k}", v) for k, v in enumerate(given)], "id long, name string, v array<double>").repartition(2)
    for factor in (1, 4):
        made = S.upsample(df, factor, most=50)
        assert "ArrowEvalPython" not in made._jdf.queryExecution().toString() and made.columns == df.columns
        got = {r.name: (r.id, r.v) for r in made.collect()}
        for k, v in enumerate(given):
            want = None if v is None else K.quadratic_upsample(np.array(v, float), factor).tolist()
            own = got[f"n{k}"]
            assert own[0] == (None if k == 5 else (1 << 60) + k)
            assert own[1] == (None if v is None else [None if np.isnan(x) else x for x in want])


def test_a_long_island_is_merged_in_one_pass(spark, no_group_alone):
    """Rows that all lie near the one before, of two lengths, against plain loops."""
    from fieldwave.operators import jobs as J

    rng = np.random.default_rng(3)
    forms = [(np.sin(2 * np.pi * np.arange(n) / n + p) + np.exp(-((np.arange(n) - n / 2) ** 2) / n)).tolist() for n in (48, 64) for p in (0.0, 0.7, 2.0)]
    rows = []
    for k in range(240):
        v = forms[rng.integers(0, 6)]
        rows.append((k, "pulse" if k % 2 else "wave", 100.0 + k // 8, 1e-4 * (k // 40), float(rng.integers(0, 9)), 0.0, [i / len(v) / 100 for i in range(len(v))], v))
    df = spark.createDataFrame(rows, "id long, type string, EODf double, ppdist double, ppampl double, noise double, time array<double>, v array<double>").repartition(3)
    want = []
    for kind, key in (("pulse", 3), ("wave", 2)):
        kept = None
        for r in sorted((r for r in rows if r[1] == kind), key=lambda r: (r[key], r[0])):
            own = np.array([r[6], r[7]])
            if kept is not None:
                near = r[3] - kept[0][3] <= 2e-4 if kind == "pulse" else r[2] - kept[0][2] < 10.0
                rms = K.pulse_similarity(kept[1], own, 4.0) if kind == "pulse" else K.wave_similarity(kept[1], own, kept[0][2], r[2])
            if kept is None or not near or rms >= 0.3:
                kept = r, own
                want.append([])
            want[-1].append(r[0])
    got = {}
    for r in J.merge_fish(df).collect():
        got.setdefault(r.source, []).append(r.id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and 20 < len(want) < 239
