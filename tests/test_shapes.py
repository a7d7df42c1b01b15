"""Alignment, components and spectra in stacks, against plain numpy."""

import numpy as np

from fieldwave.functions import kernels as K
from fieldwave.operators import jobs as J
from fieldwave.operators import spectra as S


def arrays_of(spark, rows, schema="rec string, id long, v array<double>"):
    return spark.createDataFrame([(*r[:-1], [float(x) for x in r[-1]]) for r in rows], schema)


def pulse(at, n=64, width=3.0):
    t = (np.arange(n) - at) / width
    return np.exp(-(t**2)) - 0.6 * np.exp(-((t - 2) ** 2))


def test_shifted_copies_of_a_pulse_get_equal_features(spark):
    rng = np.random.default_rng(3)
    at = 30 + rng.integers(-5, 6, 40)
    rows = [("a", i, pulse(x)) for i, x in enumerate(at)] + [("b", 100 + i, 2 * pulse(x, width=5.0)) for i, x in enumerate(28 + rng.integers(-3, 4, 20))] + [("c", 500, np.zeros(64))]
    df = arrays_of(spark, rows)
    for by in (["rec"], []):
        plain = {r.id: r.features for r in S.poly_features(df, ["rec", "id"]).collect()}
        assert np.ptp([plain[i] for i in range(40)], axis=0).max() > 0.1
        got = {r.id: np.array(r.features) for r in S.poly_features(df, ["rec", "id"], align=by).collect()}
        assert np.allclose([got[i] for i in range(40)], got[0], atol=1e-6) and np.allclose([got[100 + i] for i in range(20)], got[100], atol=1e-6)
    assert set(got) == {r[1] for r in rows}


def test_lags_and_moves():
    rng = np.random.default_rng(1)
    rows, mean = rng.normal(size=(30, 50)), rng.normal(size=50)
    full = [[sum(r[n] * mean[n + d] for n in range(50) if 0 <= n + d < 50) for d in range(-6, 7)] for r in rows]
    assert K.lags_to(rows, mean, 6).tolist() == [int(np.argmax(c)) - 6 for c in full]
    assert K.lags_to(np.zeros((2, 50)), mean, 6).tolist() == [0, 0]
    assert K.moved(np.array([[1.0, 2, 3, 4]] * 3), np.array([1, 0, -2])).tolist() == [[1, 1, 2, 3], [1, 2, 3, 4], [3, 4, 4, 4]]


def test_scores_of_classes_are_those_of_each_class_alone(spark):
    """From one pass of sums, batch by batch; fewer rows than components, equal rows, one class without others."""
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=(70, 8)) * np.arange(8, 0, -1), "b": rng.normal(size=(3, 8)), "c": np.ones((4, 8)), "d": rng.normal(size=(1, 8))}
    df = arrays_of(spark, [(g, i, v) for g, x in groups.items() for i, v in enumerate(x)]).repartition(5)
    got = {(r.rec, r.id): r.scores for r in S.principal_scores(df, ["rec"], "id", 4).collect()}
    for g, x in groups.items():
        mine = np.array([got[g, i] for i in range(len(x))])
        assert np.allclose(mine, K.principal_components(x, 4), atol=1e-8)
    one = {r.id: r.scores for r in S.principal_scores(df.where("rec = 'a'").drop("rec"), [], "id", 4).collect()}
    assert all(np.allclose(one[i], got["a", i]) for i in range(70))


def test_property_components_with_missing_cells(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.1]]) + 10
    holes = rng.random(x.shape) < 0.2
    rows = [(i, *(None if h else float(v) for v, h in zip(r, m))) for i, (r, m) in enumerate(zip(x, holes))] + [(200, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    y = np.vstack([np.where(holes, np.nan, x), [np.nan] * 3])
    mean = np.nanmean(y, axis=0)
    cov = np.empty((3, 3))
    for i in range(3):
        for j in range(3):
            both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
            cov[i, j] = np.cov(y[both, i], y[both, j])[0, 1]
    for scaled in (False, True):
        unit = np.sqrt(np.diag(cov)) if scaled else np.ones(3)
        values, vectors = np.linalg.eigh(cov / np.outer(unit, unit))
        want = np.abs(np.nan_to_num((y - mean) / unit) @ vectors[:, np.argsort(-values)[:2]])
        got = {r.id: np.abs(r.scores) for r in S.property_pca(df, ["id"], ["a", "b", "c"], 2, scaled=scaled).collect()}
        assert np.allclose([got[i] for i in range(201)], want)
    assert S.property_pca(df.limit(0), ["id"], ["a", "b"], 2).collect() == []
    assert [list(r.scores) for r in S.property_pca(df.where("id = 5"), ["id"], ["a", "b"], 2).collect()] == [[0.0, 0.0]]


def test_spectra_of_arrays_of_several_lengths(spark):
    rng = np.random.default_rng(6)
    vs = [rng.normal(size=n) for n in (100, 40, 100, 7, 64, 40)]
    df = arrays_of(spark, [("r", i, v) for i, v in enumerate(vs)])
    got = S.psd(df, ["id"], 100.0, 4.0).toPandas()
    found = S.spectrogram(df, ["id"], 100.0, 4.0).toPandas()
    energy = S.pulse_spectrum(df, ["id"], 100.0, 4.0).toPandas()
    for i, v in enumerate(vs):
        f, p = K.psd(v, 100.0, 32)
        mine = got[got["id"] == i].sort_values("freq")
        assert np.allclose(mine["freq"], f) and np.allclose(mine["power"], p)
        starts, q = K.spectrogram(v, 100.0, 32)
        mine = found[found["id"] == i].sort_values(["win", "freq"])
        assert len(mine) == q.size and np.allclose(mine["power"], q.ravel())
        f, e = K.energy_spectrum(v, 100.0, 4.0, 0.05)
        assert np.allclose(energy[energy["id"] == i].sort_values("freq")["energy"], e)


def test_spectrum_of_a_train(spark):
    """Gaps of many segments count as zero; a series ends with its last pulse or where it is said to."""
    rng = np.random.default_rng(4)
    at = np.unique(np.concatenate([rng.integers(10, 400, 30), [2000]]))
    wave = rng.normal(size=9)
    events = spark.createDataFrame([("r", int(i)) for i in at], "rec string, idx long")
    waves = spark.createDataFrame([("r", k - 4, float(v)) for k, v in enumerate(wave)], "rec string, pos long, v double")
    train = {r.idx: r.v for r in S.pulse_train(events, waves, ["rec"]).collect()}
    for n in (None, 1500, 40):
        size = None if n is None else spark.createDataFrame([("r", n)], "rec string, n long")
        x = np.array([train.get(i, 0.0) for i in range(n or max(train) + 1)])
        f, p = K.psd(x, 64.0, 64)
        got = S.pulse_train_spectrum(events, waves, ["rec"], 64.0, 1.0, size).toPandas().sort_values("freq")
        assert np.allclose(got["freq"], f) and np.allclose(got["power"], p)


def test_templates_in_blocks(spark):
    """One block after the other gives what all templates at once give, and plain loops over all pairs."""
    rng = np.random.default_rng(8)
    t = np.linspace(-1, 1, 60)
    shape = lambda w, s: (np.exp(-((t / w) ** 2)) - s * np.exp(-(((t - w) / w) ** 2))).tolist()
    fish = spark.createDataFrame([(i, t.tolist(), shape(0.05 + 0.02 * (i % 9), 0.1 * (i % 5))) for i in range(40)], "id long, time array<double>, v array<double>")
    kinds = [(f"k{i % 11}", t.tolist(), shape(0.05 + 0.013 * i, 0.07 * i % 0.6)) for i in range(12)]
    templates = spark.createDataFrame(kinds, "species string, ttime array<double>, tv array<double>")
    want = {r.id: min((K.pulse_similarity(np.array([r.time, r.v]), np.array(w[1:], float)), w[0]) for w in kinds) for r in fish.collect()}
    for block in (5000, 3):
        got = {r.id: (r.rms, r.species) for r in S.assign_species(fish, templates, 10.0, block=block).collect()}
        assert got == want
    assert {r.species for r in S.assign_species(fish, templates.limit(0), 1.0).collect()} == {"unknown"}
    assert len({s for _, s in want.values()}) > 3


def test_shape_clusters_of_a_class(spark):
    rng = np.random.default_rng(5)
    rows = [("a", i, (pulse(20, 40) if i % 3 else pulse(20, 40, 6.0)) + rng.normal(0, 0.01, 40)) for i in range(60)]
    df = arrays_of(spark, rows)
    got = {r.id: r.label for r in J.shape_clusters(df, ["rec"], "id", 0.5).collect()}
    assert {got[i] for i in range(60) if i % 3} == {1} and {got[i] for i in range(0, 60, 3)} == {0}
