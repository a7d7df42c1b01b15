"""Numpy helpers on signals with known truth."""

import numpy as np
import pytest

from fieldwave.functions import kernels as K
from fieldwave.functions.harmonics import GroupParams, harmonic_groups
from fieldwave.operators.events import hysteresis_peaks
from fieldwave.streaming.tracking import track


def wave(freq, amplitudes, rate, seconds, rng=None, noise=0.0):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(a * np.sin(2 * np.pi * (k + 1) * freq * t + k) for k, a in enumerate(amplitudes))
    return x + (rng.normal(0, noise, len(t)) if noise else 0)


def test_peaks_alternate_and_pass_the_threshold():
    x = np.array([0, 3, 2.5, 3.5, 0, 0.4, -1, 2, 2, -2, 5.0])
    peaks, troughs = hysteresis_peaks(x, 1.0)
    assert peaks == [3, 7] and troughs == [0, 6, 9]
    assert hysteresis_peaks(np.zeros(5), 0.1) == ([], []) and hysteresis_peaks(np.zeros(0), 0.1) == ([], [])


def test_power_density_integrates_to_variance():
    x = np.random.default_rng(0).normal(0, 2, 60_000)
    f, p = K.psd(x, 1000.0, 1024)
    assert abs(p.sum() * (f[1] - f[0]) - 4) < 0.2


def test_energy_integral():
    rate = 10_000.0
    t = np.arange(-200, 200) / rate
    v = np.exp(-((t / 1e-3) ** 2))
    f, e = K.energy_spectrum(v, rate)
    assert abs(e.sum() * (f[1] - f[0]) - (v**2).sum() / rate) < 1e-3 * (v**2).sum() / rate


def test_high_pass_matches_the_recurrence():
    rng = np.random.default_rng(2)
    x = rng.normal(size=3000).cumsum()
    k = np.tan(np.pi * 10 / 1000)
    want = np.zeros(len(x))
    for i in range(1, len(x)):
        want[i] = (x[i] - x[i - 1]) / (1 + k) - (k - 1) / (k + 1) * want[i - 1]
    assert np.allclose(K.high_pass(x, 1000.0, 10.0), want)


def test_upsampling_is_exact_on_parabolas():
    x = np.arange(20.0) ** 2
    assert np.allclose(K.quadratic_upsample(x, 5), (np.arange(96) / 5) ** 2)


def test_four_waves_are_told_apart():
    rng, rate = np.random.default_rng(1), 44_100.0
    x = wave(123, [1, 0.5, 0.2, 0.1, 0.05], rate, 8, rng, 0.01) + wave(321, [1, 0.4, 0.3, 0.1], rate, 8) + wave(666, [0.8, 0.3, 0.2], rate, 8) + wave(668, [0.6, 0.3, 0.1], rate, 8)
    f, p = K.psd(x, rate, K.nfft_for(rate, 0.5))
    db = 10 * np.log10(p)
    peaks, _ = hysteresis_peaks(db, 10.0)
    peaks = np.array([k for k in peaks if db[k] > np.median(db) + 18])
    strong = db[peaks] > np.median(db) + 20
    groups = harmonic_groups(f[peaks], p[peaks], strong, f[1], GroupParams(max_harmonics_db=0.0))
    found = np.array([g[0, 1] for g in groups])
    for want in (123, 321, 666, 668):  # fixed values of the known mixture
        assert np.abs(found - want).min() < 0.75


@pytest.mark.parametrize("seed", range(8))
def test_groups_of_made_up_peaks(seed):
    rng = np.random.default_rng(seed)
    zeros = np.array([97.3, 251.9, 443.7]) + rng.uniform(-8, 8, 3)
    rows = [(z * h + rng.uniform(-0.1, 0.1) * h, 10 ** (4 - k - 0.6 * h)) for k, z in enumerate(zeros) for h in range(1, 7)]
    noise = [(f, 1e-5) for f in rng.uniform(30, 2500, 12)]
    f, p = map(np.array, zip(*rows, *noise))
    strong = p > 1e-2
    groups = harmonic_groups(f, p, strong, 0.5, GroupParams(mains=0.0, max_harmonics_db=0.0, max_db_diff=0.0))
    assert [g[0, 1] for g in groups] == sorted(g[0, 1] for g in groups)
    for z in zeros:
        g = min(groups, key=lambda g: abs(g[0, 1] - z))
        assert abs(g[0, 1] - z) < 0.6 and len(g) >= 3
    for g in groups:  # every row is a harmonic of its fundamental, within the widest tolerance
        assert g[0, 0] == 1 and (np.abs(g[:, 1] / g[:, 0] - g[0, 1]) <= 1.1).all() and (np.diff(g[:, 0]) > 0).all()
    assert len(harmonic_groups(f, p, strong, 0.5, GroupParams(mains=0.0, max_harmonics_db=0.0, max_db_diff=0.0, max_groups=1))) == 1


def test_groups_without_fundamental_on_the_mains_or_asked_for():
    h = np.arange(2, 7)
    quiet = GroupParams(max_harmonics_db=0.0)
    (g,) = harmonic_groups(150.0 * h, np.where(h == 4, 1.0, 0.1), np.ones(5, bool), 0.5, GroupParams(mains=0.0, max_harmonics_db=0.0))
    assert g[0].tolist() == [1, 150.0, 0.1] and g[1:, 0].tolist() == [2, 3, 4, 5, 6]
    mains = np.array([60.0, 120.0, 180.0, 240.0])
    assert harmonic_groups(mains, np.array([8, 4, 2, 1.0]), np.ones(4, bool), 0.5, quiet) == []
    f = 100.0 * np.arange(1, 9)
    asked = harmonic_groups(f, 0.5 ** np.arange(8), np.ones(8, bool), 0.5, GroupParams(mains=0.0, max_harmonics_db=0.0), check=[200.0])
    assert 200.0 in [g[0, 1] for g in asked]
    assert [g[0, 1] for g in harmonic_groups(f, 0.5 ** np.arange(8), np.ones(8, bool), 0.5, GroupParams(mains=0.0, max_harmonics_db=0.0))] == [100.0]
    assert harmonic_groups(np.zeros(0), np.zeros(0), np.zeros(0, bool), 0.5) == []


def test_similarity_ignores_sign_and_scale():
    t = np.arange(400) / 400
    a = np.array([t, np.sin(2 * np.pi * t) + 0.4 * np.sin(4 * np.pi * t)])
    assert K.wave_similarity(a, np.array([t, 3 * a[1]]), 1.0, 1.0) < 0.05
    assert K.wave_similarity(a, np.array([t, np.sin(6 * np.pi * t)]), 1.0, 1.0) > 0.5
    s = np.arange(-200, 200) / 1e5
    b = np.array([s, np.exp(-((s / 2e-4) ** 2))])
    assert K.pulse_similarity(b, np.array([s, -5 * b[1]])) < 1e-6
    assert K.pulse_similarity(b, np.array([s, b[1] * np.cos(s * 2e4)])) > 0.1


def test_density_clusters():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.05, (40, 3)), rng.normal(2, 0.05, (30, 3)), [[9, 9, 9]]])
    label = K.dbscan(x, 0.4, 5)
    assert label[:40].tolist() == [0] * 40 and label[40:70].tolist() == [1] * 30 and label[70] == -1
    assert K.dbscan(np.zeros((0, 2)), 1.0, 3).tolist() == []


def test_mixture_on_a_line():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 0.05, 50), rng.normal(4, 0.1, 50), rng.normal(9, 0.2, 50)])
    label = K.merge_neighbours(x, K.mixture_1d(x, 3), 0.2)
    assert [len(set(label[i : i + 50])) for i in (0, 50, 100)] == [1, 1, 1] and len(set(label)) == 3
    assert K.mixture_1d(np.ones(5), 3).tolist() == [0] * 5


def test_tail_time_constant():
    t = np.arange(400) * 1e-5
    v = np.where(t < 5e-4, -np.sin(t * 2e3), -0.85 * np.exp(-(t - 5e-4) / 3e-4))
    tau, start = K.tail_time_constant(t, v, 50, 1e-4)
    assert abs(tau - 3e-4) < 3e-5 and start >= 5e-4
    assert K.tail_time_constant(t, np.ones(400), 50, 1e-4) is None


@pytest.mark.parametrize("gap,sources", [(10.0, 1), (400.0, 2)])
def test_tracking_by_time(gap, sources):
    rows = [(0.0, 5.0, "wave", 100.0, 0.0, 1.0), (5.0 + gap, 10.0 + gap, "wave", 100.4, 0.0, 2.0)]
    assert len({s for s, _ in track(rows, [])}) == sources


def test_tracking_follows_the_largest_detection():
    rows = [(0, 1, "wave", 100.0, 0.0, 5.0), (2, 3, "wave", 100.8, 0.0, 1.0), (4, 5, "wave", 101.5, 0.0, 1.0), (4, 5, "pulse", 100.0, 1e-4, 1.0)]
    assert [s for s, _ in track(rows, [])] == [0, 0, 1, 2]
