"""Small numpy helpers that run inside tasks, on one series, spectrum or waveform at a time."""

from __future__ import annotations

import numpy as np


# ---------------------------------------------------------------- spectra
def next_power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(n, 1)))))


def nfft_for(rate: float, resolution: float) -> int:
    """The power of two that reaches the frequency resolution."""
    return next_power_of_two(rate / resolution)


def psd(x: np.ndarray, rate: float, nfft: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density, Hann windows, mean over segments; shorter series are one padded segment."""
    segments = spectrogram(x, rate, nfft, overlap)[1]
    return np.fft.rfftfreq(nfft, 1 / rate), segments.mean(axis=-2)


def spectrogram(x: np.ndarray, rate: float, nfft: int, overlap: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(start samples, power[..., segment, frequency]); ``x`` is one series, or a series per row."""
    x = np.asarray(x, float)
    if x.shape[-1] < nfft:
        x = np.concatenate([x, np.zeros((*x.shape[:-1], nfft - x.shape[-1]))], axis=-1)
    step = max(1, int(nfft * (1 - overlap)))
    starts = np.arange(0, x.shape[-1] - nfft + 1, step)
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(nfft) / nfft))
    parts = np.lib.stride_tricks.sliding_window_view(x, nfft, axis=-1)[..., starts, :]
    parts = (parts - parts.mean(axis=-1, keepdims=True)) * w
    power = np.abs(np.fft.rfft(parts, axis=-1)) ** 2 / (rate * (w**2).sum())
    power[..., 1 : (nfft + 1) // 2] *= 2
    return starts, power


def energy_spectrum(v: np.ndarray, rate: float, resolution: float = 1.0, fade: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One-sided energy spectrum of a pulse, or of one per row, end means removed, centered in zeros; its sum times df is the pulse's energy."""
    v = np.asarray(v, float)
    size = v.shape[-1]
    n = max(1, size // 20)
    v = v - (v[..., :n].mean(-1, keepdims=True) + v[..., -n:].mean(-1, keepdims=True)) / 2
    m = int(size * fade)
    if m > 0:
        ramp = np.arange(m) / m
        v[..., :m] *= ramp
        v[..., -m:] *= ramp[::-1]
    nfft = max(nfft_for(rate, resolution), next_power_of_two(size))
    padded = np.zeros((*v.shape[:-1], nfft))
    at = (nfft - size) // 2
    padded[..., at : at + size] = v
    energy = 2 * np.abs(np.fft.rfft(padded, axis=-1) / rate) ** 2
    energy[..., 0] /= 2
    energy[..., -1] /= 2
    return np.fft.rfftfreq(nfft, 1 / rate), energy


def high_pass(x: np.ndarray, rate: float, cutoff: float) -> np.ndarray:
    """First-order Butterworth high-pass (bilinear), starting at rest at the first value."""
    k = np.tan(np.pi * cutoff / rate)
    b, a = 1 / (1 + k), (k - 1) / (k + 1)
    d = np.diff(np.asarray(x, float), prepend=x[:1]) * b
    # y[i] = d[i] - a y[i-1], in blocks so that powers of a stay in range
    out, last, block = np.empty(len(d)), 0.0, max(1, int(min(256, 30 / max(-np.log(abs(a)), 1e-9)))) if a else 256
    powers = (-a) ** np.arange(block + 1)
    for i in range(0, len(d), block):
        part = d[i : i + block]
        n = len(part)
        out[i : i + n] = powers[:n] * np.cumsum(part / powers[:n]) + powers[1 : n + 1] * last if a else part
        last = out[i + n - 1]
    return out


def quadratic_upsample(x: np.ndarray, factor: int) -> np.ndarray:
    """``factor`` times as many samples, on the parabola through the three nearest ones; of one series, or of one per row."""
    x = np.asarray(x, float)
    size = x.shape[-1]
    if size < 3 or factor <= 1:
        return x
    at = np.arange((size - 1) * factor + 1) / factor
    k = np.clip(np.rint(at).astype(int), 1, size - 2)
    u = at - k
    a, b, c = x[..., k - 1], x[..., k], x[..., k + 1]
    return b + u * (c - a) / 2 + u * u * (a - 2 * b + c) / 2


# ---------------------------------------------------------------- similarity
def _turned(a: np.ndarray, b: np.ndarray) -> float:
    """Smaller root mean square difference of ``a`` to ``b`` and to its mirror image."""
    return float(min(np.sqrt(np.mean((a - b) ** 2)), np.sqrt(np.mean((a + b) ** 2))))


def _period(w: np.ndarray, f: float) -> tuple[np.ndarray, np.ndarray]:
    """One period of a waveform (time, value) around its maximum: phases from -0.5 on, and values."""
    t, v = w[0] * f, w[1]
    inside = (t >= t[0]) & (t < t[0] + max(1.0, (t[-1] - t[0]) - 1))
    top = t[inside][np.argmax(v[inside])] if inside.any() else t[np.argmax(v)]
    x = (t - top + 0.5) % 1.0 - 0.5
    order = np.argsort(x, kind="stable")
    return x[order], v[order]


def _scaled(t: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    y = np.interp(np.linspace(-0.5, 0.5, n, endpoint=False), t, v, period=1.0)
    return (y - y.mean()) / (np.ptp(y) or 1.0)


def wave_shapes(w: np.ndarray, f: float) -> tuple[np.ndarray, np.ndarray]:
    """What ``wave_similarity`` compares of a waveform whose partner is as long: its period, and that of its mirror image."""
    t, v = _period(w, f)
    n = min(len(t), 400)
    return _scaled(t, v, n), _scaled(t, -v, n)


def shapes_difference(one: np.ndarray, two: np.ndarray, mirrored: np.ndarray) -> float:
    flipped = np.roll(mirrored, np.argmax(one) - np.argmax(mirrored))
    scale = max(one.std(), two.std()) or 1.0
    return float(min(np.sqrt(np.mean((one - two) ** 2)), np.sqrt(np.mean((one - flipped) ** 2))) / scale)


def wave_similarity(a: np.ndarray, b: np.ndarray, fa: float, fb: float) -> float:
    """Difference of one period around the maximum of two waveforms (time, value), scaled to their range, relative to the std."""
    (ta, va), (tb, vb) = _period(a, fa), _period(b, fb)
    n = min(len(ta), len(tb), 400)
    return shapes_difference(_scaled(ta, va, n), _scaled(tb, vb, n), _scaled(tb, -vb, n))


def pulse_similarity(a: np.ndarray, b: np.ndarray, wfac: float = 10.0) -> float:
    """Root mean square difference of two pulses (time, value), aligned at their maxima, scaled to them, over ``wfac`` half widths.

    The first one is turned so that its largest value is positive, the second is
    taken either way, whichever is nearer.
    """

    def width(w):
        v = np.abs(w[1])
        high = np.flatnonzero(v >= v.max() / 2)
        return (w[0][high[-1]] - w[0][high[0]]) or (w[0][1] - w[0][0])

    span = wfac * min(width(a), width(b))

    def shape(w, sign):
        v = sign * w[1]
        top = np.argmax(v)
        return np.interp(np.linspace(-span / 2, span / 2, 201), w[0] - w[0][top], v / (v[top] or 1.0), left=0.0, right=0.0)

    one = shape(a, 1 if a[1].max() >= -a[1].min() else -1)
    return float(min(np.sqrt(np.mean((one - shape(b, s)) ** 2)) for s in (1, -1)))


# ---------------------------------------------------------------- clustering
def mixture_1d(x: np.ndarray, n: int, steps: int = 200, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels, ordered by position, of a Gaussian mixture on a line; starts from quantiles, so runs agree.

    ``weight`` tells how often each value stands: all that is summed is weighted,
    so a histogram gives what its values, one by one, would give.
    """
    x = np.asarray(x, float)
    count = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    total = count.sum()
    center = (x * count).sum() / total if len(x) else 0.0
    spread = np.sqrt((count * (x - center) ** 2).sum() / total) if len(x) else 0.0
    if len(np.unique(x)) <= n or spread == 0:
        return np.zeros(len(x), int)
    z = (x - center) / spread
    order = np.argsort(z, kind="stable")
    mean, var, share = _quantiles(z[order], count[order], (np.arange(n) + 0.5) / n), np.full(n, 1.0 / n**2), np.full(n, 1.0 / n)
    for _ in range(steps):
        logp = -((z[:, None] - mean) ** 2) / (2 * var) - 0.5 * np.log(var) + np.log(share)
        p = np.exp(logp - logp.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        q = p * count[:, None]
        part = q.sum(0) + 1e-9
        new = q.T @ z / part
        var = np.maximum((q * (z[:, None] - new) ** 2).sum(0) / part, 1e-4)
        share = part / part.sum()
        done = np.abs(new - mean).max() < 1e-6
        mean = new
        if done:
            break
    label = p.argmax(1)[order]
    cuts = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    out = np.empty(len(x), int)
    out[order] = cuts
    return out


def mixtures_1d(x: np.ndarray, cuts: np.ndarray, n: int, weight: np.ndarray, steps: int = 200) -> np.ndarray:
    """The labels of ``mixture_1d`` for many series at a time: the k-th from ``cuts[k]`` to ``cuts[k + 1]``; a step works on all that have not come to rest."""
    x, count, size = np.asarray(x, float), np.asarray(weight, float), np.diff(cuts)
    label, series = np.zeros(len(x), int), np.repeat(np.arange(len(size)), size)
    if not len(x):
        return label
    over = lambda y, begins: np.add.reduceat(y, begins, axis=-1)
    total = over(count, cuts[:-1])
    center = over(x * count, cuts[:-1]) / total
    spread = np.sqrt(over(count * (x - center[series]) ** 2, cuts[:-1]) / total)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (x - center[series]) / spread[series]
    order = np.lexsort((z, series))
    x, z, count = x[order], z[order], count[order]
    fresh = np.append(True, (x[1:] != x[:-1]) | (series[1:] != series[:-1]))
    live = np.flatnonzero((over(fresh.astype(int), cuts[:-1]) > n) & (spread > 0))
    rows = np.flatnonzero(np.isin(series, live))
    z, count, size = z[rows], count[rows], size[live]
    begins = np.cumsum(size) - size
    mean = np.stack([_quantiles(z[a : a + m], count[a : a + m], (np.arange(n) + 0.5) / n) for a, m in zip(begins, size)], axis=1) if len(live) else np.zeros((n, 0))
    var, share = np.full(mean.shape, 1.0 / n**2), np.full(mean.shape, 1.0 / n)
    for step in range(steps):
        if not len(live):
            break
        each = lambda y: np.repeat(y, size, axis=1)  # noqa: B023, E731
        logp = -((z - each(mean)) ** 2) / each(2 * var) - each(0.5 * np.log(var)) + each(np.log(share))
        p = np.exp(logp - logp.max(0))
        p /= p.sum(0)
        q = p * count
        part = over(q, begins) + 1e-9
        new = over(q * z, begins) / part
        var = np.maximum(over(q * (z - each(new)) ** 2, begins) / part, 1e-4)
        share = part / part.sum(0)
        done = (np.abs(new - mean).max(0) < 1e-6) | (step == steps - 1)
        mean = new
        if done.any():
            ends = np.repeat(done, size)
            label[rows[ends]] = p[:, ends].argmax(0)
            rows, z, count = rows[~ends], z[~ends], count[~ends]
            live, size, mean, var, share = live[~done], size[~done], mean[:, ~done], var[:, ~done], share[:, ~done]
            begins = np.cumsum(size) - size
    moves = np.append(0, np.cumsum((label[1:] != label[:-1]) & (series[1:] == series[:-1])))
    out = np.empty(len(label), int)
    out[order] = moves - moves[cuts[:-1]][series]
    return out


def _quantiles(x: np.ndarray, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Interpolated quantiles of sorted values that stand ``count`` times each."""
    upto = np.cumsum(count)
    at = share * (upto[-1] - 1)
    low = np.floor(at)
    value = lambda k: x[np.minimum(np.searchsorted(upto, k, "right"), len(x) - 1)]
    return value(low) + (at - low) * (value(low + 1) - value(low))


def merge_neighbours(x: np.ndarray, label: np.ndarray, ratio: float, min_n: int = 1, weight: np.ndarray | None = None) -> np.ndarray:
    """Small clusters become -1; neighbours by median that differ by less than ``ratio`` of the larger get the lower label, until stable."""
    label, x = np.array(label), np.asarray(x, float)
    count = np.ones(len(x)) if weight is None else np.asarray(weight, float)
    for k in np.unique(label):
        if count[label == k].sum() < min_n:
            label[label == k] = -1

    def median(k: int) -> float:
        of = np.flatnonzero(label == k)
        of = of[np.argsort(x[of], kind="stable")]
        return float(_quantiles(x[of], count[of], np.array([0.5]))[0])

    while True:
        medians = sorted((median(k), k) for k in np.unique(label) if k >= 0)
        for (a, i), (b, j) in zip(medians, medians[1:]):
            if abs(b - a) < ratio * max(abs(a), abs(b)):
                label[label == max(i, j)] = min(i, j)
                break
        else:
            return label


def dbscan(points: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Density clusters, numbered by their first point; -1 is noise.  Neighbours are found by grid cells of the first two axes, of few points among all pairs."""
    n = len(points)
    label = np.full(n, -1)
    if not n:
        return label
    if n <= 256:
        pairs = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2) <= eps * eps
        core, k = pairs.sum(1) >= min_samples, 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                reached = pairs[i] & (label < 0)
                while True:
                    wider = reached | (pairs[reached & core].any(0) & (label < 0))
                    if (wider == reached).all():
                        break
                    reached = wider
                label[reached] = k
                k += 1
        return label
    cell = np.floor(points[:, :2] / eps).astype(np.int64)
    cells: dict[tuple[int, ...], list[int]] = {}
    for i, c in enumerate(map(tuple, cell)):
        cells.setdefault(c, []).append(i)
    offsets = np.stack(np.meshgrid(*[[-1, 0, 1]] * cell.shape[1], indexing="ij"), -1).reshape(-1, cell.shape[1])
    near = []
    for i in range(n):
        some = [k for o in offsets for k in cells.get(tuple(cell[i] + o), ())]
        some = np.array(some)
        near.append(some[((points[some] - points[i]) ** 2).sum(1) <= eps * eps])
    core = np.array([len(x) >= min_samples for x in near])
    k = 0
    for i in range(n):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                j = stack.pop()
                for m in near[j]:
                    if label[m] < 0:
                        label[m] = k
                        if core[m]:
                            stack.append(m)
            k += 1
    return label


def principal_components(rows: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first k components, each with its largest loading positive."""
    x = rows - rows.mean(0)
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    vt = _signed(vt[:k])
    out = np.zeros((len(rows), k))
    out[:, : len(vt)] = x @ vt.T
    return out


def loadings(covariance: np.ndarray, k: int) -> np.ndarray:
    """The first k components of a covariance matrix, a row each, with their largest entry positive; zeros where there are fewer."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > 1e-12 * max(values.max(initial=0.0), 1e-300)]
    out = np.zeros((k, len(covariance)))
    out[: len(order)] = _signed(vectors[:, order].T)
    return out


def _signed(vt: np.ndarray) -> np.ndarray:
    return vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None] if len(vt) else vt


def lags_to(rows: np.ndarray, mean: np.ndarray, most: int) -> np.ndarray:
    """By how many samples each row is to be moved so that it correlates best with ``mean``; the smallest move of equals."""
    n = rows.shape[1]
    nfft = next_power_of_two(2 * n)
    cc = np.fft.irfft(np.conj(np.fft.rfft(rows, nfft, axis=1)) * np.fft.rfft(mean, nfft), nfft, axis=1)
    moves = np.array(sorted(range(-most, most + 1), key=lambda d: (abs(d), d)))
    cc = cc[:, moves % nfft]
    near = cc >= cc.max(1, keepdims=True) - 1e-9 * np.abs(cc).max(1, keepdims=True)
    return moves[near.argmax(1)]


def moved(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rows moved to the right by so many samples; what comes in is the value at the end."""
    n = rows.shape[1]
    at = np.clip(np.arange(n) - by[:, None], 0, n - 1)
    return np.take_along_axis(rows, at, axis=1)


def tail_time_constant(t: np.ndarray, v: np.ndarray, start: int, noise: float) -> tuple[float, float] | None:
    """(tau, start time) of an exponential fitted to the tail from half of the last phase's height on, or None where it doesn't decay."""
    sign = 1.0 if v[start] > 0 else -1.0
    y = sign * v[start:]
    below = np.flatnonzero(y < y[0] / 2)
    if not len(below):
        return None
    i = start + below[0]
    tail = sign * v[i:]
    end = np.flatnonzero(tail < noise)
    tail = tail[: end[0]] if len(end) else tail
    if len(tail) < 5 or tail[0] < 2 * noise:
        return None
    tt = t[i : i + len(tail)] - t[i]
    a, tau, off = tail[0], (tt[-1] - tt[0]) / 2, 0.0
    for _ in range(60):
        e = np.exp(-tt / tau)
        r = tail - (a * e + off)
        jac = np.stack([e, a * tt / tau**2 * e, np.ones_like(e)], 1)
        step, *_ = np.linalg.lstsq(jac, r, rcond=None)
        a, tau, off = a + step[0], max(tau + step[1], tau / 3), off + step[2]
        if abs(step[1]) < 1e-9 * tau:
            break
    return (float(tau), float(t[i])) if a > 0 and 0 < tau < 10 * (tt[-1] + tt[1]) else None
