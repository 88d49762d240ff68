"""Numpy kernels for one series at a time, called inside grouped tasks."""

from __future__ import annotations

import math
from array import array
from functools import lru_cache

import numpy as np

from seriesforge.functions import philox


def chi2_ppf(p: float, dof: int) -> float:
    """Chi-squared quantile for even degrees of freedom: closed-form CDF, bisection."""
    if dof < 2 or dof % 2:
        raise ValueError("even degrees of freedom are needed")
    half = dof // 2

    def cdf(x: float) -> float:
        term = total = 1.0
        for j in range(1, half):
            term *= x / 2 / j
            total += term
        return 1.0 - math.exp(-x / 2) * total

    low, high = 0.0, 4.0 * dof + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _top_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The k largest eigenvalues of a symmetric tridiagonal matrix, by bisection on sign counts."""
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    d, squares, tiny = array("d", diagonal), array("d", off * off), 1e-300

    def above(x: float) -> int:
        q, n = d[0] - x, 0
        for i in range(len(d)):
            if i:
                q = d[i] - x - squares[i - 1] / (q or tiny)
            n += q > 0
        return n

    out = []
    for i in range(k):
        a, b = low, high
        while b - a > 4e-16 * max(abs(a), abs(b)):
            mid = (a + b) / 2
            if mid in (a, b):
                break
            a, b = (mid, b) if above(mid) > i else (a, mid)
        out.append((a + b) / 2)
    return out


def _inverse_iteration(diagonal: np.ndarray, off: np.ndarray, value: float, found: list[np.ndarray], steps: int = 4) -> np.ndarray:
    """The unit eigenvector of an eigenvalue; ``found`` are those to stay orthogonal to."""
    n = len(diagonal)
    shifted, o = array("d", diagonal - value), array("d", off)  # eight bytes a number, a list has forty
    least = 1e-16 * float(np.abs(diagonal).max())
    pivots, factors = array("d", bytes(8 * n)), array("d", bytes(8 * n))
    for i in range(n):
        pivot = shifted[i] - (factors[i - 1] * o[i - 1] if i else 0.0)
        pivots[i] = pivot if abs(pivot) > least else least
        factors[i] = o[i] / pivots[i] if i < n - 1 else 0.0
    x = np.cos(np.arange(n) * 0.7) + 1.5
    for _ in range(steps):
        y = array("d", x)
        for i in range(1, n):
            y[i] -= factors[i - 1] * y[i - 1]
        y[-1] /= pivots[-1]
        for i in range(n - 2, -1, -1):
            y[i] = y[i] / pivots[i] - factors[i] * y[i + 1]
        x = np.array(y)
        x /= np.linalg.norm(x)
        for v in found:
            x -= (x @ v) * v
        x /= np.linalg.norm(x)
    return x


#: Steps of a record up to which tapers of several lengths are kept.
KEPT = 1 << 15


def dpss(n: int, nw: float, k: int) -> np.ndarray:
    """The first k Slepian tapers (unit norm) from the tridiagonal eigenproblem.

    Made once per process and record length; of lengths over KEPT only the last
    one's are kept. Long records never hold a matrix: their few vectors come
    from bisection and inverse iteration.
    """
    return (_kept_tapers if n <= KEPT else _last_tapers)(n, nw, k)


def _tapers(n: int, nw: float, k: int) -> np.ndarray:
    t = np.arange(n)
    w = nw / n
    diagonal = ((n - 1 - 2 * t) / 2.0) ** 2 * np.cos(2 * np.pi * w)
    off = t[1:] * (n - t[1:]) / 2.0
    if n <= 512:
        matrix = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
        tapers = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T.copy()
    else:
        found: list[np.ndarray] = []
        for value in _top_eigenvalues(diagonal, off, k):
            found.append(_inverse_iteration(diagonal, off, value, found))
        tapers = np.stack(found)
    for i, taper in enumerate(tapers):  # sign convention: symmetric ones sum to above 0, others start upwards
        lead = taper.sum() if i % 2 == 0 else (n - 1 - 2 * t) @ taper
        tapers[i] = taper if lead >= 0 else -taper
    tapers.setflags(write=False)
    return tapers


_kept_tapers, _last_tapers = lru_cache(maxsize=16)(_tapers), lru_cache(maxsize=1)(_tapers)


def one_sided(power: np.ndarray, n: int) -> np.ndarray:
    """Double all bins but the first and, for even n, the last."""
    power = power.copy()
    power[..., 1 : (-1 if n % 2 == 0 else None)] *= 2
    return power


def periodogram(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    power = np.abs(np.fft.rfft(x - x.mean()))
    power *= power
    power /= fs * n
    power[1:-1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def multitaper(x: np.ndarray, fs: float, nw: float = 1.5, tapers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    tapers = dpss(n, nw, max(1, int(2 * nw - 1))) if tapers is None else tapers
    centred, power = x - x.mean(), np.zeros(n // 2 + 1)
    for taper in tapers:  # one at a time: a long record's transform is large
        one = np.abs(np.fft.rfft(taper * centred))
        one *= one
        power += one
    power /= len(tapers)
    power /= fs
    power[1:-1] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def welch(x: np.ndarray, fs: float, nperseg: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Half-overlapping periodic-Hann segments, each without its mean; a shorter record is one segment."""
    nperseg = min(nperseg, len(x))
    powers = segment_powers(x, fs, nperseg, nperseg - nperseg // 2)
    return np.fft.rfftfreq(nperseg, 1 / fs), powers.mean(axis=0), len(powers)


def segment_powers(x: np.ndarray, fs: float, nperseg: int, hop: int) -> np.ndarray:
    """One-sided periodic-Hann power of each segment without its mean."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    segments = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop]
    spectra = np.abs(np.fft.rfft((segments - segments.mean(axis=1, keepdims=True)) * window, axis=1)) ** 2
    return one_sided(spectra / (fs * (window**2).sum()), nperseg)


def band_variance(freqs: np.ndarray, psd: np.ndarray, low_period: float, high_period: float) -> float:
    inside = (freqs >= 1 / high_period) & (freqs <= 1 / low_period)
    return float(psd[inside].sum() * (freqs[1] - freqs[0]))


def amplitudes(freqs: np.ndarray, psd: np.ndarray, n: int, fs: float, bands: list[tuple[float, float, float]] | None, offset: bool = False) -> np.ndarray:
    """Spectral amplitudes for a synthetic record of n steps; bands compose by product. ``offset`` keeps the power at zero."""
    grid = np.fft.rfftfreq(n, 1 / fs)
    power = np.interp(grid, freqs, psd)
    for low, high, factor in bands or ():
        power[(grid >= 1 / high) & (grid <= 1 / low)] *= factor
    out = np.sqrt(power * n * fs / 2)
    if not offset:
        out[0] = 0.0
    return out


def sequential_phases(count: int, seed: int, member: int) -> np.ndarray:
    """Phases of a sequential generator, from where it would have arrived at this member."""
    bits = np.random.PCG64(seed)
    bits.advance(member * count)
    return np.random.Generator(bits).uniform(-np.pi, np.pi, count)


def counter_phases(count: int, seed: int, member: int) -> np.ndarray:
    """Phases drawn alone at (bin, member) with the seed as key."""
    return np.pi * (2.0 * philox.uniform(np.arange(count), member, seed) - 1.0)


def counter_normals(count: int, member: int, key: int) -> np.ndarray:
    """Standard normal numbers of the steps of a member (Box-Muller), each drawn at its place."""
    t = np.arange(count)
    return np.sqrt(-2.0 * np.log(philox.uniform(2 * t, member, key))) * np.cos(2.0 * np.pi * philox.uniform(2 * t + 1, member, key))


def synthesize(amplitude: np.ndarray, n: int, phases: np.ndarray, unit: bool = True) -> np.ndarray:
    """Phase-randomised record, with ``unit`` of variance one."""
    phases = phases.copy()
    phases[0] = 0.0
    if n % 2 == 0:
        phases[-1] = 0.0
    x = np.fft.irfft(amplitude * np.exp(1j * phases), n)
    if not unit:
        return x
    spread = x.std()
    if spread < 1e-10:
        raise ValueError("the spectrum holds no variance")
    return x / spread


def ar1_fit(x: np.ndarray) -> tuple[float, float]:
    if len(x) < 3 or x[:-1].std() == 0 or x[1:].std() == 0:
        return 0.0, float(x.std())
    phi = float(np.clip(np.corrcoef(x[:-1], x[1:])[0, 1], -0.99, 0.99))
    return phi, float(x.std() * math.sqrt(max(1e-12, 1 - phi * phi)))


def ar1_surrogates(noise: np.ndarray, phi: float) -> np.ndarray:
    """A record for each row of noise, from 0 on: one step for all of them at a time."""
    out = np.zeros_like(noise)
    for i in range(1, noise.shape[1]):
        out[:, i] = phi * out[:, i - 1] + noise[:, i]
    return out


# MacKinnon (1994, 2010), one variable, with constant.
ADF_SMALL = (2.1659, 1.4412, 3.8269e-2)
ADF_LARGE = (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def adf_test(x: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller with constant, lag by AIC: statistic, p-value, lag."""
    n = len(x)
    most = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
    dx = np.diff(x)

    def regress(lag: int, start: int):
        y = dx[start:]
        columns = [x[start:-1], np.ones(len(y))] + [dx[start - j : len(dx) - j] for j in range(1, lag + 1)]
        a = np.column_stack(columns)
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = float(((y - a @ beta) ** 2).sum())
        return a, y, beta, rss

    scores = []
    for lag in range(most + 1):
        a, y, _, rss = regress(lag, most)
        scores.append(len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * a.shape[1])
    lag = int(np.argmin(scores))
    a, y, beta, rss = regress(lag, lag)
    sigma2 = rss / max(1, len(y) - a.shape[1])
    statistic = float(beta[0] / math.sqrt(sigma2 * np.linalg.pinv(a.T @ a)[0, 0]))
    return statistic, adf_p_value(statistic), lag


def adf_p_value(statistic: float) -> float:
    if statistic > ADF_MAX:
        return 1.0
    if statistic < ADF_MIN:
        return 0.0
    powers = ADF_SMALL if statistic <= ADF_STAR else ADF_LARGE
    return 0.5 * math.erfc(-sum(c * statistic**i for i, c in enumerate(powers)) / math.sqrt(2))


def find_peaks(values: np.ndarray, least_prominence: float) -> list[tuple[int, float]]:
    """Local maxima (middle of plateaus) with their prominence.

    The bases lie between a peak and the nearest higher values on either side.
    """
    starts = np.flatnonzero(np.append(True, np.diff(values) != 0))  # of runs of equal values
    levels, ends = values[starts], np.append(starts[1:], len(values)) - 1
    out = []
    for run in np.flatnonzero((levels[1:-1] > levels[:-2]) & (levels[1:-1] > levels[2:])) + 1:
        higher = np.flatnonzero(levels > levels[run])
        left, right = higher[higher < run], higher[higher > run]
        low = levels[(left[-1] + 1 if len(left) else 0) : run + 1].min()
        other = levels[run : (right[0] if len(right) else len(levels))].min()
        prominence = float(levels[run] - max(low, other))
        if prominence >= least_prominence:
            out.append((int(starts[run] + ends[run]) // 2, prominence))
    return out
