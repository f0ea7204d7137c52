"""Numeric kernels over one series, in numpy: what windows and aggregates can't express."""

from __future__ import annotations

import numpy as np

#: Daubechies' low-pass filters of 4 and 6 vanishing moments.
DB4 = [-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965]
DB6 = [-0.00107730108499558, 0.004777257511010651, 0.0005538422009938016, -0.031582039318031156, 0.02752286553001629, 0.09750160558707936, -0.12976686756709563, -0.22626469396516913, 0.3152503517092432, 0.7511339080215775, 0.4946238903983854, 0.11154074335008017]


def butter(order: int, cutoff, kind: str, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter, by the bilinear transform of the analog prototype's poles."""
    nyquist = fs / 2
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if (edges <= 0).any() or (edges >= nyquist).any() or len(edges) != (2 if kind == "band" else 1):
        raise ValueError(f"the cutoff must lie between 0 and {nyquist} Hz")
    warped = 4 * np.tan(np.pi * edges / fs / 1)  # sample rate 2 of the transform
    k = np.arange(-order + 1, order, 2)
    poles, zeros, gain = -np.exp(1j * np.pi * k / (2 * order)), np.zeros(0, complex), 1.0
    if kind == "low":
        w = warped[0]
        poles, gain = poles * w, w**order
    elif kind == "high":
        w = warped[0]
        gain = 1 / np.real(np.prod(-poles))
        poles, zeros = w / poles, np.zeros(order, complex)
    elif kind == "band":
        width, mid = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - mid**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
    else:
        raise ValueError(f"unknown filter {kind!r}")
    z, p = (4 + zeros) / (4 - zeros), (4 + poles) / (4 - poles)
    gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    z = np.concatenate([z, -np.ones(len(p) - len(z))])
    return np.real(np.poly(z)) * gain, np.real(np.poly(p))


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, from a state."""
    z, out = state.copy(), np.empty(len(x))
    for k, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = z[1:] + b[1:-1] * v - a[1:-1] * y
        z[-1] = b[-1] * v - a[-1] * y
        out[k] = y
    return out


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The state in which a filter answers a constant 1 from the start."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, so without a shift; ends are prolonged by odd reflection."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"the series must have over {pad} samples")
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = steady_state(b, a)
    y = lfilter(b, a, ext, z * ext[0])[::-1]
    return lfilter(b, a, y, z * y[0])[::-1][pad:-pad]


def gaussian_kernel(sigma: float) -> np.ndarray:
    k = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    return w / w.sum()


def gaussian_smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Ends are reflected, the last sample repeated."""
    w = gaussian_kernel(sigma)
    return np.convolve(np.pad(x, len(w) // 2, mode="symmetric"), w, mode="valid")


def welch(x: np.ndarray, fs: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided density: Hann windows, half overlapping, each without its mean."""
    n = min(size, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = n - n // 2
    parts = np.array([x[k : k + n] for k in range(0, len(x) - n + 1, step)])
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(0)


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None) -> np.ndarray:
    """Strict local maxima, the middle of plateaus; lower ones within ``distance`` of a higher one go."""
    if distance is not None and distance < 1:
        raise ValueError("distance must be at least 1")
    peaks, k = [], 1
    while k < len(x) - 1:
        if x[k - 1] < x[k]:
            j = k
            while j < len(x) - 1 and x[j + 1] == x[k]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[k]:
                peaks.append((k + j) // 2)
            k = j
        k += 1
    peaks = np.array(peaks, int)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                near = np.abs(peaks - peaks[k]) < np.ceil(distance)
                near[k] = False
                keep &= ~near
        peaks = peaks[keep]
    return peaks


def _analysis(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level with half-sample symmetric ends."""
    m = len(low)
    ext = np.pad(x, m - 1, mode="symmetric")
    return np.convolve(ext, low, "valid")[1::2], np.convolve(ext, high, "valid")[1::2]


def _synthesis(a: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    m = len(low)
    up = np.zeros((2, 2 * len(a)))
    up[0, ::2], up[1, ::2] = a, d
    out = np.convolve(up[0], low[::-1]) + np.convolve(up[1], high[::-1])
    return out[m - 2 : m - 2 + n]


def wavelet_denoise(x: np.ndarray, wavelet: str = "db4") -> np.ndarray:
    """Soft threshold sigma * sqrt(2 ln n) on all details; sigma from the finest ones."""
    low = np.array({"db4": DB4, "db6": DB6}[wavelet])
    m = len(low)
    high = low[::-1] * np.where(np.arange(m) % 2 == 0, -1, 1)
    levels = max(0, int(np.log2(len(x) / (m - 1)))) if len(x) >= m - 1 else 0
    details, sizes, a = [], [], np.asarray(x, float)
    for _ in range(levels):
        sizes.append(len(a))
        a, d = _analysis(a, low, high)
        details.append(d)
    if not details:
        return a
    limit = np.median(np.abs(details[0])) / 0.6745 * np.sqrt(2 * np.log(len(x)))
    for d, n in zip(reversed(details), reversed(sizes), strict=True):
        d = np.sign(d) * np.maximum(np.abs(d) - limit, 0)
        a = _synthesis(a[: len(d)], d, low, high, n)
    return a


def parafac(x: np.ndarray, rank: int, rounds: int = 100, seed: int = 0, mask: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Factors of a 3-way tensor by alternating least squares, and its reconstruction; unknown cells (``mask`` false) are imputed each round."""
    rng = np.random.default_rng(seed)
    known = np.isfinite(x) if mask is None else mask & np.isfinite(x)
    now = np.where(known, x, np.nanmean(np.where(known, x, np.nan)) if known.any() else 0.0)
    f = [rng.standard_normal((n, rank)) for n in x.shape]
    last = np.inf
    for _ in range(rounds):
        for k in range(3):
            i, j = [a for a in range(3) if a != k]
            kr = (f[i][:, None] * f[j][None]).reshape(-1, rank)
            unfolded = np.moveaxis(now, k, 0).reshape(x.shape[k], -1)
            f[k] = unfolded @ kr @ np.linalg.pinv((f[i].T @ f[i]) * (f[j].T @ f[j]))
        made = np.einsum("ir,jr,kr->ijk", *f)
        if not known.all():
            now = np.where(known, x, made)
        error = float(((now - made)[known] ** 2).sum())
        if abs(last - error) <= 1e-10 * max(1.0, last if np.isfinite(last) else 1.0):
            break
        last = error
    return f, made


def tucker(x: np.ndarray, ranks: tuple[int, int, int], rounds: int = 50) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Core, factors and explained share of variance, by higher-order orthogonal iteration."""
    f = [np.linalg.svd(np.moveaxis(x, k, 0).reshape(x.shape[k], -1), full_matrices=False)[0][:, :r] for k, r in enumerate(ranks)]
    for _ in range(rounds):
        for k in range(3):
            y = x
            for j in range(3):
                if j != k:
                    y = np.moveaxis(np.tensordot(f[j].T, y, (1, j)), 0, j)
            f[k] = np.linalg.svd(np.moveaxis(y, k, 0).reshape(x.shape[k], -1), full_matrices=False)[0][:, : ranks[k]]
    core = np.einsum("ijk,ia,jb,kc->abc", x, *f)
    made = np.einsum("abc,ia,jb,kc->ijk", core, *f)
    return core, f, 1 - float(((x - made) ** 2).sum() / ((x - x.mean()) ** 2).sum())
