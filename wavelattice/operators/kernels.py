"""NumPy kernels by item: factorisations, peaks, filters; and separators that run them in Arrow batches.

One item is one group, so an item must fit a task; cut longer ones with
signal.collect_windows and join them with signal.overlap_and_add.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .spectral import istft_array, stft_array


def rpca(m: np.ndarray, iterations: int = 100, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank and sparse parts, by inexact augmented Lagrange multipliers."""
    weight, norm = 1 / np.sqrt(max(m.shape)), max(np.linalg.norm(m), 1e-12)
    spectral = max(np.linalg.norm(m, 2), 1e-12)
    dual = m / max(spectral, np.abs(m).max() / weight)
    penalty, sparse, low = 1.25 / spectral, np.zeros_like(m), m
    soft = lambda x, t: np.sign(x) * np.maximum(np.abs(x) - t, 0)
    for _ in range(iterations):
        u, s, v = np.linalg.svd(m - sparse + dual / penalty, full_matrices=False)
        low = (u * soft(s, 1 / penalty)) @ v
        sparse = soft(m - low + dual / penalty, weight / penalty)
        rest = m - low - sparse
        dual = dual + penalty * rest
        penalty *= 1.5
        if np.linalg.norm(rest) / norm < tolerance:
            break
    return low, sparse


def nmf(v: np.ndarray, rank: int, iterations: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Multiplicative updates for the Frobenius distance."""
    r = np.random.default_rng(seed)
    w, h = r.random((v.shape[0], rank)) + 0.1, r.random((rank, v.shape[1])) + 0.1
    for _ in range(iterations):
        h *= (w.T @ v) / (w.T @ w @ h + 1e-12)
        w *= (v @ h.T) / (w @ h @ h.T + 1e-12)
    return w, h


def fast_ica(x: np.ndarray, iterations: int = 200, seed: int = 0) -> np.ndarray:
    """Independent components of channels, scaled to the input's peak."""
    centred = x - x.mean(axis=1, keepdims=True)
    values, vectors = np.linalg.eigh(centred @ centred.T / centred.shape[1])
    white = (vectors / np.sqrt(np.maximum(values, 1e-12))).T @ centred
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(x), len(x))))[0]
    for _ in range(iterations):
        g = np.tanh(w @ white)
        u, _, v = np.linalg.svd(g @ white.T / white.shape[1] - np.diag((1 - g * g).mean(axis=1)) @ w)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-8
        w = new
        if done:
            break
    out = w @ white
    return out / max(np.abs(out).max(), 1e-12) * np.abs(x).max()


def peaks(values: np.ndarray, count: int, distance: int | None = None, threshold: float = 0.5) -> list[int]:
    """Places of the highest values, at least distance + 1 apart, first of equals."""
    v = np.asarray(values, float)
    span = v.max() - v.min() if len(v) else 0
    if not span:
        raise ValueError("no peak above the threshold")
    v = (v - v.min()) / span
    v = np.where(v < threshold, -1.0, v)
    distance, out = len(v) // 4 if distance is None else distance, []
    while len(out) < count and v.max() >= 0:
        k = int(v.argmax())
        out.append(k)
        v[max(k - distance, 0) : k + distance + 1] = -1
    return out


def biquad(x: np.ndarray, rate: int, kind: str, frequency: float, q: float = 0.7071) -> np.ndarray:
    """Second-order low- or high-pass."""
    if frequency <= 0 or kind not in ("low", "high"):
        raise ValueError("frequency is positive, kind low or high")
    w = 2 * np.pi * frequency / rate
    cos, alpha = np.cos(w), np.sin(w) / (2 * q)
    edge = (1 - cos) / 2 if kind == "low" else (1 + cos) / 2
    b0, b1, a0, a1, a2 = edge, 2 * edge if kind == "low" else -2 * edge, 1 + alpha, -2 * cos, 1 - alpha
    out, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
    for n, v in enumerate(x.tolist()):
        y = (b0 * v + b1 * x1 + b0 * x2 - a1 * y1 - a2 * y2) / a0
        out[n], x2, x1, y2, y1 = y, x1, v, y1, y
    return out


def resample(x: np.ndarray, rate: int, new_rate: int, taps: int = 32) -> np.ndarray:
    """Windowed-sinc interpolation."""
    size = int(np.ceil(len(x) * new_rate / rate))
    at, cut = np.arange(size) * rate / new_rate, min(1.0, new_rate / rate)
    half = int(np.ceil(taps / cut))
    base, offsets = np.floor(at).astype(int), np.arange(-half + 1, half + 1)
    gap = at[:, None] - (base[:, None] + offsets)
    kernel = cut * np.sinc(cut * gap) * (0.5 + 0.5 * np.cos(np.pi * np.clip(gap / half, -1, 1)))
    padded = np.pad(np.asarray(x, float), half + 1)
    return (padded[base[:, None] + offsets + half + 1] * kernel).sum(axis=1)


def fourier_foreground(m: np.ndarray, neighbourhood: tuple[int, int] = (1, 25)) -> np.ndarray:
    """Background share of magnitudes: peaks of the two-dimensional spectrum repeat, the rest does not."""
    z = np.fft.fft2(m)
    a, (rows, cols) = np.abs(z), neighbourhood
    pad = np.pad(a, ((rows // 2, rows // 2), (cols // 2, cols // 2)), mode="wrap")
    near = np.lib.stride_tricks.sliding_window_view(pad, (2 * (rows // 2) + 1, 2 * (cols // 2) + 1))
    top, low = near.max(axis=(2, 3)), near.min(axis=(2, 3))
    peak = (a == top) & (top - low > a.std())
    back = np.minimum(np.abs(np.fft.ifft2(np.where(peak, z, 0))), m)
    fore = np.minimum(np.abs(np.fft.ifft2(np.where(peak, 0, z))), m)
    return (back + 1e-16) / (back + fore + 1e-16)


def wiener(z: np.ndarray, magnitudes: np.ndarray, iterations: int = 1) -> np.ndarray:
    """Multichannel Wiener estimates (source, channel, f, t) of z (channel, f, t) from magnitudes (source, channel, f, t)."""
    y = magnitudes * np.exp(1j * np.angle(z))
    for _ in range(iterations):
        v = (np.abs(y) ** 2).mean(axis=1) + 1e-10
        r = np.einsum("scft,sdft->sfcd", y, y.conj()) / v.sum(axis=2)[..., None, None] + 1e-8 * np.eye(z.shape[0])
        total = np.linalg.pinv(np.einsum("sft,sfcd->ftcd", v, r))
        y = np.einsum("sft,sfcd,ftde,eft->scft", v, r, total, z)
    return y


def _two(m: np.ndarray, method: str) -> np.ndarray:
    """Mask of the first of two sources of magnitudes m (f, t)."""
    if method == "rpca":
        low, sparse = rpca(m)
        return (np.abs(sparse) <= np.abs(low)).astype(float)
    if method == "ft2d":
        return fourier_foreground(m)
    w, h = nmf(m, 2)
    return (np.outer(w[:, 0], h[0]) + 1e-12) / (w @ h + 2e-12)


#: Names that separate() takes.
SEPARATORS = ("rpca", "ft2d", "nmf")


def separate(signals: DataFrame, method: str, rate: int, length: int, hop: int) -> DataFrame:
    """(item, src, ch, n, x): two estimates by a mask of the named method, one (item, ch) at a time."""
    if method not in SEPARATORS:
        raise ValueError(f"method is one of {SEPARATORS}")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("n")
        x = pdf.x.to_numpy()
        z = stft_array(x, length, hop)
        mask = _two(np.abs(z), method)
        out = [istft_array(z * m, length, hop, len(x)) for m in (mask, 1 - mask)]
        return pd.concat([pd.DataFrame({"item": pdf.item, "src": k, "ch": pdf.ch, "n": pdf.n, "x": v}) for k, v in enumerate(out)])

    return signals.select("item", "ch", "n", "x").groupBy("item", "ch").applyInPandas(run, "item string, src int, ch int, n long, x double")


def by_channel(x: np.ndarray, f, *arguments) -> np.ndarray:
    """f of each channel."""
    return np.array([f(c, *arguments) for c in x])


def by_item(signals: DataFrame, f) -> DataFrame:
    """(item, ch, n, x): f of each item's samples (channel, n), whose channels are of one length."""

    def run(pdf):
        import pandas as pd

        wide = pdf.pivot(index="ch", columns="n", values="x").sort_index(axis=1).to_numpy(float)
        out = f(wide)
        ch, n = np.indices(out.shape)
        return pd.DataFrame({"item": pdf["item"].iloc[0], "ch": ch.ravel(), "n": n.ravel(), "x": out.ravel()})

    return signals.select("item", "ch", "n", "x").groupBy("item").applyInPandas(run, "item string, ch int, n long, x double")


def separate_wiener(sources: DataFrame, length: int, hop: int, iterations: int = 1) -> DataFrame:
    """(item, src, ch, n, x): multichannel Wiener estimates of the mix, begun from the magnitudes of given sources (item, label, ch, n, x)."""

    def run(pdf):
        import pandas as pd

        places, known = zip(*(pd.factorize(pdf[c], sort=True) for c in ("label", "ch", "n")), strict=True)
        size = len(known[2])
        x, there = np.full([len(k) for k in known], np.nan), np.zeros([len(k) for k in known], bool)
        x[places], there[places] = pdf.x, True
        if there.sum() != len(pdf):
            raise ValueError("a sample is there twice")
        z = np.array([[stft_array(c, length, hop) for c in s] for s in x])
        y = wiener(z.sum(axis=0), np.abs(z), iterations)
        out = np.array([[istft_array(c, length, hop, size) for c in s] for s in y])
        src, ch, n = np.indices(out.shape)
        return pd.DataFrame({"item": pdf["item"].iloc[0], "src": src.ravel(), "ch": ch.ravel(), "n": n.ravel(), "x": out.ravel()})

    return sources.select("item", "label", "ch", "n", "x").groupBy("item").applyInPandas(run, "item string, src int, ch int, n long, x double")
