"""Discrete wavelet decompositions of a window and statistics of their coefficients."""

from __future__ import annotations

import numpy as np

from tidemark.functions.context import EPS, Features, Windows

#: Low-pass decomposition taps.
LOW = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "db2": (-0.12940952255092145, 0.22414386804185735, 0.83651630373746899, 0.48296291314469025),
    "db4": (-0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114, -0.027983769416983849, 0.63088076792959036, 0.71484657055254153, 0.23037781330885523),
    "sym4": (-0.07576571478927333, -0.02963552764599851, 0.49761866763201545, 0.80373875180591614, 0.29785779560527736, -0.09921954357684722, -0.01260396726203783, 0.03222310060404270),
}


def taps(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass taps and the high-pass taps that mirror them."""
    if name not in LOW:
        raise ValueError(f"unknown wavelet {name!r}; known: {', '.join(LOW)}")
    low = np.array(LOW[name])
    signs = np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    return low, low[::-1] * (-signs if name == "haar" else signs)


def split(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """One level: approximation and detail.  Ends are reflected (without the end value), every second place is kept."""
    low, high = taps(name)
    reach = len(low) - 1
    wide = np.pad(x, ((0, 0), (reach, reach)), mode="reflect")
    views = np.lib.stride_tricks.sliding_window_view(wide, len(low), axis=1)[:, ::2]
    return views @ low[::-1], views @ high[::-1]


def decompose(x: np.ndarray, name: str, levels: int = 4) -> list[np.ndarray]:
    """Deepest approximation, then details from the deepest to the shallowest; stops when too few values are left."""
    details: list[np.ndarray] = []
    for _ in range(levels):
        if x.shape[1] < 2 * len(LOW[name] if name in LOW else taps(name)[0]):
            break
        x, detail = split(x, name)
        details.insert(0, detail)
    return [x, *details]


def interpolate(x: np.ndarray, size: int) -> np.ndarray:
    """Linear interpolation to ``size`` places, with the centres of first and last cells as ends."""
    n = x.shape[1]
    at = np.maximum((np.arange(size) + 0.5) * n / size - 0.5, 0)
    low = np.minimum(at.astype(int), n - 1)
    high = np.minimum(low + 1, n - 1)
    return x[:, low] + (x[:, high] - x[:, low]) * (at - low)


def described(c: np.ndarray, prefix: str) -> Features:
    energy = c**2
    p = np.maximum(energy / np.maximum(energy.sum(axis=1, keepdims=True), EPS), EPS)
    return {
        f"{prefix}_energy": energy.sum(axis=1),
        f"{prefix}_mean": c.mean(axis=1),
        f"{prefix}_std": c.std(axis=1, ddof=1) if c.shape[1] > 1 else np.full(len(c), np.nan),
        f"{prefix}_max": np.abs(c).max(axis=1),
        f"{prefix}_entropy": -(p * np.log(p)).sum(axis=1),
    }


def wavelet_features(w: Windows, names: tuple[str, ...] = ("haar", "db4"), levels: int = 4, denoised: bool = True) -> Features:
    out: Features = {}
    for name in names:
        parts = decompose(w.x, name, levels)
        deep = len(parts) - 1
        labels = [f"a{deep}", *(f"d{k}" for k in range(deep, 0, -1))]
        for label, c in zip(labels, parts, strict=True):
            out |= described(c, f"wl_{name}_{label}")
        energies = np.stack([(c**2).sum(axis=1) for c in parts], axis=1)
        shares = energies / np.maximum(energies.sum(axis=1, keepdims=True), EPS)
        out |= {f"wl_{name}_eratio_{'approx' if k == 0 else label}": shares[:, k] for k, label in enumerate(labels)}
    if denoised:
        smooth = Windows(interpolate(decompose(w.x, names[0], min(3, levels))[0], w.size))
        norms = np.sqrt(w.squares) * np.sqrt(smooth.squares)
        out["wl_denoised_corr"] = (w.centred * smooth.centred).sum(axis=1) / (norms + EPS)
        out["wl_noise_level"] = (w.x - smooth.x).std(axis=1, ddof=1)
    return out
