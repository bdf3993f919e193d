"""What the window kernels share: moments, sorted values, differences, autocorrelation and spectrum of a batch."""

from __future__ import annotations

from functools import cached_property

import numpy as np

#: Keeps divisors and logarithms away from zero.
EPS = 1e-10

#: Longest rows that are summed from left to right.
IN_ORDER = 256

Features = dict[str, np.ndarray]


def summed(values: np.ndarray) -> np.ndarray:
    """Row sums.  Up to ``IN_ORDER`` values are added from left to right, as SQL adds a list: where terms cancel, what
    rounding leaves has the same sign there."""
    return values.cumsum(axis=1)[:, -1] if 0 < values.shape[1] <= IN_ORDER else values.sum(axis=1)


class Windows:
    """A batch ``[B, T]`` of windows in double precision; everything derived is computed once, when first asked for.

    A constant window has exactly zero deviations, so rounding noise never turns into a scaled signal.
    """

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, dtype=np.float64)
        self.n, self.size = self.x.shape

    @cached_property
    def low(self) -> np.ndarray:
        return self.x.min(axis=1)

    @cached_property
    def high(self) -> np.ndarray:
        return self.x.max(axis=1)

    @cached_property
    def spread(self) -> np.ndarray:
        return self.high - self.low

    @cached_property
    def flat(self) -> np.ndarray:
        return self.spread == 0

    @cached_property
    def mean(self) -> np.ndarray:
        return np.where(self.flat, self.low, summed(self.x) / self.size)

    @cached_property
    def centred(self) -> np.ndarray:
        return self.x - self.mean[:, None]

    @cached_property
    def squares(self) -> np.ndarray:
        """Sum of squared deviations."""
        return summed(self.centred**2)

    @cached_property
    def variance(self) -> np.ndarray:
        return self.squares / max(1, self.size - 1) if self.size > 1 else np.full(self.n, np.nan)

    @cached_property
    def std(self) -> np.ndarray:
        return np.sqrt(self.variance)

    @cached_property
    def scale(self) -> np.ndarray:
        return np.maximum(self.std, EPS)

    @cached_property
    def z(self) -> np.ndarray:
        return self.centred / self.scale[:, None]

    @cached_property
    def steps(self) -> np.ndarray:
        return np.diff(self.x, axis=1)

    @cached_property
    def ordered(self) -> np.ndarray:
        """Sorted values; a window with a NaN is all NaN, as no order statistic of it exists."""
        out = np.sort(self.x, axis=1)
        out[np.isnan(out[:, -1])] = np.nan
        return out

    @cached_property
    def repeats(self) -> np.ndarray:
        """Where a sorted value equals the one before."""
        return self.ordered[:, 1:] == self.ordered[:, :-1]

    def quantile(self, q: float) -> np.ndarray:
        """Linear interpolation between order statistics."""
        at = q * (self.size - 1)
        low = int(at)
        high = min(low + 1, self.size - 1)
        return self.ordered[:, low] + (self.ordered[:, high] - self.ordered[:, low]) * (at - low)

    @cached_property
    def acf(self) -> np.ndarray:
        """Autocorrelation at lags 0 to T - 1 (biased)."""
        return autocorrelation(self.centred, self.size)

    @cached_property
    def waves(self) -> np.ndarray:
        """Discrete Fourier transform of the scaled window; the mean's and the highest frequency's noise is removed.

        Up to ``IN_ORDER`` terms are added from left to right (see ``summed``): angles of waves that cancel depend on it.
        """
        t = np.arange(self.size)
        k = np.arange(self.size // 2 + 1)
        if self.size <= IN_ORDER:
            turns = 2 * np.pi * (np.outer(t, k) % self.size) / self.size
            real, imaginary = np.zeros((self.n, len(k))), np.zeros((self.n, len(k)))
            for value, cosines, sines in zip(self.z.T, np.cos(turns), np.sin(turns), strict=True):
                real += value[:, None] * cosines
                imaginary += value[:, None] * sines
            out = np.empty((self.n, len(k)), dtype=np.complex128)
            out.real, out.imag = real, -imaginary
        else:
            out = np.fft.rfft(self.z, axis=1)
        out[:, 0] = 0
        if self.size % 2 == 0:
            out[:, -1] = out[:, -1].real
        return out

    @cached_property
    def power(self) -> np.ndarray:
        return np.abs(self.waves) ** 2

    @cached_property
    def total_power(self) -> np.ndarray:
        return np.maximum(self.power.sum(axis=1), EPS)

    def bins(self, n: int) -> np.ndarray:
        """Equal bins between minimum and maximum; all in the first for a constant window."""
        width = np.where(self.flat, 1.0, self.spread)[:, None]
        return np.minimum(np.nan_to_num((self.x - self.low[:, None]) / width * n).astype(np.int64), n - 1)

    @cached_property
    def thirds(self) -> np.ndarray:
        """0, 1 or 2, by the window's own terciles."""
        return (self.x > self.quantile(0.333)[:, None]).astype(np.int64) + (self.x > self.quantile(0.667)[:, None])


def autocorrelation(centred: np.ndarray, lags: int) -> np.ndarray:
    size = centred.shape[1]
    lags = min(lags, size)
    if size > 512:
        wide = np.fft.rfft(centred, 2 * size, axis=1)
        raw = np.fft.irfft(np.abs(wide) ** 2, axis=1)[:, :lags]
    else:
        raw = np.stack([(centred[:, : size - k] * centred[:, k:]).sum(axis=1) for k in range(lags)], axis=1)
    return raw / np.maximum(raw[:, :1], EPS)


def longest_run(flags: np.ndarray) -> np.ndarray:
    """Length of the longest run of true values in each row."""
    best = current = np.zeros(len(flags))
    for t in range(flags.shape[1]):
        current = (current + 1) * flags[:, t]
        best = np.maximum(best, current)
    return best


def line(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept, signed root of the explained share, and standard error of a straight line through each row."""
    size = y.shape[1]
    t = np.arange(size) - (size - 1) / 2
    flat = y.max(axis=1) == y.min(axis=1)
    mean = np.where(flat, y[:, 0], y.mean(axis=1))
    centred = y - mean[:, None]
    tt, ty, yy = (t * t).sum(), (centred * t).sum(axis=1), (centred**2).sum(axis=1)
    slope = ty / max(tt, EPS)
    rest = yy - slope * ty
    explained = np.clip(1 - rest / np.maximum(yy, EPS), 0, 1)
    error = np.sqrt(np.maximum(rest, 0) / (size - 2) / max(tt, EPS)) if size > 2 else np.zeros(len(y))
    return slope, mean - slope * (size - 1) / 2, np.sqrt(explained) * np.sign(slope), error


def spread_around(values: np.ndarray) -> np.ndarray:
    """Sample variance of each row; NaN for one column."""
    return values.var(axis=1, ddof=1) if values.shape[1] > 1 else np.full(len(values), np.nan)


def finite(features: Features) -> tuple[list[str], np.ndarray]:
    """Names and a matrix in which everything that is not finite is zero."""
    out = np.stack([np.broadcast_to(v, next(iter(features.values())).shape).astype(np.float64) for v in features.values()], axis=1)
    out[~np.isfinite(out)] = 0.0
    return list(features), out
