"""Random dilated convolution kernels with four poolings."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidemark.functions.context import Features

LENGTHS = (7, 9, 11)


@lru_cache(maxsize=32)
def kernel_bank(size: int, kernels: int = 250, seed: int = 42) -> tuple[tuple[int, int, int, np.ndarray, float], ...]:
    """``(kernel, length, dilation, weights, bias)``, in the order of kernel ids: by length, dilation, then draw."""
    random = np.random.RandomState(seed)
    out = []
    for i, length in enumerate(LENGTHS):
        n = kernels // len(LENGTHS) + (i < kernels % len(LENGTHS))
        weights = random.standard_normal((n, length))
        weights -= weights.mean(axis=1, keepdims=True)
        widest = min(32, max(1, (size - 1) // (length - 1)))
        dilations = np.clip(np.exp(random.random_sample(n) * np.log(widest)).astype(int), 1, widest) if widest > 1 else np.ones(n, dtype=int)
        biases = random.standard_normal(n) * 0.1
        out += [(length, int(dilations[j]), weights[j], float(biases[j])) for j in np.argsort(dilations, kind="stable")]
    return tuple((k, *row) for k, row in enumerate(out))


@lru_cache(maxsize=32)
def _groups(size: int, kernels: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places that each output reads (``size`` means padding), weights and biases, for each length and dilation."""
    by: dict[tuple[int, int], list] = {}
    for _, length, dilation, weights, bias in kernel_bank(size, kernels, seed):
        by.setdefault((length, dilation), []).append((weights, bias))
    out = []
    for (length, dilation), rows in by.items():
        places = np.arange(size)[:, None] + (np.arange(length) - (length - 1) // 2) * dilation
        places[(places < 0) | (places >= size)] = size
        out.append((places, np.stack([w for w, _ in rows], axis=1), np.array([b for _, b in rows])))
    return out


#: Numbers of one intermediate result.
_ROOM = 1 << 21


def pooled(x: np.ndarray, kernels: int = 250, seed: int = 42) -> np.ndarray:
    """``[B, kernels, 4]``: share of positive outputs, largest output, mean positive output, and share times mean."""
    n, size = x.shape
    out = np.empty((n, kernels, 4))
    wide = np.concatenate([x, np.zeros((n, 1))], axis=1)
    first = 0
    for places, weights, biases in _groups(size, kernels, seed):
        many = weights.shape[1]
        step = max(1, _ROOM // (size * max(many, places.shape[1])))
        for start in range(0, n, step):
            y = wide[start : start + step][:, places] @ weights + biases
            positive = y > 0
            count = positive.sum(axis=1)
            mean = np.where(positive, y, 0).sum(axis=1) / np.maximum(count, 1)
            share = count / size
            out[start : start + step, first : first + many] = np.stack([share, y.max(axis=1), mean, share * mean], axis=2)
        first += many
    return out


def kernel_features(x: np.ndarray, kernels: int = 250, seed: int = 42) -> Features:
    """Every pooling named after the kernel it belongs to."""
    values = pooled(x, kernels, seed)
    return {f"rk_{name}_k{k}": values[:, k, p] for k in range(kernels) for p, name in enumerate(("ppv", "max", "mean", "mpvs"))}
