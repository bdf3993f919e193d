"""Truncated path signatures of several channels, by left-point sums."""

from __future__ import annotations

import numpy as np

from tidemark.functions.context import Features, Windows


def with_time(channels: np.ndarray) -> np.ndarray:
    """``[B, T, d]`` with time from 0 to 1 as a new first channel."""
    n, size, _ = channels.shape
    time = np.broadcast_to(np.linspace(0, 1, size)[None, :, None], (n, size, 1))
    return np.concatenate([time, channels], axis=2)


def lead_lag(path: np.ndarray) -> np.ndarray:
    """Each channel twice, the second one a step behind: ``[B, 2T - 1, 2d]``."""
    twice = np.repeat(path, 2, axis=1)
    return np.concatenate([twice[:, 1:], twice[:, :-1]], axis=2)


def scaled(path: np.ndarray) -> np.ndarray:
    return np.stack([Windows(path[:, :, c]).z for c in range(path.shape[2])], axis=2)


def signature(path: np.ndarray, depth: int = 3, normalize: bool = True) -> list[np.ndarray]:
    """Levels 1 to ``depth`` (3 at most); a later increment meets only what was summed strictly before it."""
    steps = np.diff(scaled(path) if normalize else path, axis=1)
    n, count, d = steps.shape
    levels = [steps.sum(axis=1)]
    if depth >= 2:
        before = np.cumsum(steps, axis=1) - steps
        levels.append(np.einsum("bti,btj->bij", before, steps))
    if depth >= 3:
        product = np.einsum("bti,btj->btij", before, steps)
        area_before = np.cumsum(product, axis=1) - product
        levels.append(np.einsum("btij,btk->bijk", area_before, steps))
    return [level.reshape(n, -1) for level in levels]


def signature_features(channels: np.ndarray, depth: int = 3, *, time: bool = True, leadlag: bool = False, normalize: bool = True) -> Features:
    """Named terms of the signature of ``[B, T]`` or ``[B, T, d]``."""
    path = channels[:, :, None] if channels.ndim == 2 else channels
    path = with_time(path) if time else path
    path = lead_lag(path) if leadlag else path
    d = path.shape[2]
    out: Features = {}
    for level, terms in enumerate(signature(path, depth, normalize), start=1):
        for at in range(d**level):
            digits = [str(at // d**p % d) for p in reversed(range(level))]
            digits[0] = f"ch{digits[0]}"
            out[f"sig_L{level}_{'_'.join(digits)}"] = terms[:, at]
    return out
