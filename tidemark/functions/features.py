"""All engines on one batch of windows, and the names of what they give."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from tidemark.functions.canonical import canonical
from tidemark.functions.context import Windows, finite
from tidemark.functions.convolution import kernel_features
from tidemark.functions.paths import signature_features
from tidemark.functions.statistics import bank
from tidemark.functions.wavelets import wavelet_features
from tidemark.spec import FeatureConfig


def channel_features(w: Windows, cfg: FeatureConfig, engine: str) -> tuple[list[str], np.ndarray]:
    """Names and matrix of one engine on one channel."""
    with np.errstate(all="ignore"):
        return finite(
            {
                "kernels": lambda: kernel_features(w.x, cfg.kernels, cfg.seed),
                "canonical": lambda: canonical(w),
                "wavelets": lambda: wavelet_features(w, cfg.wavelets, cfg.levels),
                "statistics": lambda: bank(w, cfg.wide, coefficients=cfg.coefficients, lags=cfg.lags, families=cfg.families),
            }[engine]()
        )


def path_features(channels: np.ndarray, cfg: FeatureConfig) -> tuple[list[str], np.ndarray]:
    with np.errstate(all="ignore"):
        return finite(signature_features(channels, cfg.depth, time=cfg.time_augment, leadlag=cfg.leadlag, normalize=cfg.normalize))


def compute(windows: dict[str, np.ndarray], cfg: FeatureConfig, channels: tuple[str, ...], signature_channels: tuple[str, ...]) -> tuple[list[str], np.ndarray]:
    """Names and ``[B, N]`` of all wanted features, from ``[B, T]`` by channel."""
    names: list[str] = []
    parts: list[np.ndarray] = []
    for channel in channels:
        w = Windows(windows[channel])
        for engine in ("kernels", "canonical", "wavelets", "statistics"):
            if engine in cfg.engines:
                own, values = channel_features(w, cfg, engine)
                names += [f"{channel}_{n}" for n in own]
                parts.append(values)
    if "signatures" in cfg.engines:
        own, values = path_features(np.stack([windows[c] for c in signature_channels], axis=2), cfg)
        names += own
        parts.append(values)
    return names, np.concatenate(parts, axis=1) if parts else np.zeros((0, 0))


@lru_cache(maxsize=256)
def feature_names(cfg: FeatureConfig, channels: tuple[str, ...], signature_channels: tuple[str, ...]) -> tuple[str, ...]:
    """The names alone; they depend on the configuration, not on data."""
    probe = np.arange(2.0 * cfg.window).reshape(2, cfg.window)
    names, _ = compute(dict.fromkeys((*channels, *signature_channels), probe), cfg, channels, signature_channels)
    return tuple(names)
