"""The 22 canonical characteristics of a window, in their simplified variants."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from tidemark.functions.context import EPS, Features, Windows, autocorrelation, longest_run, spread_around
from tidemark.functions.statistics import entropy


def first_lag(hit: np.ndarray, start: int, otherwise: float) -> np.ndarray:
    """The first lag of each row, counted from ``start``, at which ``hit`` is true."""
    if not hit.shape[1]:
        return np.full(len(hit), float(otherwise))
    return np.where(hit.any(axis=1), hit.argmax(axis=1) + start, float(otherwise))


def mode(w: Windows, n: int) -> np.ndarray:
    """Centre of the first fullest of ``n`` equal bins."""
    fullest = (w.bins(n)[:, :, None] == np.arange(n)).sum(axis=1).argmax(axis=1)
    return np.where(w.flat, w.low, w.low + (fullest + 0.5) * w.spread / n)


def decay(centred: np.ndarray, lags: int) -> np.ndarray:
    """First lag from 2 on with a negative autocorrelation, else 1.  (A crossing at lag 1 gives the same value.)"""
    return first_lag(autocorrelation(centred, lags)[:, 2:] < 0, 2, 1)


def mutual_information(w: Windows, lag: int = 2, n: int = 5) -> np.ndarray:
    if w.size - lag < 5:
        return np.zeros(w.n)
    pair = Windows(w.x[:, :-lag]).bins(n) * n + Windows(w.x[:, lag:]).bins(n)
    joint = (pair[:, :, None] == np.arange(n * n)).sum(axis=1) / (w.size - lag)
    table = joint.reshape(-1, n, n)
    return entropy(table.sum(axis=2)) + entropy(table.sum(axis=1)) - entropy(joint)


def medians_within(w: Windows, sign: int) -> np.ndarray:
    """Median step between the medians of what stays when values beyond 19 rising thresholds go."""
    z = np.sort(sign * w.z, axis=1)  # for the lower side the mirror image
    deviation = z.std(axis=1)
    found = np.full((w.n, 19), np.nan)
    rows = np.arange(w.n)
    for step in range(1, 20):
        # below a positive bar; mirrored, the values above a negative bar lie below the same one
        kept = (z <= (step * 0.01 * deviation)[:, None]).sum(axis=1)
        some = np.maximum(kept, 1)
        middle = (z[rows, (some - 1) // 2] + z[rows, some // 2]) / 2
        found[:, step - 1] = np.where(kept > 0, sign * middle, np.nan)
    # thresholds rise, so what is empty is empty first: the rest are neighbours
    gaps = np.sort(np.abs(np.diff(found, axis=1)), axis=1)
    many = (~np.isnan(gaps)).sum(axis=1)
    some = np.maximum(many, 1)
    return np.where(many > 0, (gaps[rows, (some - 1) // 2] + gaps[rows, some // 2]) / 2, 0.0)


@lru_cache(maxsize=256)
def scales(size: int) -> tuple[int, ...]:
    """Segment lengths between 4 and a quarter of the window, evenly spaced in single-precision logarithms."""
    longest = size // 4
    if longest < 4:
        return ()
    exponents = np.linspace(np.float32(np.log10(4)), np.float32(np.log10(longest)), min(15, longest - 3), dtype=np.float32)
    return tuple(sorted({int(v) for v in np.float32(10) ** exponents}))


def scaling(w: Windows, series: np.ndarray, measure) -> np.ndarray:
    """Slope of the logarithm of ``measure`` (of segments) against that of the segment length."""
    lengths = [n for n in scales(w.size) if w.size // n >= 1]
    if len(lengths) < 2:
        return np.zeros(w.n)
    values = np.stack([np.log(measure(series[:, : w.size // n * n].reshape(w.n, -1, n)) + EPS) for n in lengths], axis=1)
    logs = np.log(lengths) - np.log(lengths).mean()
    return ((values - values.mean(axis=1, keepdims=True)) * logs).sum(axis=1) / max((logs**2).sum(), EPS)


def detrended(segments: np.ndarray) -> np.ndarray:
    """Root mean square around a line through each segment."""
    t = np.arange(segments.shape[2]) - (segments.shape[2] - 1) / 2
    centred = segments - segments.mean(axis=2, keepdims=True)
    slope = (centred * t).sum(axis=2, keepdims=True) / max((t**2).sum(), EPS)
    return np.sqrt(((centred - slope * t) ** 2).mean(axis=(1, 2)) + EPS)


def rescaled_range(segments: np.ndarray) -> np.ndarray:
    """Range of the summed deviations over the deviation, on average."""
    path = (segments - segments.mean(axis=2, keepdims=True)).cumsum(axis=2)
    return ((path.max(axis=2) - path.min(axis=2)) / np.maximum(segments.std(axis=2, ddof=1), EPS)).mean(axis=1)


def transitions(w: Windows) -> np.ndarray:
    """Variances over the rows of the 3-state transition matrix, summed over its columns."""
    pair = w.thirds[:, :-1] * 3 + w.thirds[:, 1:]
    table = (pair[:, :, None] == np.arange(9)).sum(axis=1).reshape(-1, 3, 3)
    return (table / np.maximum(table.sum(axis=2, keepdims=True), 1)).var(axis=1, ddof=1).sum(axis=1)


def canonical(w: Windows) -> Features:
    """All 22, in their customary order."""
    size, z, acf = w.size, w.z, w.acf
    lags = min(size, 40)
    steps = Windows(w.steps)
    shared = min(size - 1, 40)
    hops = np.diff(w.z, axis=1)
    most = min(40, size - 1)
    gaussian = -0.5 * np.log(1 - np.clip(acf[:, 1 : most + 1], -0.999, 0.999) ** 2 + EPS)
    wang = acf[:, : min(size - 1, 40)]
    jumps = np.abs(w.steps)
    power, total, n = w.power, w.total_power, w.power.shape[1]
    return {
        "DN_HistogramMode_5": mode(w, 5),
        "DN_HistogramMode_10": mode(w, 10),
        "SB_BinaryStats_diff_longstretch0": longest_run(~(steps.centred > 0)),
        "SB_BinaryStats_mean_longstretch1": longest_run(w.centred > 0),
        "SB_MotifThree_quantile_hh": ((w.thirds[:, :-1] == 2) & (w.thirds[:, 1:] == 2)).sum(axis=1) / max(size - 1, 1),
        "FC_LocalSimple_mean1_tauresrat": decay(steps.centred, shared) / np.maximum(decay(w.centred, shared), 1),
        "CO_Embed2_Dist_tau_expfit_meandiff": np.sqrt(hops[:, :-1] ** 2 + hops[:, 1:] ** 2 + EPS).mean(axis=1),
        "CO_f1ecac": first_lag(acf[:, 1:lags] < 1 / np.e, 1, lags),
        "CO_FirstMin_ac": first_lag(acf[:, 2:lags] > acf[:, 1 : lags - 1], 1, lags),
        "CO_HistogramAMI_even_2_5": mutual_information(w),
        "CO_trev_1_num": (w.steps**3).mean(axis=1),
        "DN_OutlierInclude_p_001_mdrmd": medians_within(w, 1),
        "DN_OutlierInclude_n_001_mdrmd": medians_within(w, -1),
        "IN_AutoMutualInfoStats_40_gaussian_fmmi": first_lag(gaussian[:, 1 : most - 1] > gaussian[:, : max(most - 2, 0)], 1, most),
        "MD_hrv_classic_pnn40": (jumps > 0.4 * np.maximum(np.sqrt(spread_around(jumps)), EPS)[:, None]).mean(axis=1),
        "SC_FluctAnal_2_dfa": scaling(w, z.cumsum(axis=1), detrended),
        "SC_FluctAnal_2_rsrangefit": scaling(w, z, rescaled_range),
        "SP_Summaries_welch_rect_area_5_1": power[:, : max(1, n // 5)].sum(axis=1) / total,
        "SP_Summaries_welch_rect_centroid": (power * np.arange(n)).sum(axis=1) / total / n,
        "SB_TransitionMatrix_3ac_sumdiagcov": transitions(w),
        "PD_PeriodicityWang_th0_01": first_lag((wang[:, 2:-1] > wang[:, 1:-2]) & (wang[:, 2:-1] > wang[:, 3:]) & (wang[:, 2:-1] > 0.01), 2, 0),
        "FC_LocalSimple_mean3_stderr": np.maximum(np.sqrt(spread_around(w.x[:, 3:] - sliding_window_view(w.x, 3, axis=1)[:, :-1].mean(axis=2))), EPS) if size >= 4 else np.zeros(w.n),
    }
