"""Kernels against slow restatements, and counts of names."""

import math

import numpy as np
import pytest

from tidemark.functions import canonical, context, convolution, paths, statistics, wavelets
from tidemark.functions.features import feature_names
from tidemark.spec import FeatureConfig, ValidationError

RNG = np.random.default_rng(5)


def batches():
    walk = RNG.normal(size=(30, 60)).cumsum(axis=1) + 100
    return {"walk": walk, "short": walk[:, :10], "flat": np.full((5, 40), 42.0), "rising": np.tile(np.arange(50.0), (3, 1)), "ties": RNG.integers(0, 4, size=(20, 30)).astype(float), "far": walk + 1e7, "gaps": np.where(RNG.random((6, 30)) < 0.1, np.nan, 1.0)}


@pytest.mark.parametrize("name", list(batches()))
def test_everything_is_finite_and_named_once(name):
    x = batches()[name]
    w = context.Windows(x)
    with np.errstate(all="ignore"):
        for features in (statistics.bank(w), statistics.bank(w, False), canonical.canonical(w), wavelets.wavelet_features(w), convolution.kernel_features(x, 30), paths.signature_features(np.stack([x, x * 2], axis=2))):
            names, values = context.finite(features)
            assert len(set(names)) == len(names) == values.shape[1] and len(values) == len(x) and np.isfinite(values).all()


@pytest.mark.parametrize(("size", "wide", "many"), [(20, True, 281), (20, False, 178), (60, True, 361), (60, False, 214)])
def test_sizes_of_the_bank(size, wide, many):
    assert len(statistics.bank(context.Windows(RNG.normal(size=(2, size))), wide)) == many
    assert many == (237 + 4 * min(50, size // 2 + 1) if wide else 134 + 4 * min(20, size // 2 + 1))


def test_total_of_all_engines():
    one, two = ("close",), ("close", "volume")
    assert len(feature_names(FeatureConfig(20), one, two)) == 1386
    assert len(feature_names(FeatureConfig(20, wide=False), one, two)) == 1283


def test_phrases_and_patterns():
    def slow_phrases(symbols, base):
        seen, w = set(), ""
        for s in symbols:
            w += str(s)
            if w not in seen:
                seen.add(w)
                w = ""
        return len(seen) / max(len(symbols) / max(math.log(len(symbols) + 1, base), 1), 1)

    def slow_patterns(x, d):
        found = {}
        for i in range(len(x) - d + 1):
            part = x[i : i + d]
            key = tuple(sorted(range(d), key=lambda j: (part[j], j)))
            found[key] = found.get(key, 0) + 1
        n = sum(found.values())
        return -sum(c / n * math.log(c / n + 1e-10) for c in found.values()) / math.log(math.factorial(d) + 1e-10)

    for x in batches().values():
        if np.isnan(x).any():
            continue
        w = context.Windows(x)
        bank = statistics.bank(w)
        for b in (2, 5, 10):
            assert np.allclose(bank[f"ts_lempel_ziv_b{b}"], [slow_phrases(r, b) for r in w.bins(b).tolist()])
        for d in (3, 5, 7):
            assert np.allclose(bank[f"ts_perm_entropy_d{d}"], [slow_patterns(r, d) for r in x.tolist()])


def test_signature_by_loops():
    path = RNG.normal(size=(4, 12, 2))
    one, two, three = paths.signature(path, 3, normalize=False)
    steps = np.diff(path, axis=1)
    for b in range(4):
        for i in range(2):
            assert np.isclose(one[b, i], path[b, -1, i] - path[b, 0, i])
            for j in range(2):
                assert np.isclose(two[b, 2 * i + j], sum(steps[b, s, i] * steps[b, t, j] for t in range(11) for s in range(t)))
                for k in range(2):
                    want = sum(steps[b, r, i] * steps[b, s, j] * steps[b, t, k] for t in range(11) for s in range(t) for r in range(s))
                    assert np.isclose(three[b, 4 * i + 2 * j + k], want)
    assert paths.lead_lag(path).shape == (4, 23, 4) and len(paths.signature_features(path[:, :, 0])) == 14


def test_kernels_by_loops():
    x = RNG.normal(size=(3, 20))
    values = convolution.pooled(x, 15, 7)
    for k, length, dilation, weights, bias in convolution.kernel_bank(20, 15, 7):
        assert abs(weights.sum()) < 1e-9
        for b in range(3):
            y = [bias + sum(weights[j] * x[b, t + (j - length // 2) * dilation] for j in range(length) if 0 <= t + (j - length // 2) * dilation < 20) for t in range(20)]
            up = [v for v in y if v > 0]
            mean = sum(up) / max(len(up), 1)
            assert np.allclose(values[b, k], [len(up) / 20, max(y), mean, len(up) / 20 * mean])
    assert np.array_equal(values, convolution.pooled(x, 15, 7))


def test_wavelets():
    x = RNG.normal(size=(2, 100))
    assert [c.shape[1] for c in wavelets.decompose(x[:, :20], "haar")] == [3, 3, 4, 6, 11]
    assert [c.shape[1] for c in wavelets.decompose(x[:, :20], "db4")] == [14, 14]
    for name in wavelets.LOW:
        low, high = wavelets.taps(name)
        assert np.isclose((low**2).sum(), 1) and np.isclose((high**2).sum(), 1) and abs(low @ high) < 1e-8
    flat = wavelets.decompose(np.full((1, 64), 3.0), "haar", 1)
    assert np.allclose(flat[0], 3 * math.sqrt(2)) and np.allclose(flat[1], 0)
    with pytest.raises(ValueError, match="unknown wavelet"):
        wavelets.decompose(x, "other")


def test_outlier_medians_by_loops():
    def slow(z, sign):
        medians = []
        for step in range(1, 20):
            bar = sign * step * 0.01 * z.std()
            kept = z[z <= bar] if sign > 0 else z[z >= bar]
            if len(kept):
                medians.append(np.median(kept))
        return np.median(np.abs(np.diff(medians))) if len(medians) > 1 else 0.0

    w = context.Windows(batches()["walk"])
    for sign in (1, -1):
        assert np.allclose(canonical.medians_within(w, sign), [slow(z, sign) for z in w.z])
    assert canonical.scales(30) == (4, 5, 6) or canonical.scales(30) == (4, 5, 7)


def test_config_is_checked():
    with pytest.raises(ValidationError):
        FeatureConfig(1)
    with pytest.raises(ValidationError):
        FeatureConfig(20, ("nothing",))


def test_query_of_the_default_bank_by_loops(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = {r.event_id: r.features for r in entry.queries()["features_kernels_default"](spark, sf).collect()}
    series = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").collect():
        series.setdefault(r.user_id, []).append((r.ts, r.event_id, r.value))
    bank, checked = convolution.kernel_bank(20), 0
    assert len(bank) == 250 and len(got) == sum(map(len, series.values()))
    for rows in series.values():
        rows.sort()
        assert len(rows) >= 25
        for end in (18, 19, len(rows) - 1):
            x = np.array([v for _, _, v in rows[max(0, end - 19) : end + 1]], dtype=np.float32).astype(float)
            want = []
            for _, length, dilation, weights, bias in bank:
                places = [[i + (j - (length - 1) // 2) * dilation for j in range(length)] for i in range(20)]
                y = [sum(w * x[p] for w, p in zip(weights, at, strict=True) if 0 <= p < 20) + bias for at in places] if len(x) == 20 else []
                above = [v for v in y if v > 0]
                mean = sum(above) / len(above) if above else 0.0
                want += [len(above) / 20, max(y), mean, len(above) / 20 * mean] if y else [0.0] * 4
            assert len(got[rows[end][1]]) == 1000 and np.allclose(got[rows[end][1]], want, rtol=1e-5, atol=1e-5)
            checked += 1
    assert checked == 3 * len(series)


def test_angles_of_cancelling_waves_are_those_of_sums_in_order():
    """Steps between two levels, as repeated rows make them: some waves vanish but for rounding, and SQL's angle is that of what is left."""
    levels = RNG.normal(size=(300, 2)).astype(np.float32).astype(float) * 100
    x = np.stack([np.where(np.arange(20) < 1 + i % 19, a, b) for i, (a, b) in enumerate(levels)])
    got = statistics.spectrum(context.Windows(x), True)
    for row, w in enumerate(x.tolist()):
        mean = sum_in_order(w) / 20
        xc = [v - mean for v in w]
        z = [v / max(math.sqrt(sum_in_order([v * v for v in xc]) / 19), 1e-10) for v in xc]
        for c in range(1, 11):
            real = sum_in_order([v * math.cos(2 * math.pi * (c * t % 20) / 20) for t, v in enumerate(z)])
            imaginary = 0.0 if c == 10 else -sum_in_order([v * math.sin(2 * math.pi * (c * t % 20) / 20) for t, v in enumerate(z)])
            assert abs(got[f"ts_fft_angle_{c}"][row] - math.atan2(imaginary, real)) < 1e-9, (row, c)


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total
