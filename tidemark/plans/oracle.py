"""DuckDB SQL that computes the library's queries independently: windows as lists, features as list expressions."""

from __future__ import annotations

import math

from tidemark.functions.canonical import scales
from tidemark.functions.convolution import kernel_bank
from tidemark.functions.wavelets import taps

T = 20
EPS = "1e-10"

SOURCE = """
e AS (SELECT event_id, user_id, ts, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x, CAST(CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS FLOAT) AS DOUBLE) AS v FROM events),
f AS (
  SELECT event_id, w, u FROM (
    SELECT event_id, list(x) OVER fr AS w, list(v) OVER fr AS u, row_number() OVER s AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e
    WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id), fr AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  ) WHERE rn >= 20 AND n >= 25
),
b AS (SELECT *, list_sum(w) / 20 AS m, list_min(w) AS lo, list_max(w) AS hi, list_sort(w) AS o, [w[i + 1] - w[i] FOR i IN range(1, 20)] AS d FROM f),
c AS (SELECT *, [x - m FOR x IN w] AS xc FROM b),
g AS (SELECT *, list_sum([x * x FOR x IN xc]) AS ss FROM c),
h AS (SELECT *, sqrt(ss / 19) AS sd FROM g),
k AS (SELECT *, [x / greatest(sd, 1e-10) FOR x IN xc] AS z, [list_sum([xc[i] * xc[i + j] FOR i IN range(1, 21 - j)]) / greatest(ss, 1e-10) FOR j IN range(1, 20)] AS acf FROM h)
"""


def total(expr: str, start: int, stop: int) -> str:
    """Sum of an expression in ``i`` over ``start <= i < stop``."""
    return f"list_sum([{expr} FOR i IN range({start}, {stop})])"


def count(condition: str, start: int, stop: int) -> str:
    return total(f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END", start, stop)


def quantile(q: float, values: str = "o", n: int = T) -> str:
    at = q * (n - 1)
    low = int(at)
    high = min(low + 1, n - 1)
    return f"({values}[{low + 1}] + ({values}[{high + 1}] - {values}[{low + 1}]) * {at - low!r})"


def query(columns: dict[str, str], extra: str = "", source: str = "k", digits: int = 4, finer: tuple[str, ...] = ()) -> str:
    """Labels and expressions over the windows, as single-precision values rounded to ``digits`` (one more for those in ``finer``)."""
    listed = ", ".join(f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), {digits + (n in finer)}) + 0.0 AS {n}" for n, v in columns.items())
    return f"WITH {SOURCE}{extra} SELECT event_id, {listed} FROM {source}"


def labels(features: dict[str, str], prefix: str = "value_") -> dict[str, str]:
    """Feature names and plain column labels for them."""
    return {prefix + n: n.replace(".", "p").lower() for n in features}


def renamed(features: dict[str, str]) -> dict[str, str]:
    return {n.replace(".", "p").lower(): v for n, v in features.items()}


def moments() -> dict[str, str]:
    energy = total("w[i] * w[i]", 1, 21)
    out = {
        "ts_mean": "m", "ts_median": "o[10]", "ts_variance": "ss / 19", "ts_std": "sd", "ts_minimum": "lo", "ts_maximum": "hi", "ts_abs_energy": energy,
        "ts_rms": f"sqrt({energy} / 20)", "ts_mean_abs_change": f"{total('abs(d[i])', 1, 20)} / 19", "ts_mean_change": "(w[20] - w[1]) / 19",
        "ts_skewness": f"{total('xc[i] * xc[i] * xc[i]', 1, 21)} / 20 / (sd * sd * sd)", "ts_kurtosis": f"{total('xc[i] * xc[i] * xc[i] * xc[i]', 1, 21)} / 20 / (sd * sd * sd * sd) - 3",
        "ts_iqr": f"{quantile(0.75)} - {quantile(0.25)}", "ts_cv": f"sd / greatest(abs(m), {EPS})", "ts_range": "hi - lo", "ts_mad": f"{total('abs(xc[i])', 1, 21)} / 20",
    }
    return out | {f"ts_quantile_{q}": quantile(q) for q in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)}


def memory() -> dict[str, str]:
    lags = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 15, 20, 25, 30)
    at = lambda j: f"acf[{j}]" if j < 19 else "0"
    out = {f"ts_acf_lag{j}": at(j) for j in lags}
    out |= {f"ts_pacf_lag{j}": " - ".join([at(j), *(f"acf[{a}] * acf[{j - a}]" for a in range(1, j))]) for j in (1, 2, 3, 4)}
    out |= {f"ts_c3_lag{j}": f"{total(f'w[i + {2 * j}] * w[i + {j}] * w[i]', 1, T + 1 - 2 * j)} / {T - 2 * j}" for j in (1, 2, 3)}
    length = f"sqrt({total('d[i] * d[i]', 1, 20)} + {EPS})"
    out |= {"ts_cid_ce": length, "ts_cid_ce_norm": f"{length} / greatest(sd, {EPS})"}
    out |= {f"ts_trev_lag{j}": f"{total(f'w[i + {j}] * w[i + {j}] * w[i] - w[i + {j}] * w[i] * w[i]', 1, T + 1 - j)} / {T - j}" for j in (1, 2, 3)}
    mean = f"({total('acf[i]', 1, 19)} / 18)"
    return out | {"ts_agg_acf_mean": mean, "ts_agg_acf_median": "list_sort(acf[1:18])[9]", "ts_agg_acf_var": f"{total(f'(acf[i] - {mean}) * (acf[i] - {mean})', 1, 19)} / 17"}


#: Real and imaginary parts, power and their total.
SPECTRUM = f""",
sp AS (SELECT *, [list_sum([z[t] * cos(2 * pi() * ((c * (t - 1)) % {T}) / {T}) FOR t IN range(1, 21)]) FOR c IN range(1, 11)] AS re,
  [CASE WHEN c = 10 THEN 0.0 ELSE -list_sum([z[t] * sin(2 * pi() * ((c * (t - 1)) % {T}) / {T}) FOR t IN range(1, 21)]) END FOR c IN range(1, 11)] AS im FROM k),
pw AS (SELECT *, [0.0] || [re[i] * re[i] + im[i] * im[i] FOR i IN range(1, 11)] AS p FROM sp),
pt AS (SELECT *, greatest(list_sum(p), {EPS}) AS pp FROM pw),
ce AS (SELECT *, {total('p[i] * (i - 1)', 1, 12)} / pp AS centre FROM pt),
va AS (SELECT *, {total('p[i] * (i - 1 - centre) * (i - 1 - centre)', 1, 12)} / pp AS width FROM ce)
"""


def spectrum() -> dict[str, str]:
    out = {"ts_fft_abs_0": "0", "ts_fft_real_0": "0", "ts_fft_imag_0": "0", "ts_fft_angle_0": "0"}
    for c in range(1, 11):
        out |= {f"ts_fft_abs_{c}": f"sqrt(p[{c + 1}])", f"ts_fft_real_{c}": f"re[{c}]", f"ts_fft_imag_{c}": f"im[{c}]", f"ts_fft_angle_{c}": f"atan2(im[{c}], re[{c}])"}
    scaled = f"((i - 1 - centre) / sqrt(width + {EPS}))"
    cube, fourth = "p[i] * " + " * ".join([scaled] * 3), "p[i] * " + " * ".join([scaled] * 4)
    out |= {"ts_fft_centroid": "centre", "ts_fft_variance": "width", "ts_fft_skewness": f"{total(cube, 1, 12)} / pp", "ts_fft_kurtosis": f"{total(fourth, 1, 12)} / pp - 3"}
    out |= {f"ts_welch_density_{c}": f"p[{c + 1}] / pp" if c < 11 else "0" for c in (2, 5, 8, 12, 20, 30)}
    out |= {"ts_power_low": f"{total('p[i]', 1, 4)} / pp", "ts_power_mid": f"{total('p[i]', 4, 7)} / pp", "ts_power_high": f"{total('p[i]', 7, 12)} / pp", "ts_peak_freq": "(list_position(p, list_max(p)) - 1) / 11.0"}
    out |= {"ts_zero_crossing": count("w[i] * w[i + 1] < 0", 1, 20), "ts_mean_crossing": count("xc[i] * xc[i + 1] < 0", 1, 20)}
    digits = f"[CAST(floor(greatest(abs(x), {EPS}) / pow(10, floor(log10(greatest(abs(x), {EPS}))))) AS INTEGER) FOR x IN w]"
    seen = f"[len(list_filter({digits}, lambda q: q = y)) / {T}.0 - {1 / 9!r} FOR y IN range(1, 10)]"
    law = [math.log10(1 + 1 / k) for k in range(1, 10)]
    law = [v - sum(law) / 9 for v in law]
    product = " + ".join(f"{seen}[{k + 1}] * {v!r}" for k, v in enumerate(law))
    out["ts_benford_corr"] = f"({product}) / (greatest(sqrt(list_sum([y * y FOR y IN {seen}])), {EPS}) * {math.sqrt(sum(v * v for v in law))!r})"
    return out


def disorder() -> dict[str, str]:
    def matches(m: int, r: float) -> str:
        far = ", ".join(f"abs(z[a + {j}] - z[b + {j}])" for j in range(m))
        # each template meets itself once; centres are one fewer than templates
        return f"(list_sum([list_sum([CASE WHEN greatest({far}) <= {r} THEN 1.0 ELSE 0.0 END FOR a IN range(1, {T - m + 2})]) - 1 FOR b IN range(1, {T - m + 1})]) / {T - m})"

    out = {}
    for name, r in (("ts_sample_entropy", 0.2), ("ts_approx_entropy_r0.1", 0.1), ("ts_approx_entropy_r0.3", 0.3), ("ts_approx_entropy_r0.5", 0.5)):
        out[name] = f"-ln(greatest({matches(3, r)}, {EPS}) / greatest({matches(2, r)}, {EPS}))"
    for order in (3, 5, 7):
        rank = lambda j, n=order: " + ".join(f"(CASE WHEN w[i + {a}] < w[i + {j}] OR (w[i + {a}] = w[i + {j}] AND {a} < {j}) THEN 1 ELSE 0 END)" for a in range(n) if a != j)
        codes = f"[{' + '.join(f'({rank(j)}) * {order**j}' for j in range(order))} FOR i IN range(1, {T - order + 2})]"
        n = T - order + 1
        share = f"(len(list_filter({codes}, lambda q: q = y)) / {n}.0)"
        out[f"ts_perm_entropy_d{order}"] = f"-list_sum([{share} * ln({share} + {EPS}) FOR y IN list_distinct({codes})]) / {math.log(math.factorial(order) + 1e-10)!r}"
    bins = "[least(CAST(floor((x - lo) / (hi - lo) * 10) AS INTEGER), 9) FOR x IN w]"
    share = f"(len(list_filter({bins}, lambda q: q = y)) / {T}.0)"
    out["ts_binned_entropy"] = f"-list_sum([{share} * ln({share}) FOR y IN list_distinct({bins})])"
    for b in (2, 5, 10):
        out[f"ts_fourier_entropy_b{b}"] = f"-{total(f'(p[i] / pp) * ln(p[i] / pp + {EPS})', 1, 12)}"
        out[f"ts_lempel_ziv_b{b}"] = parse_length(b)
    return out


def parse_length(base: int) -> str:
    """Phrases of an incremental parse of the window's bins; the state of the fold is the open phrase, then all closed ones."""
    symbols = f"[CAST(least(CAST(floor((x - lo) / (hi - lo) * {base}) AS INTEGER), {base - 1}) AS VARCHAR) FOR x IN w]"
    still, closed = "split_part(a, '#', 1) || b", "split_part(a, '#', 2)"
    fold = f"list_reduce(['#|'] || {symbols}, lambda a, b: CASE WHEN contains({closed}, '|' || {still} || '|') THEN {still} || '#' || {closed} ELSE '#' || {closed} || {still} || '|' END)"
    return f"(len(string_split(split_part({fold}, '#', 2), '|')) - 2) / {max(T / max(math.log(T + 1, base), 1), 1)!r}"


def slope_of(values: str, n: int, first: int = 1) -> str:
    """Least-squares slope of ``n`` list entries from ``first`` on."""
    return f"({total(f'{values}[i] * (i - {first} - {(n - 1) / 2})', first, first + n)} / {n * (n * n - 1) / 12})"


def trend() -> dict[str, str]:
    slope = slope_of("w", T)
    tt = T * (T * T - 1) / 12
    rest = f"(ss - {slope} * {slope} * {tt})"
    error = f"sqrt(greatest({rest}, 0) / 18 / {tt})"
    out = {
        "ts_trend_slope": slope, "ts_trend_intercept": f"m - {slope} * 9.5", "ts_trend_rvalue": f"sqrt(least(greatest(1 - {rest} / greatest(ss, {EPS}), 0), 1)) * sign({slope})",
        "ts_trend_stderr": error, "ts_trend_pvalue_proxy": f"1 / (1 + abs({slope} / greatest({error}, {EPS})))",
    }
    for length in (5, 10):
        each = f"[{', '.join(slope_of('w', length, 1 + a * length) for a in range(T // length))}]"
        out |= {f"ts_agg_trend_c{length}_slope": f"list_avg({each})", f"ts_agg_trend_c{length}_intercept": f"list_var_samp({each})", f"ts_agg_trend_c{length}_rvalue": f"list_max({each})", f"ts_agg_trend_c{length}_stderr": f"list_min({each})"}
    out |= {f"ts_agg_trend_c50_{n}": "0" for n in ("slope", "intercept", "rvalue", "stderr")}
    return out | {"ts_abs_sum_changes": total("abs(d[i])", 1, 20), "ts_mean_2nd_deriv": "(w[20] - w[19] - w[2] + w[1]) / 18", "ts_adf_ratio": f"list_var_samp(d) / greatest(ss / 19, {EPS})"}


def longest(condition: str, values: str, n: int) -> str:
    """Longest run of entries for which a condition on ``q`` holds, from the gaps between those where it does not."""
    breaks = f"([0] || [i FOR i IN range(1, {n + 1}) IF NOT ({condition.replace('q', f'{values}[i]')})] || [{n + 1}])"
    return f"list_max([{breaks}[j + 1] - {breaks}[j] - 1 FOR j IN range(1, len({breaks}))])"


def peaks(reach: int) -> str:
    return count(f"w[i] = list_max(w[greatest(i - {reach}, 1):least(i + {reach}, {T})])", 1, T + 1)


def counts() -> dict[str, str]:
    again = f"({T} - len(list_distinct(w)))"
    out = {
        "ts_count_above_mean": f"{count('xc[i] > 0', 1, 21)} / 20", "ts_count_below_mean": f"{count('xc[i] < 0', 1, 21)} / 20",
        "ts_first_loc_max": "(list_position(w, hi) - 1) / 20.0", "ts_first_loc_min": "(list_position(w, lo) - 1) / 20.0",
        "ts_last_loc_max": "1 - (list_position(list_reverse(w), hi) - 1) / 20.0", "ts_last_loc_min": "1 - (list_position(list_reverse(w), lo) - 1) / 20.0",
        "ts_longest_above_mean": longest("q > 0", "xc", T), "ts_longest_below_mean": longest("q <= 0", "xc", T),
    }
    out |= {f"ts_ratio_beyond_{r}sigma": f"{count(f'abs(xc[i]) > {r} * greatest(sd, {EPS})', 1, 21)} / 20" for r in (1.0, 1.5, 2.0, 2.5, 3.0)}
    out |= {f"ts_n_peaks_{n}": peaks(n) if n < 10 else "0" for n in (1, 3, 5, 10)}
    return out | {
        "ts_has_duplicate": f"CASE WHEN {again} > 0 THEN 1 ELSE 0 END", "ts_has_dup_max": f"CASE WHEN {count('w[i] = hi', 1, 21)} > 1 THEN 1 ELSE 0 END", "ts_has_dup_min": f"CASE WHEN {count('w[i] = lo', 1, 21)} > 1 THEN 1 ELSE 0 END",
        "ts_pct_reoccurring": f"{again} / CAST(len(list_distinct(w)) AS DOUBLE)", "ts_ratio_unique": "len(list_distinct(w)) / 20.0",
    }


def corridors() -> dict[str, str]:
    out = {}
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        for high in (h for h in (0.2, 0.4, 0.6, 0.8, 1.0) if h > low):
            inside = f"w[i] >= {quantile(low) if low else 'lo'} AND w[i] <= {quantile(high) if high < 1 else 'hi'}"
            n = f"greatest({count(inside, 1, 20)}, 1)"
            for prefix, step in (("", "d[i]"), ("abs_", "abs(d[i])")):
                mean = f"({total(f'CASE WHEN {inside} THEN {step} ELSE 0 END', 1, 20)} / {n})"
                square = total(f"CASE WHEN {inside} THEN {step} * {step} ELSE 0 END", 1, 20)
                out[f"ts_cq_{prefix}mean_ql{low}_qh{high}"] = mean
                out[f"ts_cq_{prefix}var_ql{low}_qh{high}"] = f"greatest({square} / {n} - {mean} * {mean}, 0)"
    for q in (0.0, 0.25, 0.5, 0.75):
        out[f"ts_range_count_{q}_{q + 0.25}"] = f"{count(f'w[i] >= lo + {q} * (hi - lo) AND w[i] < lo + {q + 0.25} * (hi - lo)', 1, 21)} / 20"
    return out


def advanced() -> dict[str, str]:
    shares = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3)
    out = {f"ts_large_std_{r}": f"CASE WHEN sd > {r} * (hi - lo) THEN 1 ELSE 0 END" for r in shares}
    out |= {f"ts_symmetry_{r}": f"CASE WHEN abs(hi - m) < {r} * (hi - lo) THEN 1 ELSE 0 END" for r in shares}
    mass = total("abs(w[i])", 1, 21)
    reached = lambda q: f"[list_sum([abs(y) FOR y IN w[1:i]]) / {mass} >= {q} FOR i IN range(1, 21)]"
    out |= {f"ts_idx_mass_q{q}": f"coalesce((nullif(list_position({reached(q)}, true), 0) - 1) / 20.0, 1)" for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    out |= {f"ts_mean_abs_max_{n}": f"list_avg(list_reverse_sort([abs(y) FOR y IN w])[1:{n}])" for n in (1, 3, 5, 7, 10)}
    energy = total("w[i] * w[i]", 1, 21)
    for parts in (5, 10):
        for f in range(3):
            long = T // parts
            out[f"ts_energy_ratio_s{parts}_f{f}"] = f"{total('w[i] * w[i]', f * long + 1, (f + 1) * long + 1)} / greatest({energy}, {EPS})"
    out |= {f"ts_ar_coeff_{j}": f"acf[{j}]" for j in range(1, 6)}
    out |= {"ts_cwt_peaks_s1": peaks(1), "ts_cwt_peaks_s5": peaks(5)}
    b = slope_of("d", 19)
    out |= {"ts_friedrich_a": f"list_avg(d) - {b} * 9", "ts_friedrich_b": b}
    again = "[y FOR y IN w IF len(list_filter(w, lambda q: q = y)) > 1]"
    return out | {"ts_sum_reoccurring_val": f"coalesce(list_sum({again}), 0)", "ts_sum_reoccurring_dp": f"len({again})", "ts_value_count_0": count("w[i] = 0", 1, 21)}


def efficient(names: list[str]) -> dict[str, str]:
    """The efficient bank: the features it shares with the comprehensive one, and those whose parameters differ."""
    out = moments() | memory() | spectrum() | disorder() | trend() | counts() | corridors() | advanced()
    out |= {f"ts_pacf_lag{j}": " - ".join([f"acf[{j}]", *(f"acf[{a}] * acf[{j - a}]" for a in range(1, j))]) for j in (5, 10)}
    mean = f"({total('acf[i]', 1, 11)} / 10)"
    out |= {"ts_agg_acf_mean": mean, "ts_agg_acf_median": "list_sort(acf[1:10])[5]", "ts_agg_acf_var": f"{total(f'(acf[i] - {mean}) * (acf[i] - {mean})', 1, 11)} / 9"}
    out |= {"ts_approx_entropy_r0.2": out["ts_sample_entropy"], "ts_cwt_peaks_s3": peaks(3)}
    return {n: out[n] for n in names}


def canonical() -> dict[str, str]:
    def mode(n: int) -> str:
        bins = f"[least(CAST(floor((x - lo) / (hi - lo) * {n}) AS INTEGER), {n - 1}) FOR x IN w]"
        sizes = f"[len(list_filter({bins}, lambda q: q = y)) FOR y IN range(0, {n})]"
        return f"lo + (list_position({sizes}, list_max({sizes})) - 0.5) * (hi - lo) / {n}"

    def first(condition: str, start: int, stop: int, otherwise: float, value: str = "i") -> str:
        return f"coalesce(list_min([{value} FOR i IN range({start}, {stop}) IF {condition}]), {otherwise})"

    steps = "(list_sum(d) / 19)"
    thirds = f"[CASE WHEN x > {quantile(0.667)} THEN 2 WHEN x > {quantile(0.333)} THEN 1 ELSE 0 END FOR x IN w]"
    ratio = f"{first('dacf[i] < 0', 2, 19, 1)} / CAST({first('acf[i] < 0', 2, 19, 1)} AS DOUBLE)"
    bin5 = lambda v: f"least(CAST(floor(({v} - {{lo}}) / ({{hi}} - {{lo}}) * 5) AS INTEGER), 4)"
    b1 = bin5("w[i]").format(lo="list_min(w[1:18])", hi="list_max(w[1:18])")
    b2 = bin5("w[i + 2]").format(lo="list_min(w[3:20])", hi="list_max(w[3:20])")
    spread = lambda codes, n: f"-list_sum([(len(list_filter({codes}, lambda q: q = y)) / {n}.0) * ln(len(list_filter({codes}, lambda q: q = y)) / {n}.0) FOR y IN list_distinct({codes})])"
    c1, c2, c12 = f"[{b1} FOR i IN range(1, 19)]", f"[{b2} FOR i IN range(1, 19)]", f"[({b1}) * 5 + {b2} FOR i IN range(1, 19)]"
    gaussian = f"(-0.5 * ln(1 - pow(least(greatest(acf[{{}}], -0.999), 0.999), 2) + {EPS}))"
    deviation = f"sqrt({total('z[i] * z[i]', 1, 21)} / 20)"
    kept = lambda bar: f"[list_median(list_filter(z, lambda q: q {bar} * {deviation} * 0.01 * t)) FOR t IN range(1, 20)]"

    def outliers(bar: str) -> str:
        meds = f"list_filter({kept(bar)}, lambda q: q IS NOT NULL)"
        return f"coalesce(list_median([abs({meds}[j + 1] - {meds}[j]) FOR j IN range(1, len({meds}))]), 0)"

    jump = f"0.4 * greatest(list_stddev_samp([abs(y) FOR y IN d]), {EPS})"
    logs = [math.log(n) for n in scales(T)]
    centre = sum(logs) / len(logs)

    def scaling(measure) -> str:
        values = [f"ln({measure(n)} + {EPS})" for n in scales(T)]
        return "(" + " + ".join(f"{v} * {lg - centre!r}" for v, lg in zip(values, logs, strict=True)) + f") / {sum((lg - centre) ** 2 for lg in logs)!r}"

    def dfa(n: int) -> str:
        parts = []
        for a in range(T // n):
            part = f"profile[{a * n + 1}:{a * n + n}]"
            b = slope_of("profile", n, a * n + 1)
            parts.append(total(f"pow({part}[i] - list_avg({part}) - {b} * (i - {(n + 1) / 2}), 2)", 1, n + 1))
        return f"sqrt(({' + '.join(parts)}) / {T // n * n} + {EPS})"

    def rescaled(n: int) -> str:
        parts = []
        for a in range(T // n):
            part = f"z[{a * n + 1}:{a * n + n}]"
            path = f"[list_sum({part}[1:i]) - i * list_avg({part}) FOR i IN range(1, {n + 1})]"
            parts.append(f"(list_max({path}) - list_min({path})) / greatest(list_stddev_samp({part}), {EPS})")
        return f"(({' + '.join(parts)}) / {T // n})"

    cell = lambda a, b: f"(len(list_filter(pairs, lambda q: q = {3 * a + b})) / greatest(len(list_filter(pairs, lambda q: q // 3 = {a})), 1.0))"
    residual = "[w[i] - (w[i - 1] + w[i - 2] + w[i - 3]) / 3 FOR i IN range(4, 21)]"
    return {
        "DN_HistogramMode_5": mode(5), "DN_HistogramMode_10": mode(10),
        "SB_BinaryStats_diff_longstretch0": longest(f"q <= {steps}", "d", 19), "SB_BinaryStats_mean_longstretch1": longest("q > 0", "xc", T),
        "SB_MotifThree_quantile_hh": "len(list_filter(pairs, lambda q: q = 8)) / 19.0", "FC_LocalSimple_mean1_tauresrat": ratio,
        "CO_Embed2_Dist_tau_expfit_meandiff": f"{total(f'sqrt(pow(z[i + 1] - z[i], 2) + pow(z[i + 2] - z[i + 1], 2) + {EPS})', 1, 19)} / 18",
        "CO_f1ecac": first(f"acf[i] < {1 / math.e!r}", 1, 20, 20), "CO_FirstMin_ac": first("acf[i] > acf[i - 1]", 2, 20, 20, "i - 1"),
        "CO_HistogramAMI_even_2_5": f"{spread(c1, 18)} + {spread(c2, 18)} - ({spread(c12, 18)})", "CO_trev_1_num": f"{total('d[i] * d[i] * d[i]', 1, 20)} / 19",
        "DN_OutlierInclude_p_001_mdrmd": outliers("<= 1"), "DN_OutlierInclude_n_001_mdrmd": outliers(">= -1"),
        "IN_AutoMutualInfoStats_40_gaussian_fmmi": first(f"{gaussian.format('i + 1')} > {gaussian.format('i')}", 1, 18, 19),
        "MD_hrv_classic_pnn40": f"{count(f'abs(d[i]) > {jump}', 1, 20)} / 19", "SC_FluctAnal_2_dfa": scaling(dfa), "SC_FluctAnal_2_rsrangefit": scaling(rescaled),
        "SP_Summaries_welch_rect_area_5_1": f"{total('p[i]', 1, 3)} / pp", "SP_Summaries_welch_rect_centroid": "centre / 11",
        "SB_TransitionMatrix_3ac_sumdiagcov": " + ".join(f"list_var_samp([{', '.join(cell(a, b) for a in range(3))}])" for b in range(3)),
        "PD_PeriodicityWang_th0_01": first("acf[i] > acf[i - 1] AND acf[i] > acf[i + 1] AND acf[i] > 0.01", 2, 18, 0), "FC_LocalSimple_mean3_stderr": f"greatest(list_stddev_samp({residual}), {EPS})",
    } | {"_thirds": thirds}


def canonical_query() -> str:
    found = canonical()
    thirds = found.pop("_thirds")
    step = "(list_sum(d) / 19)"
    extra = SPECTRUM + f""",
t3 AS (SELECT *, {thirds} AS thirds, [y - {step} FOR y IN d] AS dc, [list_sum(z[1:i]) FOR i IN range(1, 21)] AS profile FROM va),
t4 AS (SELECT *, [thirds[i] * 3 + thirds[i + 1] FOR i IN range(1, 20)] AS pairs, [list_sum([dc[i] * dc[i + j] FOR i IN range(1, 20 - j)]) / greatest(list_sum([y * y FOR y IN dc]), {EPS}) FOR j IN range(1, 19)] AS dacf FROM t3)
"""
    return query(renamed(found), extra, "t4")


def signature_terms(d: int, steps: int, depth: int) -> tuple[str, dict[str, str]]:
    """CTEs from the channels ``ch`` of ``s0`` to increments and areas, and the terms of the first ``depth`` levels."""
    extra = f"""
s1 AS (SELECT * EXCLUDE (ch), [[c[i + 1] - c[i] FOR i IN range(1, {steps + 1})] FOR c IN ch] AS dx FROM s0),
s2 AS (SELECT *, [[[coalesce(list_sum(dx[a][1:t - 1]), 0) * dx[b][t] FOR t IN range(1, {steps + 1})] FOR b IN range(1, {d + 1})] FOR a IN range(1, {d + 1})] AS area FROM s1)
"""
    out = {f"sig_L1_ch{a}": f"list_sum(dx[{a + 1}])" for a in range(d)}
    if depth >= 2:
        out |= {f"sig_L2_ch{a}_{b}": f"list_sum(area[{a + 1}][{b + 1}])" for a in range(d) for b in range(d)}
    if depth >= 3:
        third = lambda a, b, c: total(f"coalesce(list_sum(area[{a + 1}][{b + 1}][1:i - 1]), 0) * dx[{c + 1}][i]", 1, steps + 1)
        out |= {f"sig_L3_ch{a}_{b}_{c}": third(a, b, c) for a in range(d) for b in range(d) for c in range(d)}
    return extra, out


def scaled(v: str) -> str:
    return f"[(y - list_avg({v})) / greatest(list_stddev_samp({v}), {EPS}) FOR y IN {v}]"


TIME = "[t / 19.0 FOR t IN range(0, 20)]"


def signature_query(depth: int = 3, digits: int = 4) -> str:
    """Terms of (time, value, volume), scaled, with sums over strictly earlier steps."""
    extra, out = signature_terms(3, 19, depth)
    return query(renamed(out), f",\ns0 AS (SELECT event_id, [{scaled(TIME)}, {scaled('w')}, {scaled('u')}] AS ch FROM f),{extra}", "s2", digits)


def lead_lag_query(depth: int = 2) -> tuple[str, dict[str, str]]:
    """The same with each channel twice, the second a step behind."""
    twice = lambda v, late: scaled(f"[{v}[(i + {late}) // 2 + 1] FOR i IN range(0, 39)]")
    extra, out = signature_terms(6, 38, depth)
    channels = ", ".join(twice(v, late) for late in (1, 0) for v in (f"({TIME})", "w", "u"))
    return query(renamed(out), f",\ns0 AS (SELECT event_id, [{channels}] AS ch FROM f),{extra}", "s2"), out


def vector_signature_query(size: int = 64) -> tuple[str, dict[str, str]]:
    """Terms of (time, value) of the embeddings' arrays, each taken for a window of one channel."""
    extra, out = signature_terms(2, size - 1, 3)
    time = f"[t / {size - 1}.0 FOR t IN range(0, {size})]"
    columns = ", ".join(f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {n.lower()}" for n, v in out.items())
    return f"WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS w FROM embeddings), s0 AS (SELECT vec_id, [{scaled(time)}, {scaled('w')}] AS ch FROM v),{extra} SELECT vec_id, {columns} FROM s2", out


def wavelet_parts(name: str) -> tuple[list[str], dict[str, int], str]:
    """CTEs of the levels, the size of each coefficient list, and the last CTE."""
    low, high = (t.tolist() for t in taps(name))
    n, ctes, sizes, source, current = T, [], {}, "f", "w"
    level = 0
    while level < 4 and n >= 2 * len(low):
        level += 1
        reach = len(low) - 1
        size = (n + 2 * reach - len(low)) // 2 + 1

        def place(j: int, reach: int = reach, n: int = n) -> str:  # 0-based place of a padded value, reflected at both ends
            return f"abs({n - 1} - abs({n - 1} - (2 * (i - 1) + {j} - {reach})))"

        value = lambda t, c=current: " + ".join(f"{c}[{place(j)} + 1] * {t[len(low) - 1 - j]!r}" for j in range(len(low)))
        ctes.append(f"{name}{level} AS (SELECT *, [{value(low)} FOR i IN range(1, {size + 1})] AS {name}_a{level}, [{value(high)} FOR i IN range(1, {size + 1})] AS {name}_d{level} FROM {source})")
        sizes[f"d{level}"] = size
        source, current, n = f"{name}{level}", f"{name}_a{level}", size
    sizes[f"a{level}"] = n
    return ctes, sizes, source


def wavelet_query(name: str, digits: int = 4) -> tuple[str, dict[str, str]]:
    ctes, sizes, source = wavelet_parts(name)
    deep = next(k for k in sizes if k[0] == "a")
    order = [deep, *(f"d{j}" for j in range(int(deep[1:]), 0, -1))]
    energy = {k: total(f"{name}_{k}[i] * {name}_{k}[i]", 1, sizes[k] + 1) for k in order}
    out = {}
    for k in order:
        c, n = f"{name}_{k}", sizes[k]
        p = f"greatest({c}[i] * {c}[i] / greatest({energy[k]}, {EPS}), {EPS})"
        out |= {
            f"wl_{c}_energy": energy[k], f"wl_{c}_mean": f"list_sum({c}) / {n}", f"wl_{c}_std": f"list_stddev_samp({c})",
            f"wl_{c}_max": f"list_max([abs(y) FOR y IN {c}])", f"wl_{c}_entropy": f"-{total(f'{p} * ln({p})', 1, n + 1)}",
        }
    whole = f"greatest({' + '.join(energy.values())}, {EPS})"
    out |= {f"wl_{name}_eratio_{'approx' if k == deep else k}": f"{energy[k]} / {whole}" for k in order}
    level = min(3, int(deep[1:]))
    n = sizes.get(f"d{level}") or sizes[deep]  # an approximation is as long as the detail of its level
    at = [max((i + 0.5) * n / T - 0.5, 0) for i in range(T)]
    cell = lambda k: f"{name}_a{level}[{min(k, n - 1) + 1}]"
    smooth = ", ".join(f"{cell(int(x))} + ({cell(int(x) + 1)} - {cell(int(x))}) * {x - int(x)!r}" for x in at)
    ctes.append(f"sm AS (SELECT *, [{smooth}] AS sm, [y - list_avg(w) FOR y IN w] AS wc FROM {source})")
    ctes.append("sn AS (SELECT *, [y - list_avg(sm) FOR y IN sm] AS sc FROM sm)")
    norm = lambda v: f"sqrt(list_sum([y * y FOR y IN {v}]))"
    out |= {"wl_denoised_corr": f"{total('wc[i] * sc[i]', 1, T + 1)} / ({norm('wc')} * {norm('sc')} + {EPS})", "wl_noise_level": f"list_stddev_samp([w[i] - sm[i] FOR i IN range(1, {T + 1})])"}
    return query(renamed(out), "," + ",\n".join(ctes), "sn", digits), out


def gaps_query() -> str:
    """Moments where every eleventh value is null: a window with a gap has none of them, apart from its mean change."""
    gone = "len(list_filter(w, lambda q: q IS NULL)) > 0"
    found = {n: f"CASE WHEN {gone} THEN {'coalesce((w[20] - w[1]) / 19, 0)' if n == 'ts_mean_change' else '0'} ELSE {v} END" for n, v in moments().items()}
    return query(renamed(found)).replace("CAST(CAST(value AS FLOAT) AS DOUBLE) AS x", "CASE WHEN event_id % 11 <> 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END AS x")


def every_row(sql: str, columns: list[str]) -> str:
    """The features of all events; zero where no full window ends."""
    return f"SELECT r.event_id, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in columns)} FROM events r LEFT JOIN ({sql}) USING (event_id)"


def kernel_query(kernels: int, seed: int = 42) -> tuple[str, dict[str, str]]:
    out = {}
    for k, length, dilation, weights, bias in kernel_bank(T, kernels, seed):
        half = (length - 1) // 2
        y = " + ".join(f"coalesce(CASE WHEN i + {(j - half) * dilation} BETWEEN 1 AND {T} THEN w[i + {(j - half) * dilation}] END, 0) * {w!r}" for j, w in enumerate(weights.tolist()))
        values = f"[{y} + {bias!r} FOR i IN range(1, 21)]"
        n = f"len(list_filter({values}, lambda q: q > 0))"
        mean = f"(coalesce(list_sum(list_filter({values}, lambda q: q > 0)), 0) / greatest({n}, 1))"
        out |= {f"rk_ppv_k{k}": f"{n} / 20.0", f"rk_max_k{k}": f"list_max({values})", f"rk_mean_k{k}": mean, f"rk_mpvs_k{k}": f"{n} / 20.0 * {mean}"}
    return query(renamed(out)), out
