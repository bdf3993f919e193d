"""The library's own queries over the provided tables, each with DuckDB SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.features import feature_names
from tidemark.operators import panel, windows
from tidemark.operators.select import column_profile, correlations, select_features
from tidemark.plans import oracle
from tidemark.plans.engine import attach
from tidemark.plans.engines import KernelEngine, StatisticsEngine
from tidemark.spec import FeatureConfig, SeriesSpec

WINDOW = 20
EVENTS = SeriesSpec("user_id", "ts", ("value",), ("value", "volume"), ("event_id",))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, with a second channel out of its JSON column."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("volume"))


def rounded(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


def rolling_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native window aggregates: mean, deviation, extremes, lower median and slope of each full window."""
    spec = SeriesSpec("user_id", "ts", ("value",), (), ("event_id",))
    stats = windows.statistics(spec, WINDOW)
    out = windows.over_series(events(spark, sf_dir), spec, WINDOW, lambda w: stats(w) | {"slope": windows.slope(w, "value", WINDOW)})
    full = (F.col("row_in_series") >= WINDOW) & (F.col("series_rows") >= WINDOW + 5)
    labels = {"value_mean": "mean", "value_std": "std", "value_min": "low", "value_max": "high", "value_median": "median", "slope": "slope"}
    return out.where(full).select("event_id", *[rounded(F.col(c)).alias(label) for c, label in labels.items()])


def window_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third window of 20, by its sum and ends."""
    spec = SeriesSpec("user_id", "ts", ("value",), (), ("event_id",))
    out = windows.rolling(events(spark, sf_dir), spec, WINDOW, 3)
    w = F.col("value_window")
    return out.select("event_id", rounded(F.aggregate(w, F.lit(0.0), lambda a, v: a + v)).alias("total"), rounded(w[0]).alias("oldest"), rounded(w[WINDOW - 1]).alias("newest"))


def window_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 5, 20 and 60 of one sort, by their sizes and first values."""
    spec = SeriesSpec("user_id", "ts", ("value",), (), ("event_id",))
    out = windows.rolling_multi(events(spark, sf_dir), spec, [5, 20, 60])
    each = [c for n in (5, 20, 60) for c in (F.size(f"value_window_{n}").alias(f"n_{n}"), rounded(F.col(f"value_window_{n}")[0]).alias(f"first_{n}"))]
    return out.select("event_id", *each)


def window_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows per customer over orders, where nearly all series are short."""
    spec = SeriesSpec("o_custkey", "o_orderdate", ("o_totalprice",), (), ("o_orderkey",))
    return windows.boundaries(spark.read.parquet(f"{sf_dir}/orders.parquet"), spec, 5, 2, 8)


def window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, extremes and median per channel over lineitem, with an explicit order among equal dates."""
    spec = SeriesSpec("l_suppkey", "l_shipdate", ("l_quantity",), (), ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    out = windows.window_stats(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spec, 10)
    stats = [rounded(F.col(f"l_quantity_{s}"), 5).alias(s) for s in ("mean", "std", "min", "max", "median")]
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), *[rounded(F.sum(s), 3).alias(f"sum_{n}") for s, n in zip(stats, ("mean", "std", "min", "max", "median"), strict=True)])


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one aggregate behind all data checks."""
    from tidemark.operators.validate import report

    return report(events(spark, sf_dir), EVENTS)


def daily(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, SeriesSpec]:
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    by = raw.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("close"))
    return by, SeriesSpec("symbol", "date", ("close",), ())


def panel_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel of daily sums: times, valid cells and their sum per entity."""
    by, spec = daily(spark, sf_dir)
    dense = panel.to_panel(by, spec)
    valid = F.size(F.filter("is_valid", lambda v: v))
    total = F.aggregate(F.filter("close", lambda v: ~F.isnan(v)), F.lit(0.0), lambda a, v: a + v)
    return dense.select("symbol", F.size("times").alias("n_times"), valid.alias("n_valid"), rounded(total, 2).alias("total"))


def panel_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the panel back to long rows."""
    by, spec = daily(spark, sf_dir)
    return panel.from_panel(panel.to_panel(by, spec), spec).select("symbol", F.col("date").cast("string").alias("date"), rounded(F.col("close"), 2).alias("close"))


def series_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in order, by length, first and last."""
    spec = SeriesSpec("user_id", "ts", ("value",), (), ("event_id",))
    v = F.col("value")
    return panel.per_series(events(spark, sf_dir), spec).select("user_id", F.size(v).cast("long").alias("n"), rounded(F.element_at(v, 1)).alias("first"), rounded(F.element_at(v, -1)).alias("last"))


def features(spark: SparkSession, sf_dir: str, cfg: FeatureConfig, wanted: dict[str, str], digits: int = 4) -> DataFrame:
    """``wanted`` (name: label) features of every full window, from the packed form."""
    names = feature_names(cfg, EVENTS.channels, EVENTS.signature_channels)
    at = {n: i for i, n in enumerate(names)}
    full = attach(events(spark, sf_dir), EVENTS, cfg, packed="features", full="is_full").where("is_full")
    return full.select("event_id", *[significant(F.col("features")[at[n]], digits).alias(label) for n, label in wanted.items()])


def significant(column, digits: int):
    """Single-precision values, rounded to a number of decimals that they can hold."""
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def engine_on_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistical engine on ready-made windows: the embeddings' arrays, of 64 values each."""
    engine = StatisticsEngine(wide=False)
    at = {n: i for i, n in enumerate(engine.names(64))}
    rows = engine.transform(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    wanted = {"ts_mean": "mean", "ts_std": "std", "ts_median": "median", "ts_abs_energy": "energy", "ts_range": "spread", "ts_abs_sum_changes": "changes"}
    return rows.select("vec_id", *[significant(F.col("features")[at[n]], 4).alias(label) for n, label in wanted.items()])


def kernel_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernels of the default bank by length."""
    return KernelEngine().info(spark, WINDOW).select("length", "kernels", "least_dilation", "most_dilation")


def short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: nearly all series are too short, and all their rows stay, with zeros."""
    spec = SeriesSpec("o_custkey", "o_orderdate", ("o_totalprice",), (), ("o_orderkey",))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    cfg = FeatureConfig(5, engines=("statistics",), families=("moments",))
    names = feature_names(cfg, spec.channels, ())
    value = lambda n: F.round(F.col("f")[names.index(f"o_totalprice_{n}")].cast("double"), 1)
    return attach(rows, spec, cfg, packed="f").select("o_orderkey", value("ts_mean").alias("mean"), value("ts_maximum").alias("most"))


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier, cut into overlapping parts of 256 rows: the same windows as in one piece."""
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    spec = SeriesSpec("l_suppkey", "l_shipdate", ("l_quantity",), (), order)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", *order, F.col("l_quantity").cast("double").alias("l_quantity"))
    cfg = FeatureConfig(10, engines=("statistics",), families=("moments",))
    names = feature_names(cfg, spec.channels, ())
    out = attach(rows, spec, cfg, packed="f", part_rows=256)
    total = lambda n: F.round(F.sum(F.round(F.col("f")[names.index(f"l_quantity_{n}")].cast("double"), 3)), 2) + F.lit(0.0)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), total("ts_mean").alias("mean"), total("ts_minimum").alias("least"), total("ts_median").alias("median"))


SELECTED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "twice", "fixed", "holes")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    number = lambda c: F.col(c).cast("double")
    extra = {"twice": number("l_extendedprice") * 2 + number("l_tax"), "fixed": F.lit(3.0), "holes": F.when(F.col("l_linenumber") == 1, number("l_tax")).otherwise(F.lit(float("nan")))}
    return raw.select(*[number(c).alias(c) for c in SELECTED[:4]], *[v.alias(n) for n, v in extra.items()])


def selection_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing share and variance by column."""
    rows = [(n, gone, spread) for n, (gone, spread) in zip(SELECTED, column_profile(measures(spark, sf_dir), list(SELECTED)), strict=True)]
    return spark.createDataFrame(rows, "name string, missing double, variance double").select("name", rounded(F.col("missing")).alias("missing"), F.round("variance", 1).alias("variance"))


def selection_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all pairs of columns that vary."""
    names = list(SELECTED[:5])
    matrix = correlations(measures(spark, sf_dir), names)
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", rounded(F.col("r"), 5).alias("r"))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that are kept."""
    return spark.createDataFrame([(n,) for n in select_features(measures(spark, sf_dir), list(SELECTED))], "name string")


def family(name: str, found: dict[str, str], cfg: FeatureConfig, prefix: str = "value_", digits: int = 4):
    """The query of one family of features, under the labels that its SQL uses."""
    wanted = oracle.labels({n: "" for n in found}, prefix)
    return lambda spark, sf_dir: features(spark, sf_dir, cfg, wanted, digits)


def features_kernels_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kernels of the default bank with all poolings, packed, for every row; too many for SQL, so a test holds them against loops."""
    out = attach(events(spark, sf_dir), EVENTS, FeatureConfig(WINDOW, ("kernels",)), packed="features")
    return out.select("event_id", "features")


def _families() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in ("moments", "memory", "spectrum", "disorder", "trend", "counts", "corridors", "advanced"):
        found = getattr(oracle, name)()
        extra, source = (oracle.SPECTRUM, "va") if name in ("spectrum", "disorder") else ("", "k")
        digits = 5 if name == "trend" else 4  # means of slopes of two-digit values often end in a five at the fifth digit
        queries[f"features_{name}"] = family(name, found, FeatureConfig(WINDOW, engines=("statistics",), families=(name,)), digits=digits)
        sql[f"features_{name}"] = oracle.query(oracle.renamed(found), extra, source, digits)
    found = oracle.canonical()
    del found["_thirds"]
    queries["features_canonical"] = family("canonical", found, FeatureConfig(WINDOW, ("canonical",)))
    sql["features_canonical"] = oracle.canonical_query()
    cfg = FeatureConfig(WINDOW, ("signatures",))
    names = {n: "" for n in feature_names(cfg, EVENTS.channels, EVENTS.signature_channels)}
    queries["features_signatures"] = family("signatures", names, cfg, "")
    sql["features_signatures"] = oracle.signature_query()
    for wavelet in ("haar", "db2", "db4", "sym4"):
        sql[f"features_wavelet_{wavelet}"], found = oracle.wavelet_query(wavelet)
        queries[f"features_wavelet_{wavelet}"] = family(wavelet, found, FeatureConfig(WINDOW, ("wavelets",), wavelets=(wavelet,)))
    sql["features_kernels"], found = oracle.kernel_query(12)
    queries["features_kernels"] = family("kernels", found, FeatureConfig(WINDOW, ("kernels",), kernels=12))
    return queries, sql


_Q, _S = _families()
_EVENTS = "e AS (SELECT event_id, user_id, ts, CAST(CAST(value AS FLOAT) AS DOUBLE) AS x FROM events)"
_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"

QUERIES = {
    "rolling_slice": rolling_slice,
    "window_step": window_step,
    "window_multi": window_multi,
    "window_boundaries": window_boundaries,
    "window_statistics": window_statistics,
    "validation": validation,
    "panel_dense": panel_dense,
    "panel_round_trip": panel_round_trip,
    "series_arrays": series_arrays,
    "short_series": short_series,
    "long_series": long_series,
    "engine_on_arrays": engine_on_arrays,
    "kernel_info": kernel_info,
    "features_kernels_default": features_kernels_default,
    "selection_profile": selection_profile,
    "selection_correlations": selection_correlations,
    "selection": selection,
    **_Q,
}
_DAILY = "d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, CAST(CAST(sum(o_totalprice) AS FLOAT) AS DOUBLE) AS close FROM orders GROUP BY 1, 2)"
_MEASURES = """m AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax,
  CAST(l_extendedprice AS DOUBLE) * 2 + CAST(l_tax AS DOUBLE) AS twice, 3.0::DOUBLE AS fixed, CASE WHEN l_linenumber = 1 THEN CAST(l_tax AS DOUBLE) END AS holes FROM lineitem)"""
_PAIRS = [(a, b) for i, a in enumerate(SELECTED[:5]) for b in SELECTED[i + 1 : 5]]
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS name, 1 - count({c}) / count(*)::DOUBLE AS gone, var_samp({c}) AS spread, {k} AS k FROM m" for k, c in enumerate(SELECTED))
ORACLES = {
    "engine_on_arrays": """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS w FROM embeddings)
SELECT vec_id, """ + ", ".join(f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {n}" for n, v in {"mean": "list_avg(w)", "std": "list_stddev_samp(w)", "median": "list_sort(w)[32]", "energy": "list_sum([x * x FOR x IN w])", "spread": "list_max(w) - list_min(w)", "changes": "list_sum([abs(w[i + 1] - w[i]) FOR i IN range(1, 64)])"}.items()) + " FROM e",
    "short_series": """WITH e AS (SELECT o_orderkey, o_custkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS x, o_orderdate FROM orders),
w AS (SELECT o_orderkey, avg(x) OVER f AS mean, max(x) OVER f AS most, row_number() OVER s AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM e
  WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT o_orderkey, round(CASE WHEN rn >= 5 AND n >= 10 THEN CAST(CAST(mean AS FLOAT) AS DOUBLE) ELSE 0.0 END, 1) AS mean, round(CASE WHEN rn >= 5 AND n >= 10 THEN most ELSE 0.0 END, 1) AS most FROM w""",
    "long_series": """WITH e AS (SELECT l_suppkey, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS x, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
w AS (SELECT l_suppkey, row_number() OVER s AS rn, avg(x) OVER f AS mean, min(x) OVER f AS least, quantile_disc(x, 0.5) OVER f AS median FROM e
  WINDOW s AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice), f AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT l_suppkey, count(*) AS n, round(sum(CASE WHEN rn >= 10 THEN round(mean, 3) ELSE 0 END), 2) + 0.0 AS mean, round(sum(CASE WHEN rn >= 10 THEN least ELSE 0 END), 2) + 0.0 AS least, round(sum(CASE WHEN rn >= 10 THEN median ELSE 0 END), 2) + 0.0 AS median FROM w GROUP BY 1""",
    "kernel_info": "SELECT * FROM (VALUES (7, 84::BIGINT, 1, 2), (9, 83::BIGINT, 1, 1), (11, 83::BIGINT, 1, 1)) AS t(length, kernels, least_dilation, most_dilation)",
    "selection_profile": f"WITH {_MEASURES} SELECT name, round(gone, 6) + 0.0 AS missing, round(spread, 1) AS variance FROM ({_PROFILE})",
    "selection_correlations": f"WITH {_MEASURES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) + 0.0 AS r FROM m" for a, b in _PAIRS),
    "selection": f"""WITH RECURSIVE {_MEASURES}, p AS ({_PROFILE}), c AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a}, {b})) AS r FROM m" for a, b in _PAIRS)}),
left_over AS (SELECT name, row_number() OVER (ORDER BY k) AS n FROM p WHERE gone <= 0.5 AND spread > 1e-8),
g AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS kept UNION ALL
  SELECT l.n, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.b = l.name AND list_contains(g.kept, c.a) AND c.r > 0.95) THEN g.kept ELSE list_append(g.kept, l.name) END FROM g JOIN left_over l ON l.n = g.n + 1)
SELECT unnest(kept) AS name FROM (SELECT kept FROM g ORDER BY n DESC LIMIT 1)""",
    "rolling_slice": f"""WITH {_EVENTS}, n AS (SELECT *, row_number() OVER ({_ORDER}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e),
w AS (SELECT *, avg(x) OVER f AS mean, stddev_samp(x) OVER f AS std, min(x) OVER f AS low, max(x) OVER f AS high, quantile_disc(x, 0.5) OVER f AS median, regr_slope(x, rn) OVER f AS slope
  FROM n WINDOW f AS ({_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(median, 6) + 0.0 AS median, round(slope, 6) + 0.0 AS slope FROM w WHERE rn >= 20 AND n >= 25""",
    "window_step": f"""WITH {_EVENTS}, w AS (SELECT event_id, row_number() OVER s AS rn, sum(x) OVER f AS total, first_value(x) OVER f AS oldest, x AS newest
  FROM e WINDOW s AS ({_ORDER}), f AS ({_ORDER} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, round(total, 6) + 0.0 AS total, round(oldest, 6) + 0.0 AS oldest, round(newest, 6) + 0.0 AS newest FROM w WHERE rn >= 20 AND (rn - 20) % 3 = 0""",
    "window_multi": f"""WITH {_EVENTS}, n AS (SELECT *, row_number() OVER ({_ORDER}) AS rn FROM e)
SELECT event_id, {', '.join(f"CASE WHEN rn >= {k} THEN {k} END AS n_{k}, CASE WHEN rn >= {k} THEN round(lag(x, {k - 1}) OVER ({_ORDER}), 6) + 0.0 END AS first_{k}" for k in (5, 20, 60))} FROM n""",
    "window_boundaries": "SELECT o_custkey, count(*) AS series_rows, CASE WHEN count(*) >= 8 THEN (count(*) - 5) // 2 + 1 ELSE 0 END AS n_windows FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1",
    "window_statistics": """WITH e AS (SELECT l_suppkey, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS x, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
w AS (SELECT l_suppkey, row_number() OVER s AS rn, avg(x) OVER f AS mean, stddev_samp(x) OVER f AS std, min(x) OVER f AS low, max(x) OVER f AS high, quantile_disc(x, 0.5) OVER f AS median FROM e
  WINDOW s AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice), f AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT l_suppkey, count(*) AS n, round(sum(round(mean, 5)), 3) + 0.0 AS sum_mean, round(sum(round(std, 5)), 3) + 0.0 AS sum_std, round(sum(low), 3) + 0.0 AS sum_min, round(sum(high), 3) + 0.0 AS sum_max, round(sum(median), 3) + 0.0 AS sum_median
FROM w WHERE rn >= 10 GROUP BY 1""",
    "validation": """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)
SELECT count(*) AS n_rows, count(user_id) AS n_entity, count(ts) AS n_time, avg(CASE WHEN value IS NULL OR isnan(value) THEN 1.0 ELSE 0.0 END) AS missing_value, avg(CASE WHEN volume IS NULL OR isnan(volume) THEN 1.0 ELSE 0.0 END) AS missing_volume FROM e""",
    "panel_dense": f"WITH {_DAILY} SELECT symbol, (SELECT CAST(count(DISTINCT date) AS INTEGER) FROM d) AS n_times, CAST(count(*) AS INTEGER) AS n_valid, round(sum(close), 2) + 0.0 AS total FROM d GROUP BY 1",
    "panel_round_trip": f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, round(close, 2) + 0.0 AS close FROM d",
    "series_arrays": f"""WITH {_EVENTS}, n AS (SELECT user_id, list(x ORDER BY ts, event_id) AS v FROM e GROUP BY 1) SELECT user_id, CAST(len(v) AS BIGINT) AS n, round(v[1], 6) + 0.0 AS first, round(v[-1], 6) + 0.0 AS last FROM n""",
    **_S,
}
