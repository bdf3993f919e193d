"""Queries through the public entry point, and of the shell around the engines: checks, panels, sources, streams, user functions."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.api import generate_features
from tidemark.functions.features import feature_names
from tidemark.operators import panel
from tidemark.operators.select import varying
from tidemark.operators.validate import entities, output_report, validate
from tidemark.plans import oracle
from tidemark.plans.engine import attach
from tidemark.plans.engines import SignatureEngine, map_windows
from tidemark.plans.queries import EVENTS, SELECTED, WINDOW, daily, events, features, measures, rounded, significant
from tidemark.plans.shared import shared_folder
from tidemark.sources import read_series, write_features
from tidemark.spec import FeatureConfig, SeriesSpec, ValidationError
from tidemark.streaming import stream_features

ROLES = {"symbol_col": "user_id", "date_col": "ts", "close_col": "value", "volume_col": "volume", "tiebreak_cols": ["event_id"]}
OFF = dict.fromkeys(("enable_rocket", "enable_catch22", "enable_signatures", "enable_wavelets", "enable_tsfresh"), False)
EFFICIENT = [n.removeprefix("value_") for n in feature_names(FeatureConfig(WINDOW, ("statistics",), wide=False), ("value",), ())]
#: Features whose values often lie halfway between two roundings.
FINER = tuple(n.lower().replace(".", "p") for n in EFFICIENT if "trend" in n)


def label(name: str) -> str:
    return name.replace(".", "p").lower()


def orchestrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The efficient statistical bank through the public entry point, for every row."""
    out = generate_features(events(spark, sf_dir), **ROLES, **OFF | {"enable_tsfresh": True}, tsfresh_mode="efficient", safe_names=True)
    wanted = {f"value_{n}".replace(".", "p"): label(n) for n in EFFICIENT}
    return out.select("event_id", *[significant(F.col(c), 5 if short in FINER else 4).alias(short) for c, short in wanted.items()])


def orchestrator_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two window lengths and a second channel in one pass, in double precision."""
    switches = OFF | {"enable_tsfresh": True, "enable_signatures": True}
    out = generate_features(events(spark, sf_dir), **ROLES, **switches, tsfresh_mode="efficient", signature_depth=1, compute_channels=["value", "volume"], window_sizes=[20, 8], multi_window=True, output_dtype="float64")
    wanted = {f"w{n}_{c}_ts_{f}": f"{c}_{short}_{n}" for n in (20, 8) for c in ("value", "volume") for f, short in (("mean", "mean"), ("maximum", "most"), ("trend_slope", "slope"))}
    return out.select("event_id", *[significant(F.col(c), 4).alias(short) for c, short in wanted.items()], *[significant(F.col(f"w{n}_sig_L1_ch1"), 4).alias(f"level1_{n}") for n in (20, 8)])


def orchestrator_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed form of all engines at their defaults: how many values each row has, and the windows' means among them."""
    out = generate_features(events(spark, sf_dir), **ROLES, packed="features")
    at = feature_names(FeatureConfig(WINDOW), EVENTS.channels, EVENTS.signature_channels).index("value_ts_mean")
    return out.select("event_id", F.size("features").alias("n_features"), significant(F.col("features")[at], 4).alias("mean"))


def orchestrator_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that automatic selection leaves of a signature."""
    rows = events(spark, sf_dir)
    out = generate_features(rows, **ROLES, **OFF | {"enable_signatures": True}, signature_depth=2, feature_selection="auto")
    return spark.createDataFrame([(c.lower(),) for c in out.columns if c not in rows.columns], "name string")


def features_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments where every eleventh value is null."""
    holes = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    cfg = FeatureConfig(WINDOW, ("statistics",), families=("moments",))
    names = feature_names(cfg, EVENTS.channels, ())
    out = attach(holes, EVENTS, cfg, packed="features", full="is_full").where("is_full")
    return out.select("event_id", *[significant(F.col("features")[i], 4).alias(label(n.removeprefix("value_"))) for i, n in enumerate(names)])


def signatures_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of the lead-lag path of time, value and volume."""
    cfg = FeatureConfig(WINDOW, ("signatures",), depth=2, leadlag=True)
    names = feature_names(cfg, (), EVENTS.signature_channels)
    return features(spark, sf_dir, cfg, {n: label(n) for n in names})


def signature_of_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of ready-made windows of one channel."""
    engine = SignatureEngine()
    rows = engine.transform(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    return rows.select("vec_id", *[significant(F.col("features")[i], 3).alias(n.lower()) for i, n in enumerate(engine.names(64))])


def user_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's own on batches of windows: largest value and its place."""
    own = lambda x: np.stack([x.max(axis=1), x.argmax(axis=1)], axis=1)
    rows = map_windows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), ["embedding"], own, "found")
    return rows.select("vec_id", significant(F.col("found")[0], 5).alias("most"), F.col("found")[1].cast("int").alias("place"))


def kernel_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pooled values of 12 kernels that vary by more than one hundredth over all windows."""
    cfg = FeatureConfig(WINDOW, ("kernels",), kernels=12)
    names = feature_names(cfg, EVENTS.channels, ())
    out = attach(events(spark, sf_dir), EVENTS, cfg, full="is_full").where("is_full")
    return spark.createDataFrame([(n.removeprefix("value_"),) for n in varying(out, list(names), 0.01)], "name string")


def panel_unmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows from the panel without its mask: those where a channel has a value."""
    by, spec = daily(spark, sf_dir)
    return panel.from_panel(panel.to_panel(by, spec), spec, masked=False).select("symbol", F.col("date").cast("string").alias("date"), rounded(F.col("close"), 2).alias("close"))


def panel_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of orders by priority and day, where many rows share a cell: the last by key counts."""
    spec = SeriesSpec("o_orderpriority", "o_orderdate", ("o_totalprice",), (), ("o_orderkey",))
    dense = panel.to_panel(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), spec)
    total = F.aggregate(F.filter("o_totalprice", lambda v: ~F.isnan(v)), F.lit(0.0), lambda a, v: a + v)
    return dense.select(F.col("o_orderpriority").alias("symbol"), F.size("times").alias("n_times"), F.size(F.filter("is_valid", lambda v: v)).alias("n_valid"), rounded(total, 2).alias("total"))


def panel_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, and the bytes that a dense panel of two channels would take."""
    rows = events(spark, sf_dir)
    found = entities(rows, EVENTS).first()
    return spark.createDataFrame([(found.n_entities, panel.panel_bytes(found.n_entities, rows.select("ts").distinct().count(), 2))], "n_entities long, n_bytes long")


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which broken inputs are refused."""
    fine = events(spark, sf_dir)
    cases = {
        "fine": fine,
        "no channel": fine.drop("value"),
        "no rows": fine.where("event_id < 0"),
        "no entity": fine.withColumn("user_id", F.lit(None).cast("long")),
        "no time": fine.withColumn("ts", F.lit("never")),
        "text channel": fine.withColumn("value", F.lit("a")),
        "mostly missing": fine.withColumn("value", F.when(F.col("event_id") % 3 == 0, F.col("value"))),
        "half there": fine.withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value"))),
    }
    out = []
    for name, rows in cases.items():
        try:
            validate(rows, EVENTS)
            out.append((name, False))
        except ValidationError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


def output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, infinite cells and cells without a number of some columns."""
    odd = measures(spark, sf_dir).withColumn("ratio", F.try_divide(F.col("l_tax"), F.col("l_discount"))).withColumn("endless", F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")))
    return output_report(odd, [*SELECTED, "endless"])


def source_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written as a partitioned ORC table to the shared folder and read back, by the columns of their roles alone."""
    path = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("year", F.year("o_orderdate"))
    write_features(rows, path, "orc", partition_by=["year"])
    spec = SeriesSpec("o_custkey", "o_orderdate", ("o_totalprice",), (), ("o_orderkey",))
    back = read_series(spark, path, spec, "orc")
    return back.select("o_custkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderkey", F.round(F.col("o_totalprice").cast("double"), 2).alias("o_totalprice"))


def stream_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernels over the events as a stream of files, kept in a table of the shared folder."""
    cfg = FeatureConfig(WINDOW, ("statistics",), families=("moments",))
    spec = SeriesSpec("user_id", "ts", ("value",), (), ("event_id",))
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    out = stream_features(rows, spec, cfg).writeStream.format("parquet").option("checkpointLocation", f"{path}/log").option("path", f"{path}/rows").trigger(availableNow=True).start()
    out.awaitTermination()
    names = feature_names(cfg, ("value",), ())
    wanted = {f"value_ts_{n}": n for n in ("mean", "std", "median", "maximum", "mean_change")}
    return spark.read.parquet(f"{path}/rows").select("event_id", *[significant(F.col("features")[names.index(n)], 4).alias(short) for n, short in wanted.items()])


QUERIES = {
    "orchestrator": orchestrator,
    "orchestrator_windows": orchestrator_windows,
    "orchestrator_packed": orchestrator_packed,
    "orchestrator_selection": orchestrator_selection,
    "features_gaps": features_gaps,
    "signatures_lead_lag": signatures_lead_lag,
    "signature_of_arrays": signature_of_arrays,
    "user_function": user_function,
    "kernel_variance": kernel_variance,
    "panel_unmasked": panel_unmasked,
    "panel_last": panel_last,
    "panel_size": panel_size,
    "validation_errors": validation_errors,
    "output_check": output_check,
    "source_round_trip": source_round_trip,
    "stream_moments": stream_moments,
}

_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
_PAIR = "e AS (SELECT event_id, user_id, ts, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, CAST(CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS FLOAT) AS DOUBLE) AS volume FROM events)"
_DAILY = "d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, CAST(CAST(sum(o_totalprice) AS FLOAT) AS DOUBLE) AS close FROM orders GROUP BY 1, 2)"


def _windows_sql() -> str:
    """Window aggregates of two lengths; the first level of a scaled path is its last value less its first."""
    fit = lambda v, n: f"CASE WHEN rn >= {n} AND n >= {n + 5} THEN round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 4) + 0.0 ELSE 0.0 END"
    out, frames = [], []
    for n in (20, 8):
        frames.append(f"f{n} AS ({_ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
        for c in ("value", "volume"):
            for name, v in {"mean": f"avg({c}) OVER f{n}", "most": f"max({c}) OVER f{n}", "slope": f"regr_slope({c}, rn) OVER f{n}"}.items():
                out.append(f"{fit(v, n)} AS {c}_{name}_{n}")
        out.append(f"{fit(f'(value - first_value(value) OVER f{n}) / greatest(stddev_samp(value) OVER f{n}, 1e-10)', n)} AS level1_{n}")
    return f"WITH {_PAIR}, m AS (SELECT *, row_number() OVER ({_ORDER}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT event_id, {', '.join(out)} FROM m WINDOW {', '.join(frames)}"


def _selection_sql() -> str:
    """Greedy selection by variance and correlation over the terms of a signature."""
    extra, terms = oracle.signature_terms(3, 19, 2)
    names = [n.lower() for n in terms]
    rows = oracle.query(dict(zip(names, terms.values(), strict=True)), f",\ns0 AS (SELECT event_id, [{oracle.scaled(oracle.TIME)}, {oracle.scaled('w')}, {oracle.scaled('u')}] AS ch FROM f),{extra}", "s2", 9)
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(covar_pop({a}, {b}) / (sqrt(greatest(var_pop({a}), 1e-10)) * sqrt(greatest(var_pop({b}), 1e-10)))) AS r FROM m" for i, a in enumerate(names) for b in names[i + 1 :])
    profile = " UNION ALL ".join(f"SELECT '{n}' AS name, {k} AS k, var_samp({n}) AS spread FROM m" for k, n in enumerate(names))
    return f"""WITH RECURSIVE m AS MATERIALIZED ({rows}), p AS ({profile}), c AS ({pairs}), left_over AS (SELECT name, row_number() OVER (ORDER BY k) AS n FROM p WHERE spread > 1e-8),
g AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS kept UNION ALL
  SELECT l.n, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.b = l.name AND list_contains(g.kept, c.a) AND c.r > 0.95) THEN g.kept ELSE list_append(g.kept, l.name) END FROM g JOIN left_over l ON l.n = g.n + 1)
SELECT unnest(kept) AS name FROM (SELECT kept FROM g ORDER BY n DESC LIMIT 1)"""


def _varying_sql() -> str:
    sql, found = oracle.kernel_query(12)
    sql = sql.replace(", 4) + 0.0 AS", ", 9) + 0.0 AS")
    return " UNION ALL ".join([f"WITH m AS MATERIALIZED ({sql}) SELECT '{next(iter(found))}' AS name FROM m HAVING var_samp({next(iter(found))}) > 0.01", *(f"SELECT '{n}' FROM m HAVING var_samp({n}) > 0.01" for n in list(found)[1:])])


_MEASURES = """m AS (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice, CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax, 3.0::DOUBLE AS fixed, l_linenumber FROM lineitem)"""
_EFFICIENT = oracle.renamed(oracle.efficient(EFFICIENT))
_MEAN = oracle.query({"mean": "m"})

ORACLES = {
    "orchestrator": oracle.every_row(oracle.query(_EFFICIENT, oracle.SPECTRUM, "va", finer=FINER), list(_EFFICIENT)),
    "orchestrator_windows": _windows_sql(),
    "orchestrator_packed": f"SELECT r.event_id, 1386 AS n_features, coalesce(mean, 0.0) AS mean FROM events r LEFT JOIN ({_MEAN}) USING (event_id)",
    "orchestrator_selection": _selection_sql(),
    "features_gaps": oracle.gaps_query(),
    "signatures_lead_lag": oracle.lead_lag_query()[0],
    "signature_of_arrays": oracle.vector_signature_query()[0],
    "user_function": "SELECT vec_id, round(CAST(list_max(embedding) AS DOUBLE), 5) + 0.0 AS most, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS place FROM embeddings",
    "kernel_variance": _varying_sql(),
    "panel_unmasked": f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, round(close, 2) + 0.0 AS close FROM d WHERE close IS NOT NULL",
    "panel_last": """WITH l AS (SELECT o_orderpriority AS symbol, o_orderdate, CAST(CAST(max_by(o_totalprice, o_orderkey) AS FLOAT) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)
SELECT symbol, (SELECT CAST(count(DISTINCT o_orderdate) AS INTEGER) FROM orders) AS n_times, CAST(count(*) AS INTEGER) AS n_valid, round(sum(v), 2) + 0.0 AS total FROM l GROUP BY 1""",
    "panel_size": "SELECT count(DISTINCT user_id) AS n_entities, count(DISTINCT user_id) * count(DISTINCT ts) * 2 * 4 AS n_bytes FROM events",
    "validation_errors": "SELECT * FROM (VALUES ('fine', false), ('no channel', true), ('no rows', true), ('no entity', true), ('no time', true), ('text channel', true), ('mostly missing', true), ('half there', false)) AS t(name, refused)",
    "output_check": f"WITH {_MEASURES} SELECT count(*) AS n_rows, count(*) * 8 AS n_cells, count(*) FILTER (l_tax = 0) AS n_infinite, count(*) FILTER (l_linenumber <> 1) AS n_nan FROM m",
    "source_round_trip": "SELECT o_custkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS o_totalprice FROM orders",
    "stream_moments": oracle.query({"mean": "m", "std": "sd", "median": "o[10]", "maximum": "hi", "mean_change": "(w[20] - w[1]) / 19"}),
}
