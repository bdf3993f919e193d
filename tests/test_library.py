"""The relational shell, the orchestrator, sources and streams on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.api import generate_features
from tidemark.functions.features import compute, feature_names
from tidemark.operators import panel, windows
from tidemark.operators.select import select_features
from tidemark.operators.validate import validate, validate_output
from tidemark.plans.engine import attach
from tidemark.sources import pack, read_series, unpack, write_features
from tidemark.spec import FeatureConfig, SeriesSpec, ValidationError
from tidemark.streaming import stream_features

SPEC = SeriesSpec("symbol", "date", ("close",), ("close", "volume"))
SMALL = FeatureConfig(10, ("canonical", "statistics", "signatures"), wide=False, depth=2)


def rows(symbols=("A", "B"), days=40, seed=42):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    out = []
    for s in symbols:
        price = 100 * np.exp(rng.normal(0, 0.02, days).cumsum())
        out += [(s, start + dt.timedelta(days=i), float(p), float(rng.uniform(1e5, 1e7))) for i, p in enumerate(price)]
    return out


SCHEMA = "symbol string, date timestamp, close double, volume double"


@pytest.fixture(scope="module")
def frame(spark):
    extra = [("SHORT", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 1.0, 1.0) for i in range(5)] + [(None, dt.datetime(2024, 1, 1), 2.0, 2.0)]
    return spark.createDataFrame(rows() + extra, SCHEMA)


def expected(days=40):
    table = {}
    data = rows()
    for s in ("A", "B"):
        close = np.float32([r[2] for r in data if r[0] == s]).astype(float)
        volume = np.float32([r[3] for r in data if r[0] == s]).astype(float)
        view = lambda v: np.lib.stride_tricks.sliding_window_view(v, SMALL.window)
        values = compute({"close": view(close), "volume": view(volume)}, SMALL, SPEC.channels, SPEC.signature_channels)[1]
        for i, v in enumerate(values):
            table[s, i + SMALL.window - 1] = v.astype(np.float32)
    return table


@pytest.mark.parametrize("part_rows", [16_384, 12])
def test_attach_keeps_rows_and_cuts_long_series(spark, frame, part_rows):
    out = attach(frame.repartition(3), SPEC, SMALL, packed="f", part_rows=part_rows)
    got = out.collect()
    assert len(got) == 86 and out.columns == [*SCHEMA.replace(" string", "").replace(" timestamp", "").replace(" double", "").split(", "), "f"]
    want, start = expected(), dt.datetime(2024, 1, 1)
    for r in got:
        key = (r.symbol, (r.date - start).days)
        assert np.array_equal(np.float32(r.f), want.get(key, np.zeros(len(r.f), np.float32))), key


def test_orchestrator(spark, frame):
    ohlcv = frame.withColumn("open", F.col("close"))
    out = generate_features(ohlcv, window_sizes=[10], enable_rocket=False, enable_wavelets=False, tsfresh_mode="efficient", signature_depth=2)
    names = feature_names(FeatureConfig(10, ("canonical", "statistics", "signatures"), wide=False, depth=2), ("close",), ("close", "volume"))
    assert out.columns == [*ohlcv.columns, *names] and out.count() == ohlcv.count()
    assert out.where("symbol = 'SHORT'").select(F.sum("`close_ts_mean`")).first()[0] == 0
    assert {t for c, t in out.dtypes if c in names} == {"float"}
    fewer = generate_features(ohlcv, window_sizes=[10], enable_rocket=False, enable_wavelets=False, enable_tsfresh=False, enable_signatures=False)
    assert len(fewer.columns) == len(ohlcv.columns) + 22
    both = generate_features(ohlcv, window_sizes=[10, 12], multi_window=True, enable_rocket=False, enable_wavelets=False, enable_catch22=False, enable_signatures=False, tsfresh_mode="efficient", safe_names=True)
    assert "w10_close_ts_quantile_0p1" in both.columns and "w12_close_ts_quantile_0p1" in both.columns
    some = generate_features(ohlcv, window_sizes=[10], enable_rocket=False, enable_wavelets=False, enable_tsfresh=False, feature_selection="auto", signature_depth=1)
    assert 0 < len(some.columns) - len(ohlcv.columns) < 25
    validate_output(out, list(names)[:50])


def test_validation(spark, frame):
    empty = frame.limit(0)
    for bad in (frame.drop("close"), empty, frame.withColumn("symbol", F.lit(None).cast("string")), frame.withColumn("date", F.lit("x")), frame.withColumn("close", F.lit("a")), frame.withColumn("close", F.lit(float("nan")))):
        with pytest.raises(ValidationError):
            validate(bad, SPEC)
    text = frame.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    assert dict(validate(text, SPEC).dtypes)["date"] == "timestamp"
    with pytest.raises(ValidationError):
        validate_output(frame.withColumn("f", F.lit(float("inf"))), ["f"])


def test_windows(spark, frame):
    out = windows.rolling(frame, SPEC, 10, 4).where("symbol = 'A'").orderBy("date").collect()
    assert [r.row_in_series for r in out] == [10, 14, 18, 22, 26, 30, 34, 38] and all(len(r.close_window) == 10 for r in out)
    assert out[0].close_window[-1] == np.float32(out[0].close)
    assert {r.symbol: r.n_windows for r in windows.boundaries(frame, SPEC, 10).collect()} == {"A": 31, "B": 31, "SHORT": 0}
    multi = windows.rolling_multi(frame, SPEC, [5, 10]).where("symbol = 'SHORT'").orderBy("date").collect()
    assert [r.close_window_5 is None for r in multi] == [True] * 4 + [False] and all(r.close_window_10 is None for r in multi)
    for size, step in ((1, 1), (5, 0)):
        with pytest.raises(ValidationError):
            windows.rolling(frame, SPEC, size, step)


def test_panel(spark, frame):
    dense = panel.to_panel(frame, SPEC)
    got = {r.symbol: r for r in dense.collect()}
    assert {len(r.times) for r in got.values()} == {40} and sum(got["SHORT"].is_valid) == 5 and np.isnan(got["SHORT"].close[7])
    back = panel.from_panel(dense, SPEC)
    assert back.count() == 85 and panel.from_panel(dense, SPEC, masked=False).count() == 85
    assert [len(r.close) for r in panel.per_series(frame, SPEC).orderBy("symbol").collect()] == [40, 40, 5]
    assert panel.panel_bytes(3, 40, 2) == 960


def test_selection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 20))
    x[:, 0] = x[:, 1] = 3.0
    x[:, 3] = x[:, 2] + 1e-3 * x[:, 3]
    x[:5, 15] = np.nan
    x[:40, 16] = np.nan
    names = [f"f.{i}" for i in range(20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in names))
    assert select_features(df, names) == [n for i, n in enumerate(names) if i not in (0, 1, 3, 16)]
    assert select_features(df.limit(0), names) == []


def test_sources(spark, frame, tmp_path):
    known = frame.where("symbol IS NOT NULL")
    for kind in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / kind)
        known.write.format(kind).options(header=True).save(path)
        back = read_series(spark, path, SPEC, kind)
        assert back.columns == ["symbol", "date", "close", "volume"] and back.count() == 85
    with pytest.raises(ValueError, match="unknown format"):
        read_series(spark, "x", SPEC, "xml")
    names = ["a.b", "c"]
    wide = known.withColumn("a.b", F.lit(1.5)).withColumn("c", F.lit(2.0))
    packed = pack(wide, names, "f")
    assert unpack(packed, "f", names).select("`a.b`", "c").first() == (1.5, 2.0)
    write_features(packed, str(tmp_path / "out"), partition_by=["symbol"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 85


def test_stream_gives_what_batch_gives(spark, frame, tmp_path):
    known = frame.where("symbol IS NOT NULL")
    source = tmp_path / "in"
    for k, (low, high) in enumerate(((0, 8), (8, 17), (17, 40))):
        day = F.datediff("date", F.lit("2024-01-01"))
        known.where((day >= low) & (day < high)).coalesce(1).write.mode("append").parquet(str(source / f"b{k}"))
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(source))
    query = stream_features(stream, SPEC, SMALL).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want, start = expected(), dt.datetime(2024, 1, 1)
    got = {(r.symbol, (r.date - start).days): np.float32(r.features) for r in spark.table("streamed").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-5) for k in got)


def test_engines_one_by_one(spark):
    from tidemark.plans.engines import ENGINES, KernelEngine, SignatureEngine, map_windows

    rng = np.random.default_rng(4)
    rows = [(i, None if i == 3 else rng.normal(size=12 if i % 2 else 30).tolist(), rng.normal(size=12 if i % 2 else 30).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, w array<double>, v array<double>").repartition(3)
    for name, kind in ENGINES.items():
        engine = kind(kernels=12)
        got = {r.k: r.features for r in engine.transform(df, "w").collect()}
        assert got[3] is None
        for k, w, _ in rows:
            if w is not None:
                want, names = engine.compute(np.float32([w, w]).astype(float))
                assert np.allclose(got[k], np.float32(want[0]), rtol=1e-5, atol=1e-6) and len(names) == engine.n_features(len(w)), name
    two = SignatureEngine(depth=2)
    assert len(two.transform(df, "w", "v").where("k = 0").first().features) == two.info(2)["features"] == 12
    assert SignatureEngine(leadlag=True, depth=2).info(1)["features"] == 20
    some = KernelEngine(kernels=9, least_variance=0.0)
    flat = np.full((4, 30), 2.0)
    assert some.compute(flat)[0].shape == (4, 0) and KernelEngine(kernels=9).info(spark, 30).agg(F.sum("kernels")).first()[0] == 9
    assert map_windows(df, ["w"], lambda x: x.max(axis=1, keepdims=True)).where("k = 0").first().features[0] == np.float32(max(rows[0][1]))


def test_idle_state_goes(spark, frame, tmp_path):
    known = frame.where("symbol = 'A'").orderBy("date").collect()
    late = [(r.symbol, r.date + dt.timedelta(days=400), r.close, r.volume) for r in known[:6]]
    far = [("Z", known[0].date + dt.timedelta(days=300 + i), 1.0, 1.0) for i in range(2)]
    source = tmp_path / "in"
    for k, part in enumerate(([tuple(r) for r in known], far, far[1:], late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"b{k}"))
    for name, idle in (("kept", None), ("dropped", dt.timedelta(days=30))):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
        query = stream_features(stream, SPEC, SMALL, watermark="1 day", idle=idle).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("kept").where("symbol = 'A'").count() == 31 + 6
    assert spark.table("dropped").where("symbol = 'A'").count() == 31
    with pytest.raises(ValidationError):
        stream_features(frame, SPEC, SMALL, idle=dt.timedelta(days=1))


@pytest.mark.parametrize("part_rows", [16_384, 12])
def test_columns_may_have_any_name(spark, frame, part_rows):
    names = ["n", "e", "s", "p", "h", "E", "part", "opens", "row_number"]
    odd = frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names) if c != "E"])
    out = attach(odd.repartition(3), SPEC, SMALL, packed="f", full="whole", part_rows=part_rows)
    want, start = expected(), dt.datetime(2024, 1, 1)
    got = out.collect()
    assert len(got) == 86 and out.columns == [*odd.columns, "f", "whole"]
    for r in got:
        key = (r.symbol, (r.date - start).days)
        assert r.whole == (key in want) and np.array_equal(np.float32(r.f), want.get(key, np.zeros(len(r.f), np.float32)))
        assert (r.n, r.e, r.s, r.p, r.h) == (0, 1, 2, 3, 4)
    again = attach(out.drop("whole"), SPEC, SMALL, packed="f")
    assert again.columns == [*odd.columns, "f"] and again.count() == 86
    with pytest.raises(ValidationError):
        attach(frame, SPEC, SMALL, packed="close")


def test_windows_longer_than_a_part(spark, frame):
    whole, cut_up = (sorted((r.symbol or "", r.date, r.whole, tuple(r.f)) for r in attach(frame, SPEC, SMALL, packed="f", full="whole", part_rows=n).collect()) for n in (16_384, 3))
    assert whole == cut_up


@pytest.mark.parametrize("part_rows", [3, 12])
def test_native_windows_of_long_series(spark, frame, part_rows):
    for run in (
        lambda n: windows.rolling(frame, SPEC, 10, 4, part_rows=n),
        lambda n: windows.rolling_multi(frame, SPEC, [5, 10], part_rows=n),
        lambda n: windows.window_stats(frame, SPEC, 10, part_rows=n),
    ):
        whole, parts = run(16_384), run(part_rows)
        assert whole.columns == parts.columns and dict(whole.dtypes).keys() == dict(parts.dtypes).keys()
        assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))


def test_panel_takes_the_last_of_repeated_cells(spark, frame):
    spec = SeriesSpec("symbol", "date", ("close",), (), ("k",))
    twice = frame.withColumn("k", F.lit(1)).unionByName(frame.withColumn("k", F.lit(2)).withColumn("close", F.col("close") * 2))
    one = {r.symbol: r.close for r in panel.to_panel(frame.withColumn("close", F.col("close") * 2), SPEC).collect()}
    for r in panel.to_panel(twice, spec).collect():
        assert np.array_equal(r.close, one[r.symbol], equal_nan=True)


def test_several_lengths_in_one_pass(spark, frame):
    settings = {"enable_rocket": False, "enable_wavelets": False, "enable_catch22": False, "tsfresh_mode": "efficient", "signature_depth": 1}
    both = generate_features(frame, window_sizes=[10, 12], multi_window=True, **settings)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    for size in (10, 12):
        one = generate_features(frame, window_sizes=[size], **settings)
        names = [c for c in one.columns if c not in frame.columns]
        a = sorted(str(tuple(r)) for r in one.collect())
        b = sorted(str(tuple(r)) for r in both.select(*frame.columns, *[F.col(f"`w{size}_{n}`") for n in names]).collect())
        assert a == b
    packed = generate_features(frame, window_sizes=[10, 12], multi_window=True, packed="f", **settings)
    assert packed.columns == [*frame.columns, "w10_f", "w12_f"]
