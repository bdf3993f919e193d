"""The batch kernels over a stream: each entity's state is its last rows, each full window gives one row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.features import compute
from tidemark.operators.windows import single
from tidemark.spec import FeatureConfig, SeriesSpec, ValidationError


def stream_features(df: DataFrame, spec: SeriesSpec, cfg: FeatureConfig, *, watermark: str | None = None, idle: dt.timedelta | None = None, packed: str = "features") -> DataFrame:
    """``entity, time`` and tiebreak of each window's last row, with all features in one array.

    Rows of a trigger are ordered by time and tiebreak and follow what came before; with a ``watermark``, repeated
    rows within it are dropped.  State per entity: the last ``window - 1`` rows and the number of rows so far.  As in
    batch, a series gives windows once it has ``window + min_extra`` rows; those held back until then come together.
    With ``idle`` (which needs a watermark) an entity's state goes once the watermark is that far beyond its last row;
    rows that come later start a new series.  Without it state stays, a bounded number of rows for each entity.
    """
    if idle and not watermark:
        raise ValidationError("state expires by event time, which needs a watermark")
    known = df.where(F.col(f"`{spec.entity}`").isNotNull())
    if watermark:
        known = known.withWatermark(spec.time, watermark).dropDuplicatesWithinWatermark([spec.entity, *spec.order])
    rows = known.select(*[F.col(f"`{c}`") for c in (spec.entity, *spec.order)], *[single(c).alias(f"v_{c}") for c in spec.numeric])
    keys = [rows.schema[c] for c in (spec.entity, *spec.order)]
    out_schema = T.StructType([*keys, T.StructField(packed, T.ArrayType(T.FloatType()))])
    held = cfg.window + cfg.min_extra
    state_schema = T.StructType([T.StructField("seen", T.LongType()), T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("marks", T.BinaryType())])
    names = [f"v_{c}" for c in spec.numeric]
    zone = "UTC" if isinstance(df.schema[spec.time].dataType, T.TimestampNTZType) else df.sparkSession.conf.get("spark.sql.session.timeZone")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        if state.hasTimedOut:
            state.remove()
            return
        seen, values, marks = state.get if state.exists else (0, [], pickle.dumps([]))
        before = np.array(values, dtype=np.float64).reshape(-1, len(names))
        marks = pickle.loads(marks)
        fresh = pd.concat(list(frames)).sort_values(list(spec.order), kind="stable")
        block = np.concatenate([before, fresh[names].to_numpy(dtype=np.float64)])
        marks = marks + list(fresh[list(spec.order)].itertuples(index=False, name=None))
        first = seen - len(before)  # number of the block's first row in the series
        seen += len(fresh)
        if seen >= held:
            done = max(first + cfg.window, seen - len(fresh) + 1 if seen - len(fresh) >= held else cfg.window)
            ends = np.arange(done - first - 1, len(block))
            views = np.lib.stride_tricks.sliding_window_view(block, cfg.window, axis=0)[ends - cfg.window + 1]
            windows = {c: views[:, j] for j, c in enumerate(spec.numeric)}
            matrix = compute(windows, cfg, spec.channels, spec.signature_channels)[1].astype(np.float32)
            matrix[~np.isfinite(matrix)] = 0
            out = pd.DataFrame([marks[e] for e in ends], columns=list(spec.order))
            out.insert(0, spec.entity, key[0])
            out[packed] = list(matrix)
            yield out
        if idle:
            last = fresh[spec.time].max().tz_localize(zone, ambiguous=True, nonexistent="shift_forward")
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + int(idle.total_seconds() * 1000))
        keep = cfg.window - 1 if seen >= held else len(block)
        state.update((seen, block[len(block) - keep :].ravel().tolist(), pickle.dumps(marks[len(marks) - keep :])))

    return rows.groupBy(spec.entity).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout)
