"""Features appended to every row: one shuffle by entity, then vectorised kernels over Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.features import compute, feature_names
from tidemark.operators.series import HALO, PART, PART_ROWS, ROW, TOTAL, long_series, parted, without
from tidemark.spec import FeatureConfig, SeriesSpec, ValidationError

#: Windows in one step of the kernels.
STEP = 2048


def _floats(column) -> np.ndarray:
    """A channel in single precision, held as double; null becomes NaN."""
    return pc.cast(column, pa.float32(), safe=False).to_numpy(zero_copy_only=False).astype(np.float64)


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a series begins: the first row, and every row whose key differs from the one before; null keys stand alone."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key))
        changed = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)), True)
        new[1:] |= changed.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def full_windows(batch: pa.RecordBatch, keys: list[str], spec: SeriesSpec, cfg: FeatureConfig) -> np.ndarray:
    """Which rows of ordered whole series (or parts) end a full window of a series that is long enough."""
    starts = _starts(batch, keys)
    sizes = np.diff(np.r_[starts, batch.num_rows])
    place = batch.schema.get_field_index(TOTAL)
    rows = batch.column(place).to_numpy() if place >= 0 else np.repeat(sizes, sizes)
    known = ~batch.column(batch.schema.get_field_index(spec.entity)).is_null().to_numpy(zero_copy_only=False)
    at = np.arange(batch.num_rows) - np.repeat(starts, sizes)
    return known & (at >= cfg.window - 1) & (rows >= cfg.window + cfg.min_extra)


def features_of(batch: pa.RecordBatch, full: np.ndarray, spec: SeriesSpec, cfg: FeatureConfig, width: int) -> np.ndarray:
    """``[rows, features]``, many series at a time; zero where no full window ends."""
    out = np.zeros((batch.num_rows, width), dtype=np.float32)
    ends = np.flatnonzero(full)
    if not len(ends):
        return out
    views = {c: np.lib.stride_tricks.sliding_window_view(_floats(batch.column(batch.schema.get_field_index(c))), cfg.window) for c in spec.numeric}
    for start in range(0, len(ends), STEP):
        chosen = ends[start : start + STEP]
        values = compute({c: v[chosen - cfg.window + 1] for c, v in views.items()}, cfg, spec.channels, spec.signature_channels)[1]
        with np.errstate(over="ignore"):
            narrow = values.astype(np.float32)
        narrow[~np.isfinite(narrow)] = 0.0
        out[chosen] = narrow
    return out


def attach(df: DataFrame, spec: SeriesSpec, cfg: FeatureConfig, *, packed: str | None = None, full: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` with all features, as columns of single precision or, with ``packed``, as one array column of that name.

    ``full`` names a further column that tells rows with a full window from the others, so that nothing has to number
    the rows again.  Rows of a null entity, of short series and before the first full window stay, with zeros.  Series
    with more than ``part_rows`` rows (found by a count of the entity column alone) are numbered by range partitions
    and cut, so no task ever holds a whole long series.  A column of ``df`` that has a feature's name is replaced.
    """
    return attach_all(df, spec, {"": cfg}, packed=packed, full=full, part_rows=part_rows)


def attach_all(df: DataFrame, spec: SeriesSpec, configs: dict[str, FeatureConfig], *, packed: str | None = None, full: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``attach`` of several configurations at once: one shuffle and one sort for all, names after their prefix."""
    names = {prefix: feature_names(cfg, spec.channels, spec.signature_channels) for prefix, cfg in configs.items()}
    added: list[T.StructField] = []
    for prefix in configs:
        added += [T.StructField(prefix + packed, T.ArrayType(T.FloatType(), False))] if packed else [T.StructField(prefix + n, T.FloatType()) for n in names[prefix]]
        added += [T.StructField(prefix + full, T.BooleanType())] if full else []
    fresh = {f.name for f in added}
    if taken := fresh & {spec.entity, *spec.order, *spec.numeric}:
        raise ValidationError(f"features would take the names of input columns: {', '.join(sorted(taken)[:10])}")
    df = without(df, fresh)
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *added])
    entity = F.col(f"`{spec.entity}`")
    widest = max(cfg.window for cfg in configs.values())

    def finished(batch: pa.RecordBatch, keys: list[str]):
        if not batch.num_rows:
            return
        ends = {prefix: full_windows(batch, keys, spec, cfg) for prefix, cfg in configs.items()}
        place = batch.schema.get_field_index(HALO)
        own = None if place < 0 else pc.invert(batch.column(place)).to_numpy(zero_copy_only=False)
        if own is not None:
            ends = {prefix: e & own for prefix, e in ends.items()}
        values = {prefix: features_of(batch, ends[prefix], spec, cfg, len(names[prefix])) for prefix, cfg in configs.items()}
        if own is not None:
            batch, ends, values = batch.filter(pa.array(own)), {p: e[own] for p, e in ends.items()}, {p: v[own] for p, v in values.items()}
        for start in range(0, batch.num_rows, STEP):
            rows = batch.slice(start, STEP)
            arrays = [rows.column(rows.schema.get_field_index(c)) for c in columns]
            for prefix in configs:
                part = values[prefix][start : start + STEP]
                if packed:
                    offsets = pa.array(np.arange(len(part) + 1) * part.shape[1], type=pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(part.ravel()), type=pa.list_(pa.field("element", pa.float32(), nullable=False))))
                else:
                    arrays += [pa.array(np.ascontiguousarray(part[:, j])) for j in range(part.shape[1])]
                if full:
                    arrays.append(pa.array(ends[prefix][start : start + STEP]))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def appended(rows: DataFrame, deal: list, keys: list[str], order: list[str]) -> DataFrame:
        """One shuffle and sort; series that a batch does not finish wait for the next one."""

        def run(batches):
            held = None
            for batch in batches:
                batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                if not batch.num_rows:
                    continue
                last = int(_starts(batch, keys)[-1])
                yield from finished(batch.slice(0, last), keys)
                held = batch.slice(last)
            if held is not None:
                yield from finished(held, keys)

        # a fixed number of partitions: adaptive execution would put small tables into one task, but the kernels are costly
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = rows.repartition(partitions, *deal).sortWithinPartitions(*[F.col(f"`{c}`") for c in (*keys, *order)])
        return sorted_rows.mapInArrow(run, schema)

    rows = max(part_rows, widest)  # so that the rows that open a part all lie in the part before
    long = long_series(df, spec, rows)
    if long is None:
        return appended(df, [_null_spread(df, entity)], [spec.entity], list(spec.order))
    short, parts = parted(df, spec, long, widest - 1, rows)
    return appended(short, [_null_spread(short, entity)], [spec.entity], list(spec.order)).unionByName(appended(parts, [entity, F.col(PART)], [spec.entity, PART], [ROW]))


def _null_spread(df: DataFrame, entity):
    """A key that tells entities apart and deals rows without one, which share no window, over many groups."""
    others = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)])
    return F.struct(entity.alias("e"), F.when(entity.isNull(), F.pmod(others, F.lit(4096))).alias("s"))
