"""Rolling windows of rows, as native frames: one shuffle and one sort by entity serve any number of window lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.series import HALO, PART, PART_ROWS, ROW, TOTAL, long_series, parted
from tidemark.spec import SeriesSpec, ValidationError


def single(name: str) -> Column:
    """A channel in single precision, held as double; null becomes NaN so that windows keep their length."""
    return F.coalesce(F.col(f"`{name}`").cast("float"), F.lit(float("nan"))).cast("double")


def by_entity(spec: SeriesSpec):
    return Window.partitionBy(f"`{spec.entity}`").orderBy(*[F.col(f"`{c}`") for c in spec.order])


def numbered(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``df`` with ``row_in_series`` (from 1) and ``series_rows``."""
    whole = Window.partitionBy(f"`{spec.entity}`")
    return df.withColumns({"row_in_series": F.row_number().over(by_entity(spec)), "series_rows": F.count("*").over(whole)})


def over_series(df: DataFrame, spec: SeriesSpec, size: int, columns: Callable[[WindowSpec], dict[str, Column]], part_rows: int = PART_ROWS) -> DataFrame:
    """Rows with an entity, ``row_in_series`` and ``series_rows``, and the columns that ``columns`` builds on a window.

    The window is a series in order; frames may reach back ``size - 1`` rows.  A series with more than ``part_rows``
    rows is many windows, one for each of its parts, so that no task holds a whole long series.
    """
    known = df.where(F.col(f"`{spec.entity}`").isNotNull())
    rows = max(part_rows, size)
    long = long_series(known, spec, rows)
    short, parts = (known, None) if long is None else parted(known, spec, long, size - 1, rows)
    out = numbered(short, spec).withColumns(columns(by_entity(spec)))
    if parts is None:
        return out
    placed = parts.withColumns({"row_in_series": (F.col(ROW) + 1).cast("int"), "series_rows": F.col(TOTAL)})
    own = placed.withColumns(columns(Window.partitionBy(f"`{spec.entity}`", PART).orderBy(ROW))).where(~F.col(HALO))
    return out.unionByName(own.drop(PART, ROW, TOTAL, HALO))


def reaching(window: WindowSpec, size: int) -> WindowSpec:
    """The frame of the ``size`` rows that end at each row."""
    return window.rowsBetween(-(size - 1), 0)


def rolling(df: DataFrame, spec: SeriesSpec, size: int, step: int = 1, *, min_rows: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """A row for each full window (every ``step``-th of a series), with an array per channel, oldest value first."""
    if size < 2 or step < 1:
        raise ValidationError("a window needs at least two rows and a positive step")
    out = over_series(df, spec, size, lambda w: {f"{c}_window": F.collect_list(single(c)).over(reaching(w, size)) for c in spec.numeric}, part_rows)
    full = (F.col("row_in_series") >= size) & (F.col("series_rows") >= (min_rows or size))
    return out.where(full & ((F.col("row_in_series") - size) % step == 0))


def rolling_multi(df: DataFrame, spec: SeriesSpec, sizes: list[int], *, part_rows: int = PART_ROWS) -> DataFrame:
    """Every row with an array per channel and length; null where the window is not full."""
    whole = lambda w, c, n: F.when(F.col("row_in_series") >= n, F.collect_list(single(c)).over(reaching(w, n)))
    return over_series(df, spec, max(sizes), lambda w: {f"{c}_window_{n}": whole(w, c, n) for n in sizes for c in spec.numeric}, part_rows)


def boundaries(df: DataFrame, spec: SeriesSpec, size: int, step: int = 1, min_rows: int | None = None) -> DataFrame:
    """How many windows each series has; series that are too short have none."""
    n = F.count("*")
    windows = F.when(n >= (min_rows or size), F.floor((n - size) / step) + 1).otherwise(0)
    return df.where(F.col(f"`{spec.entity}`").isNotNull()).groupBy(spec.entity).agg(n.alias("series_rows"), windows.cast("long").alias("n_windows"))


def statistics(spec: SeriesSpec, size: int) -> Callable[[WindowSpec], dict[str, Column]]:
    """Native aggregates of each channel over the last ``size`` rows."""

    def columns(window: WindowSpec) -> dict[str, Column]:
        over, out = reaching(window, size), {}
        for c in spec.numeric:
            x = single(c)
            out |= {f"{c}_mean": F.avg(x).over(over), f"{c}_std": F.stddev_samp(x).over(over), f"{c}_min": F.min(x).over(over), f"{c}_max": F.max(x).over(over)}
            out[f"{c}_median"] = F.sort_array(F.collect_list(x).over(over))[(size - 1) // 2]
        return out

    return columns


def window_stats(df: DataFrame, spec: SeriesSpec, size: int, *, part_rows: int = PART_ROWS) -> DataFrame:
    """Mean, sample deviation, least, largest and lower median of each channel over full windows, by native aggregates."""
    return over_series(df, spec, size, statistics(spec, size), part_rows).where(F.col("row_in_series") >= size)


def slope(window: WindowSpec, channel: str, size: int) -> Column:
    """Least-squares slope of the last ``size`` values against the row's place."""
    return F.regr_slope(single(channel), F.col("row_in_series").cast("double")).over(reaching(window, size))
