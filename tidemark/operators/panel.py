"""Dense panels: every entity at every time, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import single
from tidemark.spec import SeriesSpec, ValidationError

#: Times of a panel at most: the list of them goes to every task (8 MB), and each entity's row is that long.
MOST_TIMES = 1_000_000


def to_panel(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """A row per entity with its values at all times of the table, in order: arrays ``times``, ``is_valid`` and one per channel.

    Gaps hold NaN.  Of rows with one entity and time the last by the tiebreak counts.  Only the list of times (one row) meets every entity; the table itself is grouped once.  A table
    with more than ``MOST_TIMES`` times has no dense form: it is refused, and stays long.
    """
    known = df.where(F.col(spec.entity).isNotNull() & F.col(spec.time).isNotNull())
    if (n := known.select(spec.time).distinct().count()) > MOST_TIMES:
        raise ValidationError(f"{n} different times are too many for a dense panel; narrow the range of times")
    times = known.agg(F.array_sort(F.collect_set(spec.time)).alias("times"))
    values = F.struct(*[single(c).alias(c) for c in spec.numeric])
    last = known.groupBy(spec.entity, spec.time).agg(F.max_by(values, F.struct(*[F.col(f"`{c}`") for c in spec.order], values)).alias("at"))
    own = last.groupBy(spec.entity).agg(F.map_from_entries(F.collect_list(F.struct(F.col(spec.time), F.col("at")))).alias("at"))
    wide = own.join(F.broadcast(times))
    value = lambda c: F.transform("times", lambda t: F.coalesce(F.try_element_at("at", t)[c], F.lit(float("nan"))))
    valid = F.transform("times", lambda t: F.try_element_at("at", t).isNotNull())
    return wide.select(spec.entity, "times", valid.alias("is_valid"), *[value(c).alias(c) for c in spec.numeric])


def from_panel(panel: DataFrame, spec: SeriesSpec, *, masked: bool = True) -> DataFrame:
    """Long rows again: the valid ones, or without the mask those where any channel has a value."""
    zipped = F.arrays_zip("times", "is_valid", *spec.numeric)
    rows = panel.select(spec.entity, F.explode(zipped).alias("r"))
    kept = F.col("r.is_valid") if masked else F.expr(" OR ".join(f"NOT isnan(r.`{c}`)" for c in spec.numeric))
    return rows.where(kept).select(spec.entity, F.col("r.times").alias(spec.time), *[F.col(f"r.`{c}`").alias(c) for c in spec.numeric])


def per_series(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """A row per entity with its values in order, without gaps."""
    fields = F.struct(*[F.col(c) for c in spec.order], *[single(c).alias(f"v_{c}") for c in spec.numeric])
    rows = df.where(F.col(spec.entity).isNotNull()).groupBy(spec.entity).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    return rows.select(spec.entity, *[F.col("rows").getField(f"v_{c}").alias(c) for c in spec.numeric])


def panel_bytes(entities: int, times: int, channels: int, item: int = 4) -> int:
    """Size of a dense panel, for planning."""
    return entities * times * channels * item
