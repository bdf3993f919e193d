"""Long series cut into parts of bounded size that overlap, so that one entity with very many rows is many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.shared import cut
from tidemark.spec import SeriesSpec

#: Rows of one series that one task holds at a time.
PART_ROWS = 16_384
#: Columns of a part's rows: its number, the row's number in the series, the series' length, and whether it only opens the part.
PART, ROW, TOTAL, HALO = "__part_of_series", "__row_of_series", "__rows_of_series", "__opens_part"
_KEY, _RANGE, _OFFSET, _SIZE, _PLACE = "__key_of_series", "__range_of_series", "__offset_of_range", "__size_of_range", "__place_of_row"


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns of these names, if it has any."""
    names = set(names)
    kept = [c for c in df.columns if c not in names]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


def long_series(df: DataFrame, spec: SeriesSpec, rows: int) -> DataFrame | None:
    """Key and length of the series with more than ``rows`` rows; ``None`` where there are none."""
    entity = F.col(f"`{spec.entity}`")
    counts = df.where(entity.isNotNull()).groupBy(entity.alias(_KEY)).agg(F.count("*").alias(TOTAL))
    long = cut(counts.where(F.col(TOTAL) > rows))
    return None if long.isEmpty() else long


def parted(df: DataFrame, spec: SeriesSpec, long: DataFrame, reach: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the other series as they are, and those of ``long`` in parts of ``rows`` rows.

    Each part opens with copies of the ``reach`` rows before it (``reach`` may be ``rows`` at most).
    """
    entity = F.col(f"`{spec.entity}`")
    short = df.join(long.select(_KEY), entity == F.col(_KEY), "left_anti")
    keys = [F.col(f"`{c}`") for c in (spec.entity, *spec.order)]
    dealt = cut(df.join(long, entity == F.col(_KEY)).drop(_KEY).repartitionByRange(*keys).withColumn(_RANGE, F.spark_partition_id()))
    sizes = dealt.groupBy(keys[0].alias(_KEY), F.col(_RANGE).alias(_PLACE)).agg(F.count("*").alias(_SIZE))
    before = Window.partitionBy(_KEY).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_KEY, _PLACE, F.coalesce(F.sum(_SIZE).over(before), F.lit(0)).alias(_OFFSET))
    inner = Window.partitionBy(keys[0], _RANGE).orderBy(*keys[1:])
    joined = dealt.join(offsets, (keys[0] == F.col(_KEY)) & (F.col(_RANGE) == F.col(_PLACE))).drop(_KEY, _PLACE)
    numbered = joined.withColumn(ROW, F.col(_OFFSET) + F.row_number().over(inner) - 1).drop(_OFFSET, _RANGE)
    own = F.floor(F.col(ROW) / rows)
    place = lambda part, opens: F.struct(part.alias("part"), F.lit(opens).alias("opens"))
    opens_next = (F.col(ROW) % rows >= rows - reach) & (F.col(ROW) + 1 < F.col(TOTAL))
    places = F.when(opens_next, F.array(place(own, False), place(own + 1, True))).otherwise(F.array(place(own, False)))
    parts = numbered.withColumn(_PLACE, F.explode(places))
    return short, parts.withColumns({PART: F.col(f"{_PLACE}.part"), HALO: F.col(f"{_PLACE}.opens")}).drop(_PLACE)
