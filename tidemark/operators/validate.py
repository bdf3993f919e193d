"""Checks of an input table: the schema without a job, the data in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import SeriesSpec, ValidationError

MOST_MISSING = 0.5


def missing(name: str, kind: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column.isNull()


def check_schema(df: DataFrame, spec: SeriesSpec) -> None:
    wanted = (spec.entity, *spec.order, *spec.numeric)
    if absent := [c for c in wanted if c not in df.columns]:
        raise ValidationError(f"missing columns: {', '.join(absent)}")
    if wrong := [c for c in spec.numeric if not isinstance(df.schema[c].dataType, T.NumericType)]:
        raise ValidationError(f"not numeric: {', '.join(wrong)}")


def report(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row: rows, rows with an entity, rows with a time, and the missing share of each numeric column."""
    time = F.expr(f"try_cast(`{spec.time}` AS timestamp)")
    shares = [F.avg(missing(c, df.schema[c].dataType).cast("double")).alias(f"missing_{c}") for c in spec.numeric]
    return df.agg(F.count("*").alias("n_rows"), F.count(F.col(f"`{spec.entity}`")).alias("n_entity"), F.count(time).alias("n_time"), *shares)


def validate(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``df`` with its time as a timestamp; raises ``ValidationError`` where it cannot be processed."""
    check_schema(df, spec)
    found = report(df, spec).first()
    if not found.n_rows:
        raise ValidationError("no rows")
    if not found.n_entity:
        raise ValidationError(f"no row has a value in {spec.entity}")
    if not found.n_time:
        raise ValidationError(f"no value in {spec.time} is a time")
    if poor := [c for c in spec.numeric if found[f"missing_{c}"] > MOST_MISSING]:
        raise ValidationError(f"more than half is missing: {', '.join(poor)}")
    if isinstance(df.schema[spec.time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df
    return df.withColumn(spec.time, F.expr(f"try_cast(`{spec.time}` AS timestamp)"))


def entities(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row: how many different entities there are."""
    return df.agg(F.count_distinct(F.col(f"`{spec.entity}`")).alias("n_entities"))


def output_report(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: rows, cells of these columns, and how many of them are infinite or NaN."""
    value = lambda n: F.col(f"`{n}`").cast("double")
    infinite, nan = ([F.count_if(test(value(n))) for n in names] for test in (lambda v: F.abs(v) == float("inf"), F.isnan))
    rows = F.count("*")
    return df.agg(rows.alias("n_rows"), (rows * len(names)).alias("n_cells"), sum(infinite, F.lit(0)).cast("long").alias("n_infinite"), sum(nan, F.lit(0)).cast("long").alias("n_nan"))


def validate_output(df: DataFrame, names: list[str], most_nan: float = 0.9) -> None:
    """Raises if a feature is infinite anywhere, or NaN nearly everywhere."""
    found = output_report(df, names).first()
    if found.n_infinite:
        raise ValidationError(f"{found.n_infinite} infinite values")
    if found.n_cells and found.n_nan > most_nan * found.n_cells:
        raise ValidationError("nearly all values are NaN")
