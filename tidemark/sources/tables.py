"""Series in, features out: any Spark source, and packed or wide feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.spec import SeriesSpec

FORMATS = ("parquet", "orc", "csv", "json")


def series_schema(spec: SeriesSpec, entity: T.DataType | None = None) -> T.StructType:
    """The schema that text formats are read with, so that no pass over the data infers it."""
    fields = [T.StructField(spec.entity, entity or T.StringType()), T.StructField(spec.time, T.TimestampType())]
    fields += [T.StructField(c, T.DoubleType()) for c in spec.numeric]
    return T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in spec.tiebreak)])


def read_series(spark: SparkSession, path: str, spec: SeriesSpec, kind: str = "parquet", *, entity: T.DataType | None = None, **options) -> DataFrame:
    """Columns of ``spec`` from files; only these reach the scan."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    reader = spark.read.options(**options)
    if kind in ("csv", "json"):
        reader = reader.schema(series_schema(spec, entity))
        if kind == "csv":
            reader = reader.option("header", options.get("header", True)).option("enforceSchema", False)
    columns = dict.fromkeys((spec.entity, *spec.order, *spec.numeric))
    return reader.format(kind).load(path).select(*[F.col(f"`{c}`") for c in columns])


def unpack(df: DataFrame, packed: str, names: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Columns out of a packed array, all or the wanted ones."""
    at = {n: i for i, n in enumerate(names)}
    rest = [F.col(f"`{c}`") for c in df.columns if c != packed]
    return df.select(*rest, *[F.col(packed)[at[n]].alias(n) for n in wanted or names])


def pack(df: DataFrame, names: list[str], packed: str) -> DataFrame:
    """Feature columns as one array."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in set(names)]
    return df.select(*rest, F.array(*[F.col(f"`{n}`").cast("float") for n in names]).alias(packed))


def write_features(df: DataFrame, path: str, kind: str = "parquet", *, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A feature table; with partitions, rows are dealt by them first so that each task writes few files."""
    out = df.repartition(*[F.col(f"`{c}`") for c in partition_by]) if partition_by else df
    writer = out.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
