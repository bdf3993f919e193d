"""Feature selection: missing share and variance in one aggregate, correlations from one distributed Gram matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def column_profile(df: DataFrame, names: list[str]) -> list[tuple[float, float]]:
    """Missing share and sample variance (of what is there) of each column."""
    out: list[tuple[float, float]] = []
    for first in range(0, len(names), 500):  # bounded expressions in one aggregate
        part = names[first : first + 500]
        value = lambda n: F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double"))
        row = df.agg(F.count("*").alias("rows"), *[F.count(value(n)).alias(f"c{k}") for k, n in enumerate(part)], *[F.var_samp(value(n)).alias(f"v{k}") for k, n in enumerate(part)]).first()
        for k in range(len(part)):
            variance = row[f"v{k}"]
            out.append((1 - row[f"c{k}"] / max(row.rows, 1), float("nan") if variance is None else variance))
    return out


def varying(df: DataFrame, names: list[str], least: float = 0.0) -> list[str]:
    """Columns whose variance over the whole table is larger than ``least``."""
    return [n for n, (_, spread) in zip(names, column_profile(df, names), strict=True) if spread > least]


def correlations(df: DataFrame, names: list[str]) -> np.ndarray:
    """Correlation matrix with missing values as zero.

    Each task sums its products to one row per column; rows of a column are added up as a sorted stream, and only the
    sums (columns by columns) reach the driver.
    """
    n = len(names)
    fields = ["i", "rows", "total", "products"]
    schema = "i int, rows long, total double, products array<double>"

    def batch_of(i, rows, total, products):
        return pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([rows], type=pa.int64()), pa.array([total]), pa.array([products])], names=fields)

    def sums(batches):
        gram, total, rows = np.zeros((n, n)), np.zeros(n), 0
        for batch in batches:
            x = np.stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(np.float64)) for c in batch.columns], axis=1)
            gram += x.T @ x
            total += x.sum(axis=0)
            rows += len(x)
        if rows:
            for i in range(n):
                yield batch_of(i, rows, float(total[i]), gram[i])

    def added(batches):
        at, rows, total, products = None, 0, 0.0, np.zeros(n)
        for batch in batches:
            values = batch.column(3).flatten().to_numpy().reshape(-1, n)
            for k, (i, r, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if i != at:
                    if at is not None:
                        yield batch_of(at, rows, total, products)
                    at, rows, total, products = i, 0, 0.0, np.zeros(n)
                rows, total = rows + r, total + t
                products += values[k]
        if at is not None:
            yield batch_of(at, rows, total, products)

    parts = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(names)]).mapInArrow(sums, schema)
    gram, total, rows = np.zeros((n, n)), np.zeros(n), 0
    for r in parts.repartition(F.col("i")).sortWithinPartitions("i").mapInArrow(added, schema).collect():
        gram[r.i], total[r.i], rows = r.products, r.total, r.rows
    mean = total / max(rows, 1)
    covariance = gram / max(rows, 1) - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(covariance), 1e-10))
    return covariance / np.outer(deviation, deviation)


def select_features(source: DataFrame | str, names: list[str] | None = None, *, variance: float = 1e-8, correlation: float = 0.95, most_missing: float = 0.5, spark: SparkSession | None = None) -> list[str]:
    """Columns that are there, vary, and are not nearly the same as one kept before them (in column order)."""
    df = (spark or SparkSession.getActiveSession()).read.parquet(source) if isinstance(source, str) else source
    names = names or df.columns
    profile = column_profile(df, names)
    left = [n for n, (gone, spread) in zip(names, profile, strict=True) if gone <= most_missing and spread > variance]
    if len(left) < 2:
        return left
    matrix = np.abs(correlations(df, left))
    kept: list[int] = []
    for i in range(len(left)):
        if not (matrix[i, kept] > correlation).any():
            kept.append(i)
    return [left[i] for i in kept]
