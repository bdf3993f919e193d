"""The engines one by one: numpy on a batch, or a DataFrame whose rows hold windows as arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.context import Windows
from tidemark.functions.convolution import LENGTHS, kernel_bank
from tidemark.functions.features import channel_features, path_features
from tidemark.spec import FeatureConfig

Batch = Callable[[np.ndarray], np.ndarray]
#: Windows that a batch function sees at a time.
BATCH = 2048


def map_windows(df: DataFrame, columns: list[str], function: Batch, packed: str = "features") -> DataFrame:
    """``df`` with ``function`` of its windows as an array: any vectorised function from ``[B, T]`` (or ``[B, T, d]``) to ``[B, N]``.

    Windows of one table may differ in length; equal ones are batched.  Rows with a null window get a null.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(packed, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            sizes = np.stack([np.where(a.is_null(), -1, a.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)) for a in arrays])
            size = np.where((sizes == sizes[0]).all(axis=0), sizes[0], -1).astype(int)
            out: list = [None] * batch.num_rows
            for length in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == length)
                for start in range(0, len(rows), BATCH):
                    part = rows[start : start + BATCH]
                    taken = [a.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).astype(np.float64).reshape(-1, length) for a in arrays]
                    with np.errstate(over="ignore"):
                        values = np.float32(function(taken[0] if len(taken) == 1 else np.stack(taken, axis=2)))
                    for r, v in zip(part.tolist(), values, strict=True):
                        out[r] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.list_(pa.float32()))], names=[*batch.schema.names, packed])

    return df.mapInArrow(run, schema)


class Engine:
    """One engine of a configuration."""

    name = ""

    def __init__(self, cfg: FeatureConfig | None = None, **settings):
        self.cfg = replace(cfg or FeatureConfig(), **settings)

    def compute(self, x: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Features ``[B, N]`` and names of ``[B, T]`` windows."""
        names, values = channel_features(Windows(x), self.cfg, self.name)
        return values, names

    def names(self, size: int) -> list[str]:
        return self.compute(np.arange(2.0 * size).reshape(2, size))[1]

    def n_features(self, size: int) -> int:
        return len(self.names(size))

    def transform(self, df: DataFrame, *columns: str, packed: str = "features") -> DataFrame:
        """``df`` with the features of the windows in its array columns, in the order of ``names``."""
        return map_windows(df, list(columns), lambda x: self.compute(x)[0], packed)


class StatisticsEngine(Engine):
    name = "statistics"


class CanonicalEngine(Engine):
    name = "canonical"


class WaveletEngine(Engine):
    name = "wavelets"


class SignatureEngine(Engine):
    """Takes ``[B, T]`` or ``[B, T, d]``, or several array columns."""

    name = "signatures"

    def compute(self, x: np.ndarray) -> tuple[np.ndarray, list[str]]:
        names, values = path_features(x, self.cfg)
        return values, names

    def names(self, size: int, channels: int = 1) -> list[str]:
        return self.compute(np.arange(2.0 * size * channels).reshape(2, size, channels))[1]

    def info(self, channels: int) -> dict[str, int]:
        d = (channels + self.cfg.time_augment) * (2 if self.cfg.leadlag else 1)
        levels = {f"level_{k}": d**k for k in range(1, min(self.cfg.depth, 3) + 1)}
        return {"channels": d, **levels, "features": sum(levels.values())}


class KernelEngine(Engine):
    """``least_variance`` drops columns of a batch that vary no more; negative keeps all."""

    name = "kernels"

    def __init__(self, cfg: FeatureConfig | None = None, least_variance: float = -1.0, **settings):
        super().__init__(cfg, **settings)
        self.least_variance = least_variance

    def compute(self, x: np.ndarray) -> tuple[np.ndarray, list[str]]:
        values, names = super().compute(x)
        if self.least_variance >= 0 and len(x) > 1:
            kept = np.flatnonzero(values.var(axis=0, ddof=1) > self.least_variance)
            return values[:, kept], [names[k] for k in kept]
        return values, names

    def bank(self, spark: SparkSession, size: int) -> DataFrame:
        """The kernels themselves: ``kernel, length, dilation, weights, bias``."""
        rows = [(k, length, dilation, weights.tolist(), bias) for k, length, dilation, weights, bias in kernel_bank(size, self.cfg.kernels, self.cfg.seed)]
        return spark.createDataFrame(rows, "kernel int, length int, dilation int, weights array<double>, bias double")

    def info(self, spark: SparkSession, size: int) -> DataFrame:
        """Kernels, dilations and biases by length."""
        bank = self.bank(spark, size).groupBy("length")
        return bank.agg(F.count("*").alias("kernels"), F.min("dilation").alias("least_dilation"), F.max("dilation").alias("most_dilation"), F.avg("bias").alias("mean_bias"))


ENGINES = {e.name: e for e in (StatisticsEngine, CanonicalEngine, WaveletEngine, SignatureEngine, KernelEngine)}
__all__ = ["ENGINES", "LENGTHS", "CanonicalEngine", "Engine", "KernelEngine", "SignatureEngine", "StatisticsEngine", "WaveletEngine", "map_windows"]
