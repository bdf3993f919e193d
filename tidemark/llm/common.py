"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.shared import cut, discard, shared_folder, shuffles_go, written

__all__ = ["GramHasher", "crc_of_id", "cut", "discard", "hashed_fraction", "keep_rows", "map_batches", "shared_folder", "shuffles_go", "small_batches", "small_parts", "table", "written"]

#: Bytes of text that one Arrow batch hands to Python, unless a single row is longer.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands Python at most ``BATCH_BYTES`` at a time, so that texts of any length need bounded memory.

    A limit that the session sets itself stays as it is.
    """
    conf = df.sparkSession.conf
    if _BATCH_SETTING not in conf.getAll:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, body: Callable[[Iterator[dict]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with batches as dicts of Python lists, in and out."""
    wanted = _arrow_schema(schema)

    def run(batches):
        def columns():
            for part in small_parts(batches):
                yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}

        for out in body(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in wanted], schema=wanted)

    return small_batches(df).mapInArrow(run, schema)


def small_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BATCH_BYTES``."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def keep_rows(df: DataFrame, column: str, verdicts: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df`` for whose ``column`` the verdict is true; every column comes back as it is."""

    def run(batches):
        for part in small_parts(batches):
            yield part.filter(pa.array(verdicts(part.column(column).to_pylist()), type=pa.bool_()))

    return small_batches(df).mapInArrow(run, df.schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def crc_of_id(column) -> F.Column:
    """CRC-32 of an id written as decimal text."""
    return F.crc32(column.cast("string").cast("binary"))


def hashed_fraction(*columns) -> F.Column:
    """A number in [0, 1) that depends on the values alone, for repeatable bounded samples of rows that are merged first."""
    return F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))


class GramHasher:
    """Hashed byte n-grams of lower-cased text in which everything but letters counts as a blank."""

    MULTIPLIERS = (2654435761, 2246822519, 3266489917)

    def __init__(self, bits: int = 13, sizes: tuple[int, ...] = (2, 3, 4)):
        self.bits, self.sizes, self.width = bits, sizes, 1 << bits
        keep = np.full(256, 32, dtype=np.uint8)
        keep[97:123] = np.arange(97, 123)
        keep[128:] = np.arange(128, 256)
        self.keep = keep

    #: Bytes per step, so that a very long text needs no more memory than a short one.
    STEP = 1 << 18

    def counts(self, text: str) -> np.ndarray:
        """How often each bucket occurs in the whole text."""
        raw = self.keep[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
        total = np.zeros(self.width, dtype=np.int64)
        longest = max(self.sizes)
        for start in range(0, len(raw), self.STEP):
            part = raw[start : start + self.STEP + longest - 1].astype(np.uint32)
            fresh = min(self.STEP, len(raw) - start)
            for size, multiplier in zip(self.sizes, self.MULTIPLIERS, strict=False):
                n = min(fresh, len(part) - size + 1)
                if n <= 0:
                    continue
                gram = part[:n].copy()
                for k in range(1, size):
                    gram |= part[k : n + k] << np.uint32(8 * k)
                gram *= np.uint32(multiplier)
                total += np.bincount(gram >> np.uint32(32 - self.bits), minlength=self.width)
        return total
