"""From raw documents to packed sequences: language, quality, near duplicates, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import langid, packing, quality, secret_scan, simhash
from tidemark.llm.common import cut, discard, shuffles_go, table, written

#: Names of helper columns, unlike any of a table.
ROW, AGAIN, FIRST = "__row_of_pipeline", "__again_in_pipeline", "__first_of_pipeline"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a text that no centroid is near goes, and so does one without letters."""
    return langid.keep_known(docs, langid.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Groups join fingerprints at two or fewer differing bits, and near copies at a similarity of 0.8 of five-word shingles.
    Rows without an id take one from their text and source, beyond the ids that occur.  Where texts share an id, one
    keeps it and the others take one from text and id in the same way.  Of rows equal in id and text one stays.
    """
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64("text", "source"), F.lit(1 << 61))
    content = F.xxhash64("text")
    shared = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(content).alias(FIRST), F.max(content).alias("last"))
    shared = cut(shared.where(F.col(FIRST) != F.col("last")).select("doc_id", FIRST))
    name = F.coalesce("doc_id", stand_in)
    if shared.isEmpty():
        named = docs.withColumn(ROW, name)
    else:
        other = F.lit(1 << 62) + F.pmod(F.xxhash64("text", "doc_id", F.lit(1)), F.lit(1 << 61))
        named = docs.join(shared, "doc_id", "left").withColumn(ROW, F.when(F.col(FIRST) != content, other).otherwise(name))
    with shuffles_go(spark):
        grouped = simhash.joined_groups(named.select(F.col(ROW).alias("doc_id"), "text"))
    kept = named.join(grouped.where("doc_id = component_id").select(F.col("doc_id").alias(ROW)), ROW, "left_semi")
    again = F.row_number().over(Window.partitionBy(ROW).orderBy(ROW))
    return kept.withColumn(AGAIN, again).where(F.col(AGAIN) == 1).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, placed in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packed),
]
#: SQL cannot express the fitted models and the linear program; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage's rows are a table in the shared folder before the next one reads them; a table goes when the table
    after it is complete, so no more than two are there at a time.
    """
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = written(out)
        if kept is not None:
            discard(kept)
        kept = docs
