"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, jpeg, langid, licenses, oracle, packing, pii, piece, quality, secret_scan, simhash
from tidemark.llm.common import crc_of_id, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False))  # a row without an id is not held out
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    grouped = simhash.groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 tokens, placed in sequences."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True))


def op5_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in a baseline JPEG and read back."""
    return jpeg.round_trip(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's piece ids and of what they decode to."""
    return piece.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its host and its path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_secrets(spark: SparkSession, sf_dir: str, findings: str | None = None) -> DataFrame:
    """Secrets in every document; ``findings`` may name a Parquet table of labelled ones to learn from."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs, None if findings is None else spark.read.parquet(findings)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_neighbours": op2_neighbours,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_jpeg": op5_jpeg,
    "op6_pieces": op6_pieces,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_secrets": op9_secrets,
    "op10_licenses": op10_licenses,
}
ORACLES = oracle.ORACLES
