"""The corpus pipeline: each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molq.llm.common import freed_afterwards, stored
from molq.llm.decontaminate import drop_leaks
from molq.llm.lang_id import drop_rejected, fit_language_centroids
from molq.llm.near_dedup import near_duplicate_entities
from molq.llm.phrase_dedup import remove_recurring_runs
from molq.llm.pieces import encode_and_decode


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language centroid, or without a letter, go; without a single label all do."""
    return drop_rejected(docs, fit_language_centroids(docs, "doc_id", "text", "lang", allow_empty=True), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest doc_id stays."""
    judged = near_duplicate_entities(docs, "doc_id", "text", percent=80)
    gone = stored(judged.where("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in a document with a smaller doc_id go; n_chars follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_recurring_runs(docs, "doc_id", "text", carry=rest).withColumnRenamed("kept_features", "text")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text", "item_id", "text")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, decoded_sha256) of every document left; the digest is of the text decoded from the ids."""
    coded = encode_and_decode(docs, "doc_id", "text")
    return coded.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup),
          ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", pieces)]
ORACLE_SQL = None  # SQL cannot express the first and the last stage; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with freed_afterwards(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), "stage")
    return docs
