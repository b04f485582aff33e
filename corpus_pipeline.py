"""A corpus pipeline: language ID, near-dedup, substring dedup, mixing, tokens.

Each stage reads what its predecessor has written. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultsift.llm import bpe, langid, mixing, near, rlz
from faultsift.llm.common import new_dir, staged, tables
from faultsift.llm.queries import WEIGHTS, tokenizer_path

#: Words in a shingle of the near-duplicate stage.
SHINGLE = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; those that the operator rejects go."""
    told = langid.identify(docs.withColumn("_h", F.xxhash64("text")), host=F.col("source"), keep=["doc_id", "_h"])
    gone = staged(told.where(~F.col("accepted")).select("doc_id", "_h").distinct(), "rejected")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["_h"])
    return docs.join(gone, same, "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: a Jaccard similarity of 0.8 or more links two."""
    return near.keep_one(docs, shingle=SHINGLE)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; one that has nothing else goes.

    Untouched texts stay as they are; in others the words that are left are joined by one space.
    """
    cut = rlz.remove(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*(text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    mixed = mixing.mix(docs, WEIGHTS)
    order = ("mix_slot", "mix_at", "doc_id")
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, in order, and whether they decode to its text."""
    out = bpe.round_trip(docs, tokenizer_path(), keep=["doc_id", "lang", "source"])
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL has no n-gram model, SimHash or BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of documents."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
