"""A training-data pipeline over ``documents``: each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import exact_dedup, packing, pii, simhash_texts, toxicity
from cohortloom.llm.common import new_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the toxicity threshold.

    A null or empty text scores 0 and stays; rows are judged one by one, so repeated rows and
    rows without an id go or stay by their text; without labels or rows nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the one with the largest id.

    Rows that repeat that id with its text stay together; of a group without any id all
    rows stay.
    """
    return _without(docs, exact_dedup.exact_duplicates(docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates: the one with the smallest id.

    Texts link where their SimHashes of five-word shingles are near and the sets of shingles
    have a Jaccard likeness of 0.8 or more. Texts with fewer words than a shingle are compared as a whole; texts without words
    are one component. Rows that repeat that id stay together; of a component without any
    id all rows stay.
    """
    return _without(docs, simhash_texts.near_texts(docs).where("NOT doc_id <=> component_id"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not among those that go, told by id and text together."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"])
    return docs.join(gone, same, "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced in the text.

    ``n_chars`` follows the text. Null and empty texts and those without spans stay as they
    are; repeated rows and rows without an id are masked alike; an empty table stays empty.
    """
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed
    one by one; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Stages in order; each is written as Parquet and read again before the next.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: The stages learn models and join on hashes that SQL cannot express; tests compare them
#: with plain versions instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
