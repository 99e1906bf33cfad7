"""The corpus pipeline: quality classifier, SimHash near-dedup, personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The first three
return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import packing, pii, quality, queries, simhash
from inkframe.llm.store import written

#: Score from which a document stays.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels outside the held-out fifth.

    A null text is scored as an empty one, and both stay or go by that score; a null doc_id only keeps a row from teaching. Repeated
    rows have equal scores, so they stay or go together. Without labelled rows every score is 0.5 and all
    documents stay; an empty table stays empty. Texts are scored whole, whatever their length.
    """
    labels = queries.table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    w = quality.train(docs, labels)
    return docs.where(quality.score_of(F.col("text"), w) >= LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Of repeated rows one stays; rows without a doc_id all stay. Null and empty texts, and others of fewer than five words, are
    copies of those with the same words only. An empty table stays empty.
    """
    return simhash.deduplicate(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars is that of the new text.

    A null text stays null, and so does its n_chars; an empty one stays empty. Rows with null ids and repeated rows stay, each
    redacted by itself, whole; an empty table stays empty.
    """
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("text", pii.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast(kind)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece: where each document's tokens go.

    A row is a document, so repeated rows and null ids are packed as often as they stand; a null or empty text is one
    piece of one token, a text of any length as many pieces as it takes. An empty table has no pieces.
    """
    return packing.pack(docs, queries.ranks(), public_tokenizers.PATTERN, added=queries.added_tokens())


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("personal data", redact_personal_data),
    ("best-fit packing", pack_sequences),
]

#: A learned model and XXH64 with a seed have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each result written before the next reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
