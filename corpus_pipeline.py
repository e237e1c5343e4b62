"""Corpus pipeline: toxicity, line dedup, near-dedup, personal data, packing.

Every stage takes all documents that the one before it kept. Stages but the last return the columns of
``documents``; the last returns the packed pieces with their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import lines, packing, pii, simhash, toxicity
from opsframe.llm.common import table, written

TOXIC_SCORE = 0.7

#: No SQL: trained scores, fingerprints and packing can't be stated in it; tests hold them against plain Python.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC_SCORE``; labels of the held-out fold are never learned from."""
    use = F.coalesce(toxicity.fold(F.col("doc_id")) != 1, F.lit(False))
    return toxicity.train(docs, table(spark, sf_dir, "labels"), use).keep_below(docs, TOXIC_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template an earlier document has."""
    return lines.drop_recurring(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of near duplicates."""
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training windows."""
    return packing.pack(docs, keep_text=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
