"""From raw documents to packed sequences, stage by stage.

Each stage gets the rows that its predecessor kept, as a written table. Every
stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ringfold.functions.lineage import written
from ringfold.llm import exact_dedup, language_id, near_dedup, packing, toxicity
from ringfold.llm.common import table

# A text of unclear language: the best one's share of the evidence is below this.
CLEAR = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(_beside(docs), model, "_text", passages=False)
    return found.where("predicted = 0").select("_doc.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not ``und`` and not a doubtful guess."""
    found = language_id.identify(_beside(docs), language_id.fit(docs), "_text")
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= CLEAR)
    return found.where(sure).select("_doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near duplicates."""
    return near_dedup.near_dedup(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(docs, path, end_id=1))


def _beside(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no added column meets its names."""
    return docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", known_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", packed_sequences),
]

# Scores of fitted models and packing have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
