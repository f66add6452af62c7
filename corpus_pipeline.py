"""A corpus of documents made ready for training: five stages, each over all rows that the one before kept.

1. ``quality``: documents that the grading model rejects go.
2. ``near_duplicates``: one document of each group stays that share four fifths of their five-word shingles. Those linked
   by near fingerprints are compared first, then the ones that share minima of their shingles' hashes.
3. ``decontaminate``: documents with passages of the benchmark go.
4. ``personal_data``: personal data is masked in the text.
5. ``encode``: texts become token ids, which decode to the tokens' text.

Each stage's result is written as Parquet and read again as the next one's documents. A stage's function takes
(spark, docs, sf_dir); all but the last return the columns of documents. Rows with nulls stay unless a stage's operator
decides otherwise by their text, null counting as empty; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import bpe, phrases, pii, quality, simhash
from twinsieve.llm.queries import WORD_BPE
from twinsieve.llm.rows import table
from twinsieve.plans.workspace import Workspace


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_on(docs, quality.grade_labels(table(spark, sf_dir, "labels")))
    graded = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         quality.graded(model, "text").alias("grade"))
    return graded.where("grade.kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(Workspace(spark), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.without_contaminated(Workspace(spark), docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_personal_data(Workspace(spark), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, WORD_BPE)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontaminate", drop_contaminated),
          ("personal_data", mask_personal_data), ("encode", encode)]

#: SQL expresses neither the fitted model nor the fingerprints; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
