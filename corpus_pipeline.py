"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the
columns of ``documents``; the last returns the pieces and their bins. A repeated doc_id is as many documents as it
has texts, and a row without one is a document by its text, but for the passages, which are cut by doc_id: rows
without one stay whole there. Texts that lose all their lines or passages stay as empty rows, and so do rows
without a text. Very long texts are one row throughout. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.llm import jaccard_join, line_templates, packing, passages, quality
from roleledger.llm.labelled import fold, sample
from roleledger.llm.tables import documents, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    examples = sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, quality.MAX_TRAINING_ROWS)
    return docs.where(quality.score(docs, quality.fit(examples)) >= quality.CUT)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates."""
    return _measured(line_templates.drop_recurring_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest doc_id, of equal rows one."""
    return jaccard_join.one_of_each(docs, jaccard_join.jaccard_join(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place, has."""
    return _measured(passages.drop_passages(docs, passages.passages(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins."""
    return packing.pack(docs, packing.word_count(F.col("text")), packing.text_cluster(F.col("text")))


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the new text, if there is such a column."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack),
]

# Training, chaining and packing go beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; what a stage returns is written before the next one reads it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
