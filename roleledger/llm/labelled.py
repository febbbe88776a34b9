"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.llm.tables import staged


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``most`` documents with a label, dealt out by a hash of their ids.

    ``usable`` says by ``doc_id`` which labels may be learnt. A document labelled twice counts as 1 if any
    label says so. The ids are chosen before any text is read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "chosen")
    # At most ``most`` rows of two numbers.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
