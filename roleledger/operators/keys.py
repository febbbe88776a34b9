"""Joins, unions and choices by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.operators.filters import removable_duplicates
from roleledger.schema import EXISTING_TFIDF, KEY_ID


def _one_per_key(df: DataFrame, key: str, chosen: Column) -> DataFrame:
    # An aggregate, not a window: every map task first cuts its rows to one per key, so a key that
    # owns a third of the table sends one row per task to its reducer.
    row = df.groupBy(key).agg(chosen.alias("_row"))
    return row.select("_row.*").select(*df.columns)


def without_key(df: DataFrame, key: str = "key_id") -> DataFrame:
    """The rows that ``first_wins`` and ``last_wins`` leave out, with ``invalid_reason``."""
    return df.where(F.col(key).isNull()).withColumn("invalid_reason", F.lit("key unset"))


def first_wins(df: DataFrame, order: list[str], key: str = "key_id") -> DataFrame:
    """The first row of every key in the order of these columns; rows without a key are those of ``without_key``.

    The columns must order the rows of a key completely, so that the choice is always the same.
    """
    df = df.where(F.col(key).isNotNull())
    return _one_per_key(df, key, F.min_by(F.struct(*df.columns), F.struct(*order)))


def last_wins(df: DataFrame, order: list[str], key: str = "key_id") -> DataFrame:
    """As ``first_wins`` with the last row: a later page or file line replaces the earlier one."""
    df = df.where(F.col(key).isNotNull())
    return _one_per_key(df, key, F.max_by(F.struct(*df.columns), F.struct(*order)))


def cross_provider_keys(df: DataFrame) -> DataFrame:
    """Keys that two providers claim, with the number of providers."""
    return (
        df.where(F.col("key_id").isNotNull())
        .groupBy("key_id")
        .agg(F.count_distinct("provider").alias("n_providers"))
        .where("n_providers > 1")
    )


def union_providers(collected: list[DataFrame]) -> DataFrame:
    """All providers' rows; a provider that brought nothing is simply an empty table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collected)


def match_by_key(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming postings whose key the master already has."""
    return incoming.select("key_id").join(existing.select("key_id"), "key_id", "left_semi").select(
        F.col("key_id").alias("original_key_id"),
        F.col("key_id").alias("duplicate_key_id"),
        F.lit(KEY_ID).alias("dup_type"),
        F.lit(None).cast("double").alias("similarity"),
    )


def match_known_duplicate(
    incoming: DataFrame, existing: DataFrame, duplicates: DataFrame, all_types: bool = False
) -> DataFrame:
    """Incoming postings, not in the master, whose text an earlier run found to be a repetition."""
    known = (
        removable_duplicates(duplicates, all_types)
        .groupBy("key_id")
        .agg(F.min("original_key_id").alias("original_key_id"))
    )
    return (
        incoming.select("key_id")
        .join(existing.select("key_id"), "key_id", "left_anti")
        .join(known, "key_id")
        .select(
            F.col("original_key_id"),
            F.col("key_id").alias("duplicate_key_id"),
            F.lit(EXISTING_TFIDF).alias("dup_type"),
            F.lit(None).cast("double").alias("similarity"),
        )
    )


def unmatched_incoming(
    incoming: DataFrame, existing: DataFrame, duplicates: DataFrame, all_types: bool = False
) -> DataFrame:
    """Incoming postings that neither the master nor the duplicates list knows by key."""
    known = removable_duplicates(duplicates, all_types)
    seen = existing.select("key_id").unionByName(known.select("key_id"))
    return incoming.join(seen, "key_id", "left_anti")
