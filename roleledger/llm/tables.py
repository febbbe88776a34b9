"""Reading, staging and joining shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roleledger.scratch import settled, staged

# Row counts up to which a table of one or two numbers a row is broadcast: some tens of MB on each executor.
MAX_BROADCAST_ROWS = 1_000_000

__all__ = ["bounded", "documents", "members", "settled", "staged"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, more: Column | None = None) -> DataFrame:
    """A staged table marked for broadcast when it is small enough by count; else as it is, to be joined by shuffle.

    ``more`` is how many further numbers a row holds, for tables with lists.
    """
    count = df.agg(F.count("*") + F.coalesce(F.sum(F.lit(0) if more is None else more), F.lit(0))).first()[0]
    return F.broadcast(df) if count <= limit else df


def members(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose ``key`` is in the staged table ``ids`` (``left_anti``: is not)."""
    return rows.join(bounded(ids), key, how)
