"""Running counts and sums within a group of any size.

A window over a whole group orders all of it in one task. Here the order column, a whole number that
is unique in its group, is cut into blocks of ``BLOCK`` consecutive values. A window runs inside
each block; the block totals, at most ``BLOCK`` times fewer rows, are summed up the same way, level
by level, and joined back. No window ever sees more than ``BLOCK`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 1 << 16
# Three levels cover order values below 2**48.
LEVELS = 3


def _before_block(blocks: DataFrame, group: str, level: int, size: int) -> DataFrame:
    """``_base``: the total of all blocks of the group before this one."""
    if level == 0:
        # The blocks of the top level: few, because order values have a known largest value.
        window = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        return blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(window), F.lit(0)))
    outer = blocks.withColumn("_outer", F.floor(F.col("_block") / size))
    window = W.partitionBy(group, "_outer").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    inside = outer.withColumn("_inside", F.coalesce(F.sum("_sum").over(window), F.lit(0)))
    totals = inside.groupBy(group, F.col("_outer").alias("_block")).agg(F.sum("_sum").alias("_sum"))
    bases = _before_block(totals, group, level - 1, size).select(
        group, F.col("_block").alias("_outer"), F.col("_base").alias("_outer_base")
    )
    return (
        inside.join(bases, [group, "_outer"])
        .withColumn("_base", F.col("_outer_base") + F.col("_inside"))
        .select(group, "_block", "_sum", "_base")
    )


def _running(
    df: DataFrame,
    group: str,
    order: str,
    value: Column,
    target: str,
    size: int,
    before: bool,
    total: str | None = None,
) -> DataFrame:
    columns = df.columns
    valued = df.withColumns({"_block": F.floor(F.col(order) / size), "_value": value})
    totals = valued.groupBy(group, "_block").agg(F.sum("_value").alias("_sum"))
    bases = _before_block(totals, group, LEVELS - 2, size).select(group, "_block", "_base")
    kept = [(F.col("_base") + F.col("_inside")).alias(target)]
    if total:
        # Joined to the blocks, not to the rows, so that a busy group does not pile up in one task.
        bases = bases.join(totals.groupBy(group).agg(F.sum("_sum").alias(total)), group)
        kept.append(F.col(total))
    window = W.partitionBy(group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    inside = valued.withColumn("_inside", F.coalesce(F.sum("_value").over(window), F.lit(0)))
    return inside.join(bases, [group, "_block"]).select(*columns, *kept)


def running_index(
    df: DataFrame, group: str, order: str, target: str, size: int = BLOCK, total: str | None = None
) -> DataFrame:
    """Add the 0-based position of a row in its group, and as ``total`` the size of the group."""
    return _running(df, group, order, F.lit(1).cast("bigint"), target, size, before=True, total=total)


def running_total(
    df: DataFrame, group: str, order: str, value: str, target: str, size: int = BLOCK
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to and including this one."""
    return _running(df, group, order, F.col(value), target, size, before=False)
