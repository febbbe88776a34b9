"""Rebuild the master from all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roleledger.operators.filters import drop_block_listed, drop_known_duplicates
from roleledger.operators.keys import last_wins
from roleledger.operators.normalize import dated
from roleledger.plans.refresh import Rules


def recover(snapshots: DataFrame, block_list: DataFrame, duplicates: DataFrame, rules: Rules) -> DataFrame:
    """The newest snapshot row of every key, filtered by all rules; known repetitions of a text go too.

    Of several rows of a key in one day the last by ``ordinal`` counts, if snapshots have one, and else the one
    with the largest hash of the row, so that the choice is always the same. Rows without a key are those of ``without_key``.

    Day, order and hash are chosen by key first, and the key lists are applied there, so that the rows
    themselves are moved for the winners only, one a key but for exact repetitions.
    """
    same_day = ["ordinal"] if "ordinal" in snapshots.columns else []
    hashed = snapshots.where("key_id is not null").withColumn("_hash", F.xxhash64(*snapshots.columns))
    rank = F.struct("snapshot_date", *same_day, "_hash")
    newest = hashed.groupBy("key_id").agg(F.max(rank).alias("_newest"))
    wanted = drop_known_duplicates(drop_block_listed(newest, block_list), duplicates, rules.all_types)
    # No equality, so that the join is by key alone and what follows finds its rows together already.
    same = (rank >= F.col("_newest")) & (rank <= F.col("_newest"))
    rows = hashed.join(wanted, "key_id").where(same).drop("_newest")
    one = last_wins(rows, ["_hash"]).drop("snapshot_date", "version", "_hash")
    return dated(rules.kept(one))
