"""One run: bring what was collected into the master."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from roleledger.operators.filters import filter_postings, split_by_reason, with_reject_reason
from roleledger.operators.keys import first_wins, match_by_key, match_known_duplicate, unmatched_incoming, without_key
from roleledger.operators.merge import (
    append_new,
    block_entry,
    duplicate_entries,
    fresh_rows,
    new_block_entries,
    update_if_newer,
    upsert_duplicates,
)
from roleledger.operators.normalize import dated
from roleledger.operators.similarity import best_match
from roleledger.operators.summary import RunCounts
from roleledger.schema import DEFAULT_MAX_LISTING_DAYS, MATCH, SIMILARITY_THRESHOLD
from roleledger.scratch import staged
from roleledger.sources.snapshots import write_snapshot


@dataclass(frozen=True)
class Rules:
    """What a run keeps and how it merges."""

    as_of: dt.date
    max_days: int | None = DEFAULT_MAX_LISTING_DAYS
    companies: tuple[str, ...] = ()
    wanted_remoteness: str = "ANY"
    threshold: float = SIMILARITY_THRESHOLD
    preserve: tuple[str, ...] = ("title", "status")
    rekey: bool = False
    inclusive: bool = False
    all_types: bool = False
    stop_words: tuple[str, ...] | None = None

    def _by_name(self, block_list: DataFrame | None, duplicates: DataFrame | None) -> dict:
        return {
            "as_of": self.as_of,
            "max_days": self.max_days,
            "companies": list(self.companies),
            "block_list": block_list,
            "duplicates": duplicates,
            "wanted_remoteness": self.wanted_remoteness,
            "all_types": self.all_types,
            "inclusive": self.inclusive,
        }

    def kept(self, df: DataFrame, block_list: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
        return filter_postings(df, **self._by_name(block_list, duplicates))

    def judged(self, df: DataFrame, block_list: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
        """With ``reject_reason``."""
        return with_reject_reason(df, **self._by_name(block_list, duplicates))


@dataclass(frozen=True)
class Refreshed:
    master: DataFrame
    block_list: DataFrame
    duplicates: DataFrame
    matches: DataFrame
    incoming: DataFrame
    rejected: DataFrame
    # By table, the rows that the run added or changed, and with ``_gone`` the keys that it took out.
    changes: dict[str, DataFrame]


def find_duplicates(
    existing: DataFrame, incoming: DataFrame, duplicates: DataFrame, rules: Rules, keys: DataFrame | None = None
) -> DataFrame:
    """All matches of incoming postings: by key, by the duplicates list, and by text for the rest.

    ``keys`` are those of ``existing``, if they are written already.
    """
    keys = staged(existing.select("key_id"), "keys") if keys is None else keys
    by_key = match_by_key(incoming, keys)
    known = match_known_duplicate(incoming, keys, duplicates, rules.all_types)
    rest = unmatched_incoming(incoming, keys, duplicates, rules.all_types)
    words = None if rules.stop_words is None else list(rules.stop_words)
    similar = best_match(rest, existing, rules.threshold, words)
    return by_key.unionByName(known).unionByName(similar)


def refresh_master(
    master: DataFrame | None,
    incoming: DataFrame,
    block_list: DataFrame,
    duplicates: DataFrame,
    rules: Rules,
    snapshots: str | None = None,
    version: str = "1",
    counts: RunCounts | None = None,
) -> Refreshed:
    """The tables after a run. ``incoming`` has the columns of a posting and ``ordinal``, a different
    whole number for every row, in the order of collection.

    The block list takes the master's removals before anything is filtered. Known duplicates stay
    through the filter, since they may carry news about their original. The master is filtered by the
    same rules, and matching sees what is left of it. Incoming rows without a key are returned as ``rejected``.
    With ``snapshots``, a folder, what was collected is kept there under the day of the rules before any rule
    is applied, which is what ``recover`` starts from. ``counts`` takes those of the rows collected, one a key,
    rejected, read and matched, while the run writes them; the tables returned are lazy, and their writer may count them.
    """
    rejected = without_key(incoming)
    incoming = first_wins(incoming, ["ordinal"])
    if snapshots is not None:
        incoming = staged(incoming, "collected")
        write_snapshot(incoming, snapshots, rules.as_of, version)
    # Rows with a removal status go by that status, so the master needs only the entries of earlier runs.
    entries = block_list.limit(0) if master is None else new_block_entries(block_list, master)
    blocked = block_list if master is None else block_list.unionByName(entries)
    # A day's rows are read many times below and cost a shuffle, so they are written once. The master
    # is not: it is stored as Parquet already, and each reader below takes few of its columns.
    judged = rules.judged(incoming, blocked)
    judged = judged if counts is None else counts.judged(judged)
    incoming = staged(dated(split_by_reason(judged, "reject_reason")[0]), "incoming")
    if master is None:
        nothing = incoming.sparkSession.createDataFrame([], MATCH)
        fresh = incoming.drop("ordinal")
        changes = {"master": fresh, "block_list": block_list, "duplicates": duplicates}
        return Refreshed(fresh, blocked, duplicates, nothing, incoming, rejected, changes)

    existing = dated(rules.kept(master, block_list))
    known = rules.judged(master, block_list)
    known = known if counts is None else counts.all_rows(known, "read")
    keys = staged(split_by_reason(known, "reject_reason")[0].select("key_id"), "keys")
    found = find_duplicates(existing, incoming, duplicates, rules, keys)
    matches = staged(found if counts is None else counts.matched(found), "matches")
    updated = update_if_newer(existing, matches, incoming, rules.preserve, rules.rekey)
    changes = {
        "master": _master_changes(master, block_list, existing, matches, incoming, rules),
        "block_list": entries,
        "duplicates": duplicate_entries(matches, incoming),
    }
    return Refreshed(
        append_new(updated, incoming, matches),
        blocked,
        upsert_duplicates(duplicates, matches, incoming),
        matches,
        incoming,
        rejected,
        changes,
    )


def _master_changes(
    master: DataFrame, block_list: DataFrame, existing: DataFrame, matches: DataFrame, incoming: DataFrame, rules: Rules
) -> DataFrame:
    """Rows updated or new, and ``_gone`` keys that a rule rejects or that an update renamed.

    A key that goes and comes again in one run is a change only. Rows of a master that still lack a date, which
    a run fills, count as unchanged: readers of a state that runs have written never meet any.
    """
    columns = master.columns
    updated = update_if_newer(existing, matches, incoming, rules.preserve, rules.rekey, changed_only=True)
    fresh = fresh_rows(incoming, matches, columns)
    here = updated.unionByName(fresh).withColumn("_gone", F.lit(False))
    gone = rules.judged(master, block_list).where("reject_reason is not null").select("key_id")
    if rules.rekey:
        renamed = matches.where("original_key_id != duplicate_key_id").select(F.col("original_key_id").alias("key_id"))
        still = update_if_newer(existing, matches, incoming, rules.preserve, False, changed_only=True).select("key_id")
        gone = gone.unionByName(renamed.join(still, "key_id", "left_semi")).distinct()
    gone = gone.join(fresh.select("key_id").unionByName(updated.select("key_id")), "key_id", "left_anti")
    types = {f.name: f.dataType for f in master.schema.fields}
    empty = [F.col("key_id") if c == "key_id" else F.lit(None).cast(types[c]).alias(c) for c in columns]
    return here.unionByName(gone.select(*empty, F.lit(True).alias("_gone")))


def empty_block_list(postings: DataFrame) -> DataFrame:
    return block_entry(postings).limit(0)


def empty_duplicates(postings: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return empty_block_list(postings).withColumns({"dup_type": none, "original_key_id": none})
