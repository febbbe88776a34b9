"""Reject rules. A missing value never rejects a row, so every test is true or false, not null."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roleledger.schema import MIN_DESCRIPTION_CHARS, NEW_TFIDF, EXISTING_TFIDF, REMOVAL_STATUSES


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def has_removal_status() -> Column:
    return _true(F.col("status").isin(*REMOVAL_STATUSES))


def has_blocked_company(companies: list[str]) -> Column:
    return _true(F.col("company").isin(*companies)) if companies else F.lit(False)


def is_old(as_of: dt.date, max_days: int, inclusive: bool = False) -> Column:
    """Older than ``max_days`` at ``as_of``; ``inclusive`` also takes a row of exactly that age."""
    oldest = F.lit(as_of - dt.timedelta(days=max_days))
    posted = F.col("post_date")
    return _true(posted <= oldest if inclusive else posted < oldest)


def has_wrong_remoteness(wanted: str) -> Column:
    if wanted == "ANY":
        return F.lit(False)
    return _true(~F.col("remoteness").isin("UNKNOWN", wanted))


def drop_removed_status(df: DataFrame) -> DataFrame:
    return df.where(~has_removal_status())


def drop_blocked_company(df: DataFrame, companies: list[str] | DataFrame) -> DataFrame:
    """``companies``: the names of a search, or a table of them with a column ``company``.

    The anti join keeps rows without a company. Its right side holds each name once, so a company
    that owns many rows costs one lookup per row.
    """
    if isinstance(companies, DataFrame):
        return df.join(companies.select("company").distinct(), "company", "left_anti")
    return df.where(~has_blocked_company(companies))


def drop_old(df: DataFrame, as_of: dt.date, max_days: int, inclusive: bool = False) -> DataFrame:
    return df.where(~is_old(as_of, max_days, inclusive))


def drop_block_listed(df: DataFrame, block_list: DataFrame) -> DataFrame:
    return df.join(block_list.select("key_id").distinct(), "key_id", "left_anti")


def removable_duplicates(duplicates: DataFrame, all_types: bool = False) -> DataFrame:
    """Entries that say a posting repeats another one's text; key matches are updates of the posting
    itself and stay, unless ``all_types``."""
    if all_types:
        return duplicates
    return duplicates.where(F.col("dup_type").isin(NEW_TFIDF, EXISTING_TFIDF))


def drop_known_duplicates(df: DataFrame, duplicates: DataFrame, all_types: bool = False) -> DataFrame:
    known = removable_duplicates(duplicates, all_types).select("key_id").distinct()
    return df.join(known, "key_id", "left_anti")


def drop_wrong_remoteness(df: DataFrame, wanted: str) -> DataFrame:
    return df.where(~has_wrong_remoteness(wanted))


def with_reject_reason(
    df: DataFrame,
    *,
    as_of: dt.date,
    max_days: int | None,
    companies: list[str] | None = None,
    block_list: DataFrame | None = None,
    duplicates: DataFrame | None = None,
    wanted_remoteness: str = "ANY",
    all_types: bool = False,
    inclusive: bool = False,
) -> DataFrame:
    """Add ``reject_reason``, the first rule that rejects the row, or null.

    Both key lists are folded into one small row per key first, so the postings are shuffled once
    at most, and not at all while the lists are small enough for a broadcast.
    """
    lists = []
    if block_list is not None:
        lists.append(block_list.select("key_id", F.lit(True).alias("_blocked"), F.lit(False).alias("_known")))
    if duplicates is not None:
        known = removable_duplicates(duplicates, all_types)
        lists.append(known.select("key_id", F.lit(False).alias("_blocked"), F.lit(True).alias("_known")))
    blocked = known = F.lit(False)
    if lists:
        flags = (
            reduce(DataFrame.unionByName, lists)
            .groupBy("key_id")
            .agg(F.max("_blocked").alias("_blocked"), F.max("_known").alias("_known"))
        )
        df = df.join(flags, "key_id", "left")
        blocked, known = _true(F.col("_blocked")), _true(F.col("_known"))
    reason = (
        F.when(has_removal_status(), "status")
        .when(has_blocked_company(companies or []), "company")
        .when(F.lit(False) if max_days is None else is_old(as_of, max_days, inclusive), "age")
        .when(blocked, "block list")
        .when(known, "known duplicate")
        .when(has_wrong_remoteness(wanted_remoteness), "remoteness")
    )
    return df.withColumn("reject_reason", reason).drop("_blocked", "_known")


def filter_postings(df: DataFrame, **rules) -> DataFrame:
    """Rows that no rule rejects; the rules are those of ``with_reject_reason``."""
    return with_reject_reason(df, **rules).where(F.col("reject_reason").isNull()).drop("reject_reason")


def _unset(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def with_invalid_reason(df: DataFrame) -> DataFrame:
    """Add ``invalid_reason``, the first thing wrong with a finished posting, or null."""
    short = F.coalesce(F.length("description"), F.lit(0)) < MIN_DESCRIPTION_CHARS
    return df.withColumn(
        "invalid_reason",
        F.when(_unset("key_id"), "key unset")
        .when(_unset("title"), "title unset")
        .when(_unset("company"), "company unset")
        .when(_unset("url"), "url unset")
        .when(short, "description too short"),
    )


REQUIRED_FIELDS = ["title", "company", "location", "key_id", "url"]


def with_missing_field(df: DataFrame) -> DataFrame:
    """Add ``missing_field``, the first required field that extraction did not find, or null."""
    found = [F.when(_unset(name), name) for name in REQUIRED_FIELDS]
    return df.withColumn("missing_field", F.coalesce(*found))


def split_by_reason(df: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the quarantine: rows with their reason."""
    return df.where(F.col(reason).isNull()).drop(reason), df.where(F.col(reason).isNotNull())


def validate_postings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(with_invalid_reason(df), "invalid_reason")


def required_fields(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by_reason(with_missing_field(df), "missing_field")
