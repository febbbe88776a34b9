"""Incremental forms, on Structured Streaming."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roleledger.operators.filters import drop_old
from roleledger.plans.refresh import Rules, empty_block_list, empty_duplicates, refresh_master
from roleledger.scratch import cleared
from roleledger.sources.state import RunState


def refresh_batch(state: RunState, rules: Rules) -> Callable[[DataFrame, int], None]:
    """What to do with one batch of collected rows: a run whose number is the batch's.

    A batch that was committed is skipped, and one that died is done again from the state before it,
    so every batch counts once, however often it is delivered. Only the rows that a batch changes are written.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if state.is_committed(batch_id) or batch.isEmpty():
            return
        before = state.latest_run(before=batch_id)
        block_list = state.read("block_list", before)
        duplicates = state.read("duplicates", before)
        # A stream runs for months: what a batch stages goes when its changes are committed.
        with cleared(state.spark):
            done = refresh_master(
                state.read("master", before),
                batch,
                empty_block_list(batch) if block_list is None else block_list,
                empty_duplicates(batch) if duplicates is None else duplicates,
                rules,
            )
            state.commit(batch_id, done.changes)

    return run


def stream_refresh(
    landed: DataFrame, state_root: str, checkpoint: str, rules: Rules
) -> StreamingQuery:
    """Take in everything that has landed since the last call, then stop. ``landed`` is a stream of
    collected rows with ``ordinal``."""
    state = RunState(landed.sparkSession, state_root)
    return (
        landed.writeStream.foreachBatch(refresh_batch(state, rules))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_first_wins(
    landed: DataFrame, event_time: str, delay: str, order: tuple[str, ...] = ("page_no", "pos"), span: str = "1 day"
) -> DataFrame:
    """The first row of every key by ``order``, for every span of event time, whatever order the rows arrive in.

    The state holds the smallest row so far of a key and span, one row each, and gives it out when the watermark,
    ``delay`` behind the newest event, has passed the span; then the state is dropped. Rows later than that are
    left out, and rows without a key are one key.
    """
    fields = F.struct(*landed.columns)
    held = landed.withWatermark(event_time, delay).groupBy(F.window(event_time, span), "key_id")
    first = held.agg(F.min_by(fields, F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def stream_drop_old(landed: DataFrame, as_of: dt.date, max_days: int) -> DataFrame:
    """The age rule against a given day. Not the watermark, which moves with the data."""
    return drop_old(landed, as_of, max_days)


def landed_postings(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
