"""Shards of nearly equal size by sampled splitters, with DataFrame functions only.

Every row has a key: the hash of its text, then a hash of its id and place. A sample of keys, drawn in
proportion to size, gives the splitters, which are quantiles of the sample, and rows are range-partitioned
by them. Ranges that turn out overfull are sampled again and subdivided. Since there are many more ranges
than shards, the ranges are then dealt out to the shards, heaviest first, each to the lightest shard.
Equal texts have equal first key parts, so they share a range and a shard; only a text whose copies
outweigh half a shard is spread, in pieces of that size.
"""

from __future__ import annotations

import heapq
import json
import math
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from roleledger.llm.tables import staged

SHARDS = 16
# Ranges a shard has at least, and the bytes of a range beyond that; no more ranges than MAX_RANGES.
RANGES_A_SHARD = 64
RANGE_BYTES = 64 << 20
MAX_RANGES = 16_384
# Keys drawn a range. The sample, the splitters and the ranges are all that the driver sees.
DRAWS = 16
# A range of more than this many times its due is subdivided, in so many rounds at most.
OVERFULL = 2
ROUNDS = 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int]


def splitters(sample: list[tuple[int, int, int]], step: int) -> list[Key]:
    """The first keys of the ranges: every ``step`` draws one, of a sample of (text, row, draws).

    A text with one splitter is not cut; one with several has a first and a last range of its own.
    """
    drawn, crossed = 0, []
    for text, row, draws in sorted(sample):
        if (drawn + draws) // step > drawn // step:
            crossed.append((text, row))
        drawn += draws
    found: set[Key] = set()
    for text, keys in groupby(crossed, lambda key: key[0]):
        keys = list(keys)
        found.add((text, LEAST))
        if len(keys) > 1:
            found.update(keys)
            found.add((text + 1, LEAST) if text < MOST else (text, MOST))
    return sorted(found)


def _range_of(firsts: list[Key]) -> Column:
    """The number of splitters at or before the key in ``h``, ``t``: found among blocks, then within one."""
    if not firsts:
        return F.lit(0)
    width = math.isqrt(len(firsts)) + 1
    blocks = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    key = F.struct(F.col("h").alias("h"), F.col("t").alias("t"))

    def literal(keys: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(keys)), kind)

    def named(keys: list[Key]) -> list[dict]:
        return [{"h": h, "t": t} for h, t in keys]

    heads = literal(named([b[0] for b in blocks]), "array<struct<h:bigint,t:bigint>>")
    inner = literal([named(b) for b in blocks], "array<array<struct<h:bigint,t:bigint>>>")
    block = F.size(F.filter(heads, lambda first: first <= key))
    within = F.size(F.filter(F.get(inner, block - 1), lambda first: first <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * width + within)


def _drawn(keys: DataFrame, rate: float, total: int, count: int) -> list[tuple[int, int, int]]:
    """Keys and how often each is drawn: ``rate`` draws for half of all bytes, as many for half of all rows."""
    due = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / count)) * F.lit(rate / 2)
    dice = F.pmod(F.xxhash64("t", "h", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = keys.select("h", "t", F.floor(due + dice).alias("draws")).where("draws > 0")
    return [tuple(r) for r in drawn.collect()]


def _dealt(ranges: list, shards: int, total: int) -> dict[int, int]:
    """Range to shard: heaviest first to the lightest; neighbouring ranges of one text together, up to half a shard."""
    most = max(1, total // (2 * shards))
    units: list[tuple[int, int, list[int]]] = []
    last = None
    for r in sorted(ranges, key=lambda r: r["range"]):
        text = r["low"] if r["low"] == r["high"] else None
        if text is not None and text == last and units[-1][0] + r["bytes"] <= most:
            units[-1] = (units[-1][0] + r["bytes"], units[-1][1] + r["rows"], [*units[-1][2], r["range"]])
        else:
            units.append((r["bytes"], r["rows"], [r["range"]]))
        last = text
    lightest = [(0, 0, shard) for shard in range(shards)]
    where = {}
    for size, rows, numbers in sorted(units, key=lambda u: (-u[0], -u[1], u[2])):
        held, held_rows, shard = heapq.heappop(lightest)
        where.update(dict.fromkeys(numbers, shard))
        heapq.heappush(lightest, (held + size, held_rows + rows, shard))
    return where


def sharded(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` (``doc_id``, ``text``) with ``size``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text plus one, 1 for a null text. The sums of ``size`` of the shards
    are nearly equal: the unit of dealing is a range of 1/64 of a shard at most, or one row if that is
    larger, or copies of one text of up to half a shard. ``slot`` numbers the rows of a shard from 0
    without gaps. Repeated rows, rows without an id and without text are all placed, each once; null texts
    are copies of each other. An empty table gives an empty table. Columns of ``docs`` named as one of the
    three new ones are replaced; others are kept whatever their names. Rows are moved once, texts are never
    gathered by shard: the largest unit of work is a range.
    """
    rows = docs.select(F.struct("*").alias("row"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + 1
    text, place = F.xxhash64("row.text"), F.xxhash64("row.doc_id", F.monotonically_increasing_id())
    keyed = rows.select("row", size.alias("size"), text.alias("h"), place.alias("t"))
    keys = staged(keyed.select("size", "h", "t"), "keys")
    total, count = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    due = min(MAX_RANGES, max(shards * RANGES_A_SHARD, math.ceil(total / range_bytes)))
    firsts = splitters(_drawn(keys, due * DRAWS, total, count), DRAWS) if count else []
    for last in range(ROUNDS, -1, -1):
        numbered = keys.withColumn("range", _range_of(firsts))
        load = numbered.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high")
        )
        ranges = load.collect()
        over = [r["range"] for r in ranges if r["rows"] > 1 and (r["bytes"] / total + r["rows"] / count) * due / 2 > OVERFULL]
        if not over or not last:
            break
        crowded = numbered.join(F.broadcast(keys.sparkSession.createDataFrame([(r,) for r in over], "range int")), "range")
        more = splitters(_drawn(crowded, due * DRAWS * 4, total, count), DRAWS * 2)
        if set(more) <= set(firsts):
            break
        firsts = sorted({*firsts, *more})

    where = _dealt(ranges, shards, total)
    order = Window.partitionBy("range").orderBy("h", "t")
    ranged = keyed.withColumn("range", _range_of(firsts))
    placed = staged(ranged.select("row", "size", "range", (F.row_number().over(order) - 1).alias("at")), "ranges")
    # The numbers start from what was written, so they have no gaps whatever the counts before were.
    offsets, filled = [], [0] * shards
    for r in placed.groupBy("range").agg(F.count("*").alias("rows")).orderBy("range").collect():
        shard = where.get(r["range"], r["range"] % shards)
        offsets.append((r["range"], shard, filled[shard]))
        filled[shard] += r["rows"]
    # At most a few rows of three numbers for each of MAX_RANGES ranges.
    table = F.broadcast(docs.sparkSession.createDataFrame(offsets, "range int, shard int, first long"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in {"size", "shard", "slot"}]
    return placed.join(table, "range").select(*own, "size", "shard", (F.col("first") + F.col("at")).alias("slot"))
