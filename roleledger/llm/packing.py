"""Best-fit packing of documents into sequences, under conflicts.

Documents are dealt into shards of about the same number of rows by a hash, and each shard is packed in
one task: longest first, each document into the bin with the least room that still holds it and conflicts
with nothing in it. Bins are kept in order of their room; the search starts at the first that is large
enough and goes on until a compatible one is found, else a bin is opened. Each bin carries a bitmap with
one bit for every duplicate cluster and ``SOURCE_LIMIT`` bits for every source.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roleledger.llm.copies import copy_classes
from roleledger.llm.tables import bounded, staged

CAPACITY = 2048
SHARD_ROWS = 16_384
# Documents of one source that a bin may hold. One would leave bins half empty where a source owns a third of the rows.
SOURCE_LIMIT = 4


def best_fit(items: Iterable[tuple[int, list[int]]], capacity: int) -> list[int]:
    """The bin of each item (length, choices); the items come longest first.

    An item takes up the first of its choices, which are bitmaps, that shares no bit with the bin.
    """
    rooms: list[tuple[int, int]] = []
    taken: list[int] = []
    where = []
    for length, choices in items:
        for i in range(bisect_left(rooms, (length, -1)), len(rooms)):
            room, number = rooms[i]
            free = next((c for c in choices if not c & taken[number]), None)
            if free is not None:
                del rooms[i]
                break
        else:
            number, room, free = len(taken), capacity, choices[0]
            taken.append(0)
        taken[number] |= free
        if room > length:
            insort(rooms, (room - length, number))
        where.append(number)
    return where


def choices(sources: list[str | None], clusters: list[int | None], limit: int) -> Iterator[list[int]]:
    """The bitmaps each item may take up: a slot of its source, with the bit of its cluster if others share that.

    Made one item at a time, since a bitmap may be as long as there are sources and clusters.
    """
    number = {source: i for i, source in enumerate(dict.fromkeys(sources))}
    counts = Counter(c for c in clusters if c is not None)
    shared = {c: i for i, c in enumerate(c for c, n in counts.items() if n > 1)}
    base = len(number) * limit
    for source, cluster in zip(sources, clusters, strict=True):
        own = 1 << (base + shared[cluster]) if cluster in shared else 0
        yield [own | 1 << (number[source] * limit + slot) for slot in range(limit)]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def text_cluster(text: Column) -> Column:
    """A cluster of the texts that differ in case and white space only; null for those without words."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.coalesce(plain, F.lit("")) != "", F.xxhash64(plain))


def pack(
    docs: DataFrame,
    length: Column,
    cluster: Column,
    capacity: int = CAPACITY,
    source_limit: int = SOURCE_LIMIT,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``bin`` for every piece of every row of ``docs``.

    A document longer than ``capacity`` is cut into pieces: full ones fill bins of their own, and the rest
    is packed with the others. A bin holds one document of a cluster and ``source_limit`` of a source; a
    null cluster conflicts with nothing, a null source is a source. Documents of length 0 or null have one
    row, of length 0 and without a bin. Repeated rows are packed each. All rows are packed; ``bin`` is
    unique over the shards.
    """
    measured = docs.select(
        "doc_id", "source", F.coalesce(length, F.lit(0)).cast("int").alias("total"), cluster.cast("long").alias("cluster")
    )
    shards = max(1, math.ceil(docs.count() / shard_rows))
    # Equal rows are dealt out as well.
    place = F.monotonically_increasing_id()
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "total", place), F.lit(shards)).cast("int")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("int"))
    cut = measured.withColumn("shard", shard).withColumn("piece", F.explode(pieces))
    start = F.col("piece") * capacity
    cut = cut.select(
        "shard", "doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).alias("length")
    )

    def packed(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("piece", "ascending"), ("source", "ascending")]
        table = table.sort_by(order)
        lengths = table["length"].to_pylist()
        some = sum(n > 0 for n in lengths)
        bits = choices(table["source"].to_pylist()[:some], table["cluster"].to_pylist()[:some], source_limit)
        first = table["shard"][0].as_py() << 32
        bins = [first + b for b in best_fit(zip(lengths[:some], bits, strict=True), capacity)]
        bins += [None] * (len(lengths) - some)
        return table.select(["doc_id", "piece", "start", "length"]).append_column("bin", pa.array(bins, pa.int64()))

    schema = "doc_id long, piece int, start int, length int, bin long"
    return cut.groupBy("shard").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` of ``docs`` (``doc_id``, ``source``, ``text``; others are ignored) by their words, where copies and
    near copies are a cluster: the classes of ``copy_classes``. Texts without words conflict with nothing."""
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    docs = docs.select("doc_id", "source", "text", row.alias("row"))
    classes = copy_classes(docs.where("text is not null").select("row", "text")).dropDuplicates(["row"])
    # Texts stay behind: what is packed is their lengths, which were counted with the classes.
    clustered = docs.select("doc_id", "source", "row").join(bounded(staged(classes, "classes")), "row", "left")
    return pack(staged(clustered, "measured"), F.col("words"), F.col("class"))
