"""N-gram Jaccard join by prefixes of token combinations.

The tokens of a document are its distinct shingles, ordered rare ones first. If two sets are similar,
at most ``n - ceil(t * n)`` tokens of either are not shared. So a prefix with one token more shares a
token. Frequent tokens are dealt into parts, and only pairs of tokens of the same part are indexed: a
prefix that may share one token of each part without sharing a pair has to be longer by one token per
part, and that is how far it is extended. Whoever shares an indexed token or pair is a candidate, and
candidates are compared by their whole sets.

An entry of a rare token also says how many tokens of its set do not come before it, and one of a pair how
many tokens of its set are frequent. If the entry is the first that two sets share, they share no more
tokens than the smaller of these numbers, and where this falls short the entry need not pair them.

Candidates under one index entry are not all paired with each other. Each is compared with the smallest
of them first, then with others chosen by a hash of entry and round; what the links so found already
connect needs no further look, and who was compared with all others leaves the entry. After these rounds the
members of an entry that are still in different components are compared, so that no link between components is
missed: in cells, where bitmaps of the sets meet in one task, so that only pairs that may be similar leave it. Two sets that share a passage share
many entries: where the entry before, in the order of their tokens, is the same for all, they met there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roleledger.llm.components import components
from roleledger.llm.tables import MAX_BROADCAST_ROWS, bounded, members, settled, staged
from roleledger.llm.words import mixed, shingles, word_hashes

THRESHOLD = Fraction(75, 100)
# A shingle in more than this share of the documents is frequent. The number of such shingles is at most
# the mean size of a set divided by this share, however many documents there are.
FREQUENT_SHARE = 1 / 2048
MAX_FREQUENT = 1_000_000
# Shingles counted at a time inside a task, and how many documents of them must hold a frequent one.
CHUNK = 4_000_000
MIN_COUNT = 4
# Tokens of a part, were all tokens of the smallest document of a size class frequent.
PART = 4
# Index entries of frequent tokens are split among so many tasks.
SALTS = 16
# Tokens that are kept of a set for its index entries, beyond those it needs if all were rare.
SPARE = 8
# The bitmap that goes with a set into the last comparison has at least so many bits a token.
BITS = 2
# Members of an entry that are compared in one cell, or of either side of one, and pairs and words of bitmaps looked at together.
CELL = 1024
TRIES = 1 << 18
# Further rounds of comparing the members of an entry with one of them.
ROUNDS = 1


def row_key() -> Column:
    """A hash of a row's doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    tokens = np.sort(shingles(word_hashes(text), width))
    return tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens


def set_key(tokens: np.ndarray) -> int:
    return int(xxhash.xxh3_64_intdigest(tokens.tobytes())) - (1 << 63)


def histogram(tokens: np.ndarray) -> bytes:
    """Number of tokens (at most 255) in each bucket of their hash; a power of two of buckets, about half as many as tokens."""
    buckets = 1 << max(len(tokens) // 2, 1).bit_length()
    counts = np.bincount((tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each value of the tokens' middle bits, set if one has it; 64 times a power of two of bits."""
    size = 64 << max(0, (BITS * len(tokens) - 1).bit_length() - 6)
    held = np.zeros(size, bool)
    held[(tokens >> np.uint64(32)) & np.uint64(size - 1)] = True
    return np.packbits(held).tobytes()


def may_share(one: bytes, two: bytes) -> int:
    """An upper bound of the number of tokens that the sets of two histograms share."""
    left, right = sorted((np.frombuffer(x, np.uint8).astype(np.int64) for x in (one, two)), key=len)
    right = right.reshape(-1, len(left)).sum(axis=0)
    full = (left == 255) | (right >= 255)
    return int(np.minimum(left, right).sum()) if not full.any() else 1 << 62


def size_classes(largest: int, threshold: Fraction) -> list[int]:
    """Smallest sizes of the classes; two sets whose sizes allow similarity are in the same or neighbouring ones."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(int(starts[-1] / threshold) + 1)
    return starts


def prefix(n: int, threshold: Fraction) -> int:
    """How many tokens of a set of ``n`` are indexed, if all are rare."""
    return n - -(-n * threshold.numerator // threshold.denominator) + 1


def head(n: int, threshold: Fraction) -> int:
    """How many tokens of a set of ``n`` are kept for its index entries."""
    return prefix(n, threshold) * 5 // 4 + SPARE


def frequent_among(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which of the tokens are in the sorted list of frequent ones."""
    found = np.minimum(np.searchsorted(frequent, tokens), max(len(frequent) - 1, 0))
    return frequent[found] == tokens if len(frequent) else np.zeros(len(tokens), bool)


def index_entries(tokens: np.ndarray, frequent: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries of a sorted token set: of rare tokens, and of frequent tokens or their pairs; how many are frequent."""
    n = len(tokens)
    needed = prefix(n, threshold)
    if n == 0:
        return tokens, tokens, 0
    common = frequent_among(tokens, frequent)
    rare, usual = tokens[~common], tokens[common]
    if len(rare) >= needed:
        return rare[:needed], tokens[:0], len(usual)
    needed -= len(rare)
    starts = size_classes(n, threshold)
    own = int(np.searchsorted(starts, n, "right")) - 1
    entries = []
    for scheme in {own, max(own - 1, 0)}:
        parts = starts[scheme] // PART
        if not parts:
            entries.append(usual[:needed])
            continue
        part = mixed(usual + np.uint64(scheme)) % np.uint64(parts)
        seconds = np.ones(len(usual), np.int64)
        seconds[np.unique(part, return_index=True)[1]] = 0
        end = int(np.searchsorted(np.cumsum(seconds), needed)) + 1
        order = np.argsort(part[:end], kind="stable")
        part, chosen = part[:end][order], usual[:end][order]
        for lag in range(1, len(part)):
            same = part[lag:] == part[:-lag]
            if not same.any():
                break
            entries.append(mixed(mixed(chosen[:-lag][same] + np.uint64(scheme + 1)) ^ chosen[lag:][same]))
    return rare, np.unique(np.concatenate(entries)), len(usual)


def _profile(width: int, share: float, threshold: Fraction):
    """A row per document with its set, and rows with shingles that many documents of a chunk hold.

    ``head`` are the first tokens of the set, so that most texts are cut into shingles once.
    """
    names = ["doc_id", "row_key", "n_shingles", "set_key", "buckets", "bits", "head", "shingle", "docs"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One buffer a task, sorted where it lies.
        chunk, size, held = np.empty(CHUNK, np.uint64), 0, 0

        def counted() -> pa.RecordBatch:
            own = chunk[:size]
            own.sort()
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(starts, append=size)
            many = counts >= max(MIN_COUNT, share * held)
            none = pa.nulls(int(many.sum()), pa.int64())
            values = own[starts[many]].view(np.int64)
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, *[pa.nulls(len(none), pa.binary())] * 3, pa.array(values), pa.array(counts[many])], names
            )

        for batch in batches:
            sizes, keys, buckets, bits, heads = [], [], [], [], []
            for text in batch.column(2):
                tokens = shingle_set(text.as_py(), width)
                sizes.append(len(tokens))
                keys.append(set_key(tokens) if len(tokens) else None)
                buckets.append(histogram(tokens))
                bits.append(bitmap(tokens))
                heads.append(tokens[: head(len(tokens), threshold)].tobytes())
                if size + len(tokens) > CHUNK and size:
                    yield counted()
                    size, held = 0, 0
                # A set beyond the buffer is counted by its first part, which costs time only.
                part = tokens[: CHUNK - size]
                chunk[size : size + len(part)] = part
                size, held = size + len(part), held + 1
            none = pa.nulls(len(sizes), pa.int64())
            numbers, raw = (pa.array(x, pa.int64()) for x in (sizes, keys)), (pa.array(x, pa.binary()) for x in (buckets, bits, heads))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, *raw, none, none], names)
        if size:
            yield counted()

    return rows


def _frequent(profile: DataFrame, share: float) -> np.ndarray:
    """The frequent shingles, sorted; fewer if they would not fit, which costs time only."""
    documents = profile.where("n_shingles is not null").count()
    counts = profile.where("shingle is not null").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    counts = staged(counts.where(F.col("docs") >= share * documents), "frequent")
    least = share * documents
    while counts.where(F.col("docs") >= least).count() > MAX_FREQUENT:
        least *= 2
    found = counts.where(F.col("docs") >= least).select("shingle").toPandas()["shingle"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _index(sets: DataFrame, docs: DataFrame, width: int, threshold: Fraction, frequent: np.ndarray) -> DataFrame:
    """``entry``, ``salt``, ``set_key``, ``n``, ``room`` for all sets.

    ``salt`` is 0 if the entry is one of a rare token; ``room`` is how many tokens don't come before it.
    A set with other entries has all its rare tokens indexed, so these need only pair sets that share
    none of them, and ``room`` is the number of its frequent tokens. ``sets`` are rows ``doc_id``, ``set_key``,
    ``n_shingles``, ``head``; where too few tokens of the head are rare, the set is made again from the text in ``docs``.
    """
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def lacking(tokens: np.ndarray, n: int) -> bool:
        """Whether the entries take tokens beyond the head."""
        first = tokens[: head(n, threshold)]
        return len(first) < n and len(first) - int(frequent_among(first, held.value).sum()) < prefix(n, threshold)

    def entries(sets: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        keys, sizes, commons, rare, usual = [], [], [], [], []
        for key, n, tokens in sets:
            if len(tokens) < n:
                one, two, common = tokens[~frequent_among(tokens, held.value)][: prefix(n, threshold)], tokens[:0], 0
            else:
                one, two, common = index_entries(tokens, held.value, threshold)
            keys.append(key)
            sizes.append(n)
            commons.append(common)
            rare.append(one.view(np.int64))
            usual.append(two.view(np.int64))
        numbers = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(commons, pa.int32())]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (rare, usual)]
        return pa.RecordBatch.from_arrays([*numbers, *lists], ["set_key", "n", "common", "rare", "usual"])

    def heads(batch: pa.RecordBatch) -> list[tuple[int, int, np.ndarray]]:
        key, n, first = (batch.column(c).to_pylist() for c in ("set_key", "n_shingles", "head"))
        return [(k, size, np.frombuffer(x, np.uint64)) for k, size, x in zip(key, n, first, strict=True)]

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield entries([(key, n, tokens) for key, n, tokens in heads(batch) if not lacking(tokens, n)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id"]).filter(pa.array([lacking(tokens, n) for _, n, tokens in heads(batch)], pa.bool_()))

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [shingle_set(text, width) for text in batch.column(0).to_pylist()]
            yield entries([(set_key(tokens), len(tokens), tokens) for tokens in whole if lacking(tokens, len(tokens))])

    wanted = staged(sets.mapInArrow(short, "doc_id long").distinct(), "short")
    texts = members(docs, wanted, "doc_id").select("text")
    if not wanted.where("doc_id is null").isEmpty():
        texts = texts.unionByName(docs.where("doc_id is null").select("text"))
    schema = "set_key long, n int, common int, rare array<long>, usual array<long>"
    found = sets.mapInArrow(of_heads, schema).unionByName(texts.mapInArrow(of_texts, schema))
    salt = 1 + F.pmod(F.hash("set_key"), F.lit(SALTS))
    split = F.concat(
        F.transform("rare", lambda e, i: F.struct(e.alias("entry"), F.lit(0).alias("salt"), (F.col("n") - i).alias("room"))),
        F.transform("usual", lambda e: F.struct(e.alias("entry"), salt.alias("salt"), F.col("common").alias("room"))),
    )
    return found.select("set_key", "n", F.explode(split).alias("e")).select("e.entry", "e.salt", "set_key", "n", "e.room")


def _possible(one: str, two: str, threshold: Fraction) -> Column:
    """Whether two sets (columns ``n``, ``room`` of two structs) can be similar if an entry is the first they share."""
    least = F.least(f"{one}.room", f"{two}.room").cast("long")
    total = (F.col(f"{one}.n") + F.col(f"{two}.n")).cast("long")
    return least * (threshold.numerator + threshold.denominator) >= total * threshold.numerator


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``set_key``, ``tokens``: the sorted sets of the documents in ``ids``, eight bytes a token."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["set_key", "tokens"],
            )

    return members(docs, ids, "doc_id").select("text").mapInArrow(rows, "set_key long, tokens binary")


def _compared(pairs: DataFrame, table: DataFrame, column: str, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs ``a``, ``b`` whose values of ``column`` in ``table`` are alike."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Views of the batch: the values are not copied.
            kept = [alike(one.as_buffer(), two.as_buffer()) for one, two in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    first = table.select(F.col("set_key").alias("a"), F.col(column).alias("one"))
    second = table.select(F.col("set_key").alias("b"), F.col(column).alias("two"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "one", "two")
    return both.mapInArrow(rows, "a long, b long")


def _cells(placed: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Rows ``cell``, ``side``, ``key``, ``n``, ``room``, ``part``, ``bits``: the members of entries, dealt into cells.

    Entries whose members all have the same entry before are left out: as ``room`` falls along the order, two sets
    that may be similar by an entry may be so by an earlier one they share. Sets that meet once often meet again, so
    entries with the same ``hub`` are one cell, where a set comes once. A cell with more than ``CELL``
    members is dealt into blocks, and each pair of blocks is a cell; ``side`` is the block, or null in a cell of one block.
    """
    before = F.lag("entry").over(W.partitionBy("x.set_key").orderBy(F.desc("x.room"), "entry"))
    rows = staged(placed.select("entry", "x", "hub", before.alias("before")), "before")
    kept = (F.count("before") < F.count("*")) | (F.min("before") != F.max("before"))
    hubs = rows.groupBy("entry").agg(kept.alias("kept"), F.min("hub").alias("hub")).where("kept").select("entry", "hub")
    rows = rows.drop("hub").join(hubs, "entry").select("hub", F.col("x.set_key").alias("key"), "x.n", "x.room", "x.part")
    rows = rows.groupBy("hub", "key").agg(F.first("n").alias("n"), F.max("room").alias("room"), F.first("part").alias("part"))
    rows = rows.join(rows.groupBy("hub").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks")), "hub")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("own")
    rows = rows.select("*", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = F.xxhash64("hub", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    rows = staged(rows.select(cell, F.when(F.col("own") != F.col("other"), F.col("own")).alias("side"), "key", "n", "room", "part"), "cells")
    wanted = staged(rows.select(F.col("key").alias("set_key")).distinct(), "wanted")
    bitmaps = members(bitmaps, wanted, "set_key").dropDuplicates(["set_key"])
    return rows.join(bitmaps.withColumnRenamed("set_key", "key"), "key")


def _cell_pairs(table: pa.Table, threshold: Fraction) -> pa.RecordBatch:
    """The pairs ``a``, ``b`` of whole cells, which lie together, that the bitmaps leave similar: a bit that only one set has is a token that only it has."""
    cell, key, n, room, part = (table[c].to_numpy() for c in ("cell", "key", "n", "room", "part"))
    side, whole = table["side"].fill_null(0).to_numpy(), table["side"].is_null().to_numpy()
    held = [np.frombuffer(x, np.uint64) for x in table["bits"].to_pylist()]
    width = np.array([len(x) for x in held])
    # For each width, the bitmaps that have it or are folded to it, and their places.
    place, folded = {}, {}
    for size in np.unique(width).tolist():
        wide = np.flatnonzero(width >= size)
        place[size] = np.cumsum(width >= size) - 1
        folded[size] = np.stack([np.bitwise_or.reduce(held[x].reshape(-1, size)) for x in wide])

    def enough(most: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return most * (threshold.numerator + threshold.denominator) >= (n[i] + n[j]) * threshold.numerator

    def most(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        """How many tokens the pairs may share."""
        one, two = folded[size][place[size][i]], folded[size][place[size][j]]
        only = [np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((one, two), (two, one))]
        return np.minimum(n[i] - only[0], n[j] - only[1])

    later = np.searchsorted(cell, cell, "right") - np.arange(len(cell)) - 1
    tries, at, found = np.cumsum(later), 0, []
    while at < len(cell):
        done = tries[at] - later[at]
        end = max(at + 1, int(np.searchsorted(tries, done + TRIES, "right")))
        i = np.repeat(np.arange(at, end), later[at:end])
        j = i + 1 + np.arange(len(i)) - (tries[i] - later[i] - done)
        kept = (part[i] != part[j]) & (whole[i] | (side[i] != side[j]))
        i, j = i[kept], j[kept]
        kept = enough(np.minimum(room[i], room[j]), i, j)
        i, j = i[kept], j[kept]
        narrow = np.minimum(width[i], width[j])
        for size in np.unique(narrow).tolist():
            every = np.flatnonzero(narrow == size)
            step = max(1, TRIES // size)
            for k in range(0, len(every), step):
                x, y = i[every[k : k + step]], j[every[k : k + step]]
                kept = enough(most(x, y, size), x, y)
                found.append(np.stack([key[x[kept]], key[y[kept]]]))
        at = end
    pairs = np.concatenate([np.empty((2, 0), np.int64), *found], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], ["a", "b"])


def _compared_in_cells(cells: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs ``a``, ``b`` of members of a cell, in different components, that may be similar.

    What they are compared by meets in the task of the cell, so only pairs that pass leave it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            # The last cell may go on in the next batch.
            end = int(np.searchsorted(table["cell"].to_numpy(), table["cell"][-1].as_py())) if len(table) else 0
            if end:
                yield _cell_pairs(table.slice(0, end), threshold)
            rest = table.slice(end)
        if rest is not None and len(rest):
            yield _cell_pairs(rest, threshold)

    numbers = [F.col(c).cast("long").alias(c) for c in ("key", "n", "room", "part")]
    dealt = cells.select("cell", "side", *numbers, "bits").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(rows, "a long, b long").distinct()


def jaccard_join(
    docs: DataFrame, width: int = 5, threshold: Fraction = THRESHOLD, share: float = FREQUENT_SHARE
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``row_key``, ``part`` for every row of ``docs`` (``doc_id``, ``text``; others are ignored).

    A set holds the distinct shingles of ``width`` words, or the whole sequence if there are fewer words.
    Documents whose sets have a Jaccard similarity of at least ``threshold`` are linked, and the component
    is the smallest doc_id reachable. Null and empty texts have no shingles and are linked with nothing.
    A repeated doc_id gives a row each time; a null doc_id takes part, and its component is null only if
    no row reached has an id. Equal sets cost one set. Results don't depend on ``share``. ``row_key`` is that of
    ``row_key()``, equal for rows of equal id and text only; ``part`` names the component, whether or not its rows
    have ids, and is null for rows without shingles.
    """
    return settled(docs.sparkSession, "groups", lambda: _joined(docs.select("doc_id", "text"), width, threshold, share))


def _joined(docs: DataFrame, width: int, threshold: Fraction, share: float) -> DataFrame:
    profile = staged(
        docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(
            _profile(width, share, threshold),
            "doc_id long, row_key long, n_shingles long, set_key long, buckets binary, bits binary, head binary, shingle long, docs long",
        ),
        "profile",
    )
    rows = profile.where("n_shingles is not null").select("doc_id", "row_key", "n_shingles", "set_key")
    sets_of = rows.where("set_key is not null").groupBy("set_key")
    classes = staged(sets_of.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    repeated = classes.where("copies > 1 and first_id is not null").select("set_key", "first_id")
    copies = staged(
        rows.join(bounded(repeated), "set_key").where("doc_id != first_id").select("doc_id").distinct(), "copies"
    )
    # A repeated doc_id may be a copy in one row and not in the other.
    copies = staged(members(copies, classes.select(F.col("first_id").alias("doc_id")), "doc_id", "left_anti"), "copies")
    sets = profile.where("set_key is not null").select("doc_id", "set_key", "n_shingles", "head")
    index = _index(members(sets, copies, "doc_id", "left_anti"), docs, width, threshold, _frequent(profile, share))

    entry = W.partitionBy("entry", "salt")
    own = F.struct("set_key", "n", "room").alias("own")
    held = {"least": F.min("own"), "most": F.max("own"), "rows": F.count("*"), "n": F.min("own.n"), "room": F.max("own.room")}
    shared = index.select("entry", "salt", own).select("entry", "salt", "own", *(f.over(entry).alias(k) for k, f in held.items()))
    # Of most entries the two rows decide; of others, whether the row fits the best one could wish for.
    best = F.col("rows") == 2
    fits = F.when(best, _possible("least", "most", threshold)).otherwise(_possible("own", "wish", threshold))
    shared = shared.withColumn("wish", F.struct("n", "room"))
    shared = shared.where("salt > 0 or least.set_key != most.set_key").where((F.col("salt") > 0) | fits)
    shared = shared.select("entry", "salt", "own", "least")
    shared = staged(shared, "shared")
    near = shared.select(F.col("least").alias("x"), F.col("own").alias("y"))
    # The entries of frequent tokens were split by salt: their smallest members meet here.
    heads = shared.where("salt > 0").select("entry", "least").distinct()
    heads = heads.join(heads.groupBy("entry").agg(F.min("least").alias("x")), "entry")
    near = near.unionByName(heads.select("x", F.col("least").alias("y")))

    def pairs_of(both: DataFrame) -> DataFrame:
        """``a``, ``b`` of the structs ``x``, ``y`` that may be similar."""
        may = both.where("x.set_key != y.set_key").where(_possible("x", "y", threshold))
        return may.select(F.least("x.set_key", "y.set_key").alias("a"), F.greatest("x.set_key", "y.set_key").alias("b")).distinct()

    pairs = staged(pairs_of(near), "pairs")

    def enough(shared: int, left: int, right: int) -> bool:
        return shared * threshold.denominator >= (left + right - shared) * threshold.numerator

    def may_link(one: bytes, two: bytes) -> bool:
        left, right = (int(np.frombuffer(x, np.uint8).astype(np.int64).sum()) for x in (one, two))
        bound = may_share(one, two)
        return bound > left + right or enough(min(bound, left, right), left, right)

    def links_in(one: bytes, two: bytes) -> bool:
        left, right = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
        return enough(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right))

    def wanted(pairs: DataFrame) -> DataFrame:
        """The sets of staged pairs; each once, if they are too many for a broadcast as they are."""
        sides = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key")))
        return sides if 2 * pairs.count() <= MAX_BROADCAST_ROWS else staged(sides.distinct(), "wanted")

    buckets = profile.where("set_key is not null").select("set_key", "doc_id", "buckets")

    firsts = classes.select("set_key", F.col("first_id").alias("doc_id"))
    nameless = staged(classes.where("first_id is null").select("set_key"), "nameless")
    unnamed = not nameless.isEmpty()

    def sifted(pairs: DataFrame) -> DataFrame:
        """The pairs that may link by their histograms."""
        keys = wanted(pairs)
        known = members(firsts, keys, "set_key")
        near = buckets.join(bounded(staged(known, "firsts")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"])
        if unnamed:
            near = near.unionByName(buckets.join(members(nameless, keys, "set_key"), "set_key", "left_semi").dropDuplicates(["set_key"]))
        return staged(_compared(pairs, staged(near, "buckets"), "buckets", may_link), "pairs")

    def linked(pairs: DataFrame) -> DataFrame:
        ids = staged(members(firsts, wanted(pairs), "set_key").select("doc_id").where("doc_id is not null"), "ids")
        sets = _sets(docs, ids, width)
        if unnamed:
            zero = docs.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long"))
            sets = sets.unionByName(_sets(zero, docs.sparkSession.range(1).toDF("doc_id"), width))
        return staged(_compared(pairs, staged(sets, "sets"), "tokens", links_in).distinct(), "links")

    tried = pairs
    # The smallest member of an entry of a rare token was compared with all others.
    met = (F.col("salt") == 0) & (F.col("own.set_key") == F.col("least.set_key"))
    open_rows = shared.where(~met).select("entry", "own", F.col("least.set_key").alias("hub"))
    found = components(linked(sifted(pairs)))
    for number in range(ROUNDS + 1):
        # What the links so far left apart though it shares an entry.
        part = F.coalesce("component", "own.set_key").alias("part")
        placed = open_rows.join(found, F.col("own.set_key") == F.col("node"), "left").select("entry", F.struct("own.*", part).alias("x"), "hub")
        parts = placed.groupBy("entry").agg(F.min("x.part").alias("low"), F.max("x.part").alias("high"))
        placed = staged(placed.join(parts.where("low != high").select("entry"), "entry"), "open")
        if number < ROUNDS:
            order = F.xxhash64("entry", F.lit(number), "x.set_key")
            others = placed.groupBy("entry").agg(F.min_by("x", order).alias("y"))
            placed = staged(placed.join(others, "entry").where("x.set_key != y.set_key"), "met")
            across = pairs_of(placed.where("x.part != y.part"))
            open_rows = placed.select("entry", F.struct("x.set_key", "x.n", "x.room").alias("own"), "hub")
        else:
            bitmaps = profile.where("set_key is not null").select("set_key", "bits")
            across = _compared_in_cells(_cells(placed, bitmaps), threshold)
        pairs = staged(across.join(tried, ["a", "b"], "left_anti"), "across")
        tried = tried.unionByName(pairs)
        # Those from the cells were sifted by bitmaps there.
        new = linked(sifted(pairs) if number < ROUNDS else pairs)
        if not new.isEmpty():
            # What was found so far stands for the links it came of.
            found = components(new.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    named = classes.join(found, classes.set_key == found.node, "left")
    named = named.select("set_key", "first_id", F.coalesce("component", "set_key").alias("part"))
    smallest = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    named = staged(named.join(smallest, "part").select("set_key", "part", "component_id"), "named")
    alone = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "set_key", "left").select("doc_id", "n_shingles", alone.alias("component_id"), "row_key", "part")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of ``groups``, which is ``jaccard_join`` of them; all columns stay.

    The row with the smallest doc_id stays, one without an id only if no other has one; of rows with the same
    id, the one with the smaller hash of its text; of equal rows, one. Rows without words all stay.
    """
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    linked = staged(groups.where("part is not null").select("part", order.alias("own")), "linked")
    firsts = linked.groupBy("part").agg(F.min("own").alias("first"))
    repeated = linked.groupBy("own").agg(F.count("*").alias("rows")).where("rows > 1")
    later = staged(linked.join(firsts, "part").where("own != first").select("own.row_key").distinct(), "later")
    repeated = staged(repeated.select("own.row_key").distinct(), "repeated")
    keyed = docs.select(F.struct("*").alias("d"), row_key().alias("row_key"))
    words = F.coalesce(F.col("d.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = members(keyed.where(words), later, "row_key", "left_anti")
    once = members(kept, repeated, "row_key", "left_anti")
    again = members(kept, repeated, "row_key").groupBy("row_key").agg(F.first("d").alias("d"))
    whole = keyed.where(~words).select("d").unionByName(once.select("d")).unionByName(again.select("d"))
    return whole.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])
