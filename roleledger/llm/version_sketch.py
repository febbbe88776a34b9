"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut after every word whose hash says so, so that an edit moves no other cut. Its
digest goes into one cell of each of three parts of a table; a cell keeps a count, the sum of its digests
and the sum of their check numbers. Tables of two versions are subtracted cell by cell, and cells left
with one digest are peeled until the table is empty: the digests peeled are those in which the versions
differ. If it doesn't empty, a larger table is made and tried again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roleledger.llm.words import mixed, word_hashes

PARTS = 3
# Cells of the table that a fingerprint holds; a multiple of PARTS.
CELLS = 24
# A word in so many ends a paragraph's piece.
PIECE_WORDS = 6
# Texts worked on together inside a task.
GROUP_CHARS = 4_000_000
FIRST = -(1 << 63)


def digests(text: str) -> np.ndarray:
    """Digests of the pieces of a text; a repeated piece counts with its number, so that all are different."""
    hashes = word_hashes(text.replace("\n", " \x00 "), lower=False)
    if not len(hashes):
        return hashes
    last = (hashes % np.uint64(PIECE_WORDS) == 0) | (hashes == LINE)
    starts = np.concatenate([[0], np.flatnonzero(last[:-1]) + 1])
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    found = np.sort(mixed(np.add.reduceat(mixed(hashes + mixed(place.astype(np.uint64))), starts)))
    new = np.concatenate([[True], found[1:] != found[:-1]])
    first = np.flatnonzero(new)
    again = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return np.where(again > 0, mixed(found + mixed(again.astype(np.uint64))), found)


LINE = word_hashes("\x00")[0]


class Tables:
    """Tables of several documents side by side: ``sizes`` cells each, a multiple of PARTS."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.sizes, self.offsets = sizes, np.cumsum(sizes) - sizes
        self.count = np.zeros(int(sizes.sum()), np.int64)
        self.keys, self.checks = np.zeros(len(self.count), np.uint64), np.zeros(len(self.count), np.uint64)

    def add(self, table: np.ndarray, keys: np.ndarray, sign: np.ndarray | int) -> None:
        """Add digests to the tables named, or take them away if the sign is -1."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        size = (self.sizes[table] // PARTS).astype(np.uint64)
        checks = mixed(keys ^ CHECK)
        for part in range(PARTS):
            cell = self.offsets[table] + part * size.astype(np.int64) + (mixed(keys + np.uint64(part + 1)) % size).astype(np.int64)
            np.add.at(self.count, cell, sign)
            np.add.at(self.keys, cell, keys * sign.view(np.uint64))
            np.add.at(self.checks, cell, checks * sign.view(np.uint64))

    def minus(self, other: Tables) -> Tables:
        out = Tables(self.sizes)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Table, digest and sign of all that could be peeled, and for each table whether it emptied."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        found = []
        cells = np.flatnonzero(np.abs(self.count) == 1)
        while len(cells):
            sign = self.count[cells]
            keys = self.keys[cells] * sign.view(np.uint64)
            pure = self.checks[cells] * sign.view(np.uint64) == mixed(keys ^ CHECK)
            rows = np.rec.fromarrays([owner[cells][pure], keys[pure], sign[pure]], names="table,key,sign")
            rows = np.unique(rows)
            if not len(rows):
                break
            found.append(rows)
            self.add(rows.table, rows.key, -rows.sign)
            cells = np.flatnonzero(np.abs(self.count) == 1)
        left = np.zeros(len(self.sizes), np.int64)
        np.add.at(left, owner, (self.count != 0) | (self.keys != 0))
        rows = np.concatenate(found) if found else np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)], names="table,key,sign")
        return rows["table"], rows["key"], rows["sign"], left == 0

    def text(self, i: int, pieces: int) -> str:
        at = slice(self.offsets[i], self.offsets[i] + self.sizes[i])
        raw = self.count[at].astype("<i4").tobytes() + self.keys[at].astype("<u8").tobytes() + self.checks[at].astype("<u8").astype("<u4").tobytes()
        return f"{pieces}:{base64.b64encode(raw).decode()}"


CHECK = np.uint64(0xA0761D6478BD642F)


def tables(sets: list[np.ndarray], sizes: np.ndarray | None = None) -> Tables:
    out = Tables(np.full(len(sets), CELLS) if sizes is None else sizes)
    if sets:
        out.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), 1)
    return out


def differences(left: list[np.ndarray], right: list[np.ndarray], tried: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, digest and sign (1: only left) of what differs in each pair; ``tried`` is the difference of the small tables."""
    which, keys, signs, emptied = tried.peel()
    keep = emptied[which]
    out = [(which[keep], keys[keep], signs[keep])]
    open_pairs, factor = np.flatnonzero(~emptied), 2
    while len(open_pairs):
        sizes = np.array([PARTS * (factor * (len(left[i]) + len(right[i])) // PARTS + 8) for i in open_pairs])
        larger = tables([left[i] for i in open_pairs], sizes).minus(tables([right[i] for i in open_pairs], sizes))
        which, keys, signs, emptied = larger.peel()
        keep = emptied[which]
        out.append((open_pairs[which[keep]], keys[keep], signs[keep]))
        open_pairs, factor = open_pairs[~emptied], factor * 2
    return tuple(np.concatenate(column) for column in zip(*out, strict=True))


def likeness(left: list[np.ndarray], right: list[np.ndarray], tried: Tables) -> np.ndarray:
    """Shared share of the digests of each pair; 1 if neither has any."""
    differ = np.bincount(differences(left, right, tried)[0], minlength=len(left))
    total = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)])
    return np.where(total > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following one."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Results for documents in order, each with the text that follows."""
    seen: dict[str, np.ndarray] = {}

    def of(text: str) -> np.ndarray:
        if text not in seen:
            seen[text] = digests(text)
        return seen[text]

    changed = [edited(text, after) for _, text, after in rows]
    own, other, later = [of(r[1]) for r in rows], [digests(c) for c in changed], [of(r[2]) for r in rows]
    one, two, three = tables(own), tables(other), tables(later)
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(r[1]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
        pa.array([one.text(i, len(s)) for i, s in enumerate(own)], pa.string()),
        pa.array([two.text(i, len(s)) for i, s in enumerate(other)], pa.string()),
        pa.array(likeness(own, other, one.minus(two)), pa.float64()),
        pa.array(likeness(own, later, one.minus(three)), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _sequence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, look-ahead mark, id and text: pair each document with the one after it."""
    waiting, group, size = None, [], 0
    for batch in batches:
        for part, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if waiting and waiting[0] == part:
                group.append((waiting[1], waiting[2], text))
                size += len(waiting[2])
            waiting = None if ahead else (part, doc_id, text)
            if size > GROUP_CHARS:
                yield _batch(group)
                group, size = [], 0
    if group:
        yield _batch(group)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (``doc_id``, ``text``) and of its edited text, and their likeness.

    The next document is the one with the next larger doc_id, and the first one after the last. Rows with
    the same id are ordered by text, rows without id come first, a null text is empty. The ids are cut
    into ranges of about equal numbers of rows; the first document of a range is also sent to the range
    before, so the texts are moved once and no task holds more than its range.
    """
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(FIRST))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(c) for c in rows.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    part = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c <= F.col("key"))) if cuts else F.lit(0)
    placed = rows.withColumn("part", part)
    # One id per range.
    firsts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min("key")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(before, "key long, ahead int"))
    own = F.struct("part", F.lit(False).alias("ahead"))
    extra = F.when(F.col("ahead").isNotNull(), F.struct(F.col("ahead").alias("part"), F.lit(True).alias("ahead")))
    sent = placed.join(ahead, "key", "left").select("doc_id", "text", "key", F.explode(F.array_compact(F.array(own, extra))).alias("to"))
    dealt = sent.repartition(ranges, "to.part").sortWithinPartitions("to.part", "to.ahead", "key", "text")
    return dealt.select("to.part", "to.ahead", "doc_id", "text").mapInArrow(_sequence, SCHEMA)
