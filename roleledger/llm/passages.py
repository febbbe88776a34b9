"""Substring dedup: fuzzy passages that repeat, found by chaining shared seeds.

Seeds are the runs of ``K`` words whose hash is the smallest of ``WINDOW`` neighbouring ones, so that any
``K + WINDOW - 1`` equal words share one. Every occurrence of a seed is joined to its first occurrence,
which is linear in the number of occurrences however common the seed is. The matches of a document with
one earlier document are chained: a Fenwick tree over the earlier one's positions gives each match the
best chain that ends before it on both sides, less a cost for the words skipped. Chains are aligned word
by word, extended at both ends, and kept if they are long and alike enough.

The seeds of one passage may first occur in different documents. So the repeated seeds that no passage
covers yet go through further rounds, in which runs of three, then eight neighbouring seeds take the place
of single ones: such a run first occurs where more of the passage stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roleledger.llm.tables import bounded, members, settled, staged
from roleledger.llm.words import mixed, shingles, word_hashes

K = 4
WINDOW = 8
# Neighbouring seeds that make a key, round by round.
WIDTHS = (1, 3, 8)
MIN_WORDS = 50
IDENTITY = 0.8
# Cost of a skipped word on either side, against K for a seed.
GAP_COST = 0.1
# A chain is cut where it skips more words.
MAX_GAP = 40
# Words looked at beyond either end of a chain, and how far the score may fall there.
MARGIN = 64
DROP = 8
WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def seeds(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of a text; none if it has fewer than ``k`` words."""
    hashes = word_hashes(text)
    if len(hashes) < k:
        return np.zeros(0, np.int64), hashes[:0]
    grams = mixed(shingles(hashes, k))
    views = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
    at = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    return at, grams[at]


class Fenwick:
    """Largest value (and whose it is) over a prefix of places."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def top(self, before: int) -> tuple[float, int]:
        found = (-np.inf, -1)
        while before:
            if self.best[before] > found:
                found = self.best[before]
            before -= before & -before
        return found


def runs(
    at: np.ndarray, values: np.ndarray, fresh: np.ndarray, width: int, window: int = WINDOW
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of ``width`` seeds that hold a ``fresh`` one; no gap in them is wider than ``window``.

    Of equal runs the first stands for all, so that a text that says one thing over and over has few.
    """
    count = len(at) - width + 1
    if count < 1:
        return at[:0], values[:0]
    keys, whole, some = mixed(values[:count]), np.ones(count, bool), fresh[:count].copy()
    for i in range(1, width):
        gap = at[i : i + count] - at[i - 1 : i - 1 + count]
        whole &= gap <= window
        some |= fresh[i : i + count]
        keys = mixed(keys ^ values[i : i + count] ^ gap.astype(np.uint64))
    whole &= some
    at, keys = at[:count][whole], keys[whole]
    first = np.sort(np.unique(keys, return_index=True)[1])
    return at[first], keys[first]


def uncovered(at: np.ndarray, starts: list[int], ends: list[int], k: int = K) -> np.ndarray:
    """Which of these seeds lie in none of these passages; ``starts`` and ``ends`` belong together."""
    order = np.argsort(starts, kind="stable")
    begin, reach = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    last = np.searchsorted(begin, at, "right") - 1
    return (last < 0) | (reach[np.maximum(last, 0)] < at + k)


def chains(at: np.ndarray, other: np.ndarray, k: int = K, least: int = 2) -> list[np.ndarray]:
    """Collinear chains of ``least`` matches or more, best first, as index arrays; ``at`` is ascending and unique."""
    if len(at) > 1 and (np.diff(other) == np.diff(at)).all():
        found = [np.arange(len(at))]
    else:
        found = _chained(at, other, k, least)
    out = []
    for chain in found:
        far = (np.diff(at[chain]) > MAX_GAP) | (np.diff(other[chain]) > MAX_GAP)
        out += [part for part in np.split(chain, np.flatnonzero(far) + 1) if len(part) >= least]
    return out


def _chained(at: np.ndarray, other: np.ndarray, k: int, least: int) -> list[np.ndarray]:
    places = np.unique(other)
    rank = np.searchsorted(places, other).tolist()
    tree, score, before = Fenwick(len(places)), [0.0] * len(at), [-1] * len(at)
    for j, (x, y) in enumerate(zip(at.tolist(), other.tolist(), strict=True)):
        value, i = tree.top(rank[j])
        gained = value - GAP_COST * (x + y)
        score[j] = k + max(gained, 0.0)
        before[j] = i if gained > 0 else -1
        tree.put(rank[j], (score[j] + GAP_COST * (x + y), j))
    used, out = [False] * len(at), []
    for j in sorted(range(len(at)), key=lambda j: (-score[j], j)):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        if len(chain) >= least:
            out.append(np.array(chain[::-1]))
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    row = [0] * (len(b) + 1)
    other = b.tolist()
    for x in a.tolist():
        last = 0
        for j, y in enumerate(other, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _extension(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words to take along: the best sum of 1 a match and -2 a difference before it falls by DROP."""
    n = min(len(a), len(b))
    score = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    fallen = np.flatnonzero(np.maximum.accumulate(score) - score > DROP) if n else score
    score = score[: fallen[0]] if len(fallen) else score
    best = int(score.argmax()) if len(score) else 0
    return best + 1 if len(score) and score[best] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, at: np.ndarray, other: np.ndarray, k: int = K) -> tuple[int, int, int, int, int]:
    """Begin and end in ``a`` and ``b`` of the aligned passage around a chain, and the number of equal words."""
    cuts = np.flatnonzero(np.diff(other - at)) + 1
    blocks = [(int(x[0]), int(x[-1]) + k, int(y[0])) for x, y in zip(np.split(at, cuts), np.split(other, cuts), strict=True)]
    matched, end_a, end_b = 0, None, None
    for begin, end, begin_b in blocks:
        if end_a is not None:
            skip = max(end_a - begin, end_b - begin_b, 0)
            begin, begin_b = begin + skip, begin_b + skip
            matched += _common(a[end_a:begin], b[end_b:begin_b])
        end_b = begin_b + max(end - begin, 0)
        end_a = max(end, begin)
        matched += int((a[begin:end_a] == b[begin_b:end_b]).sum())
    first_a, _, first_b = blocks[0]
    left = _extension(a[:first_a][::-1][:MARGIN], b[:first_b][::-1][:MARGIN])
    right = _extension(a[end_a : end_a + MARGIN], b[end_b : end_b + MARGIN])
    matched += int((a[first_a - left : first_a] == b[first_b - left : first_b]).sum())
    matched += int((a[end_a : end_a + right] == b[end_b : end_b + right]).sum())
    return first_a - left, end_a + right, first_b - left, end_b + right, matched


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, since a row holds a whole text and its lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _seeds(docs: DataFrame, k: int, window: int) -> DataFrame:
    """``doc_id``, ``places``, ``seeds`` of every text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield _listed(batch.column(0), [seeds(text, k, window) for text in batch.column(1).to_pylist()])

    return docs.mapInArrow(rows, _SEEDS)


_SEEDS = "doc_id long, places array<int>, seeds array<long>"


def _listed(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    places = pa.array([at for at, _ in found], pa.list_(pa.int64())).cast(pa.list_(pa.int32()))
    values = pa.array([value.view(np.int64) for _, value in found], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, places, values], ["doc_id", "places", "seeds"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as views of one array."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _repeated(found: DataFrame) -> DataFrame:
    """``doc_id``, ``at``, ``seed``, ``first`` for every occurrence of a seed that occurs more than once."""
    each = found.select("doc_id", F.explode(F.arrays_zip("places", "seeds")).alias("s"))
    each = each.select("doc_id", F.col("s.places").alias("at"), F.col("s.seeds").alias("seed"))
    first = each.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n"))
    first = staged(first.where("n > 1").select("seed", "first"), "first")
    return each.join(first, "seed").select("doc_id", "at", "seed", "first")


def _anchors(repeated: DataFrame) -> DataFrame:
    """``doc_id``, ``source_id``, ``matches``: for a document and an earlier place, all seeds they share."""
    shared = repeated.where("doc_id != first.doc_id or at != first.at")
    # As many matches as the document has seeds at most.
    return shared.groupBy("doc_id", F.col("first.doc_id").alias("source_id")).agg(
        F.sort_array(F.collect_list(F.struct("at", F.col("first.at").alias("other")))).alias("matches")
    )


def _open(repeated: DataFrame, found: DataFrame, width: int, k: int, window: int) -> DataFrame:
    """The table of ``_seeds`` for the next round: runs of ``width`` repeated seeds not all covered by passages ``found``."""
    lists = F.sort_array(F.collect_list(F.struct("at", "seed")))
    left = repeated.groupBy("doc_id").agg(lists.alias("s")).select("doc_id", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("p"))
    spans = bounded(staged(spans.select("doc_id", F.col("p.start").alias("starts"), F.col("p.end").alias("ends")), "spans"), more=2 * F.size("starts"))
    none = F.array().cast("array<long>")
    left = left.join(spans, "doc_id", "left").select("doc_id", "at", "seed", *[F.coalesce(c, none).alias(c) for c in ("starts", "ends")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            out = []
            for at, values, starts, ends in zip(*(_lists(batch.column(i)) for i in range(1, 5)), strict=True):
                at = at.astype(np.int64)
                # A repeated doc_id may have two texts, and a place in each.
                one = np.r_[True, np.diff(at) > 0]
                at, values = at[one], values[one].view(np.uint64)
                fresh = uncovered(at, starts, ends, k) if len(starts) else np.ones(len(at), bool)
                out.append(runs(at, values, fresh, width, window))
            yield _listed(batch.column(0), out)

    return left.mapInArrow(rows, _SEEDS).where("size(places) > 0")


def _chains(anchors: DataFrame, k: int, least: int) -> DataFrame:
    """A row per chain: ``doc_id``, ``source_id``, and the positions on both sides."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids, sources, left, right = [], [], [], []
            lists = batch.column(2)
            offsets, flat = lists.offsets.to_numpy(), lists.flatten()
            offsets = offsets - offsets[0]
            ats, others = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for row, (doc_id, source_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                part = slice(offsets[row], offsets[row + 1])
                at, other = ats[part], others[part]
                for chain in chains(at, other, k, least):
                    ids.append(doc_id)
                    sources.append(source_id)
                    left.append(at[chain])
                    right.append(other[chain])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sources, pa.int64()), pa.array(left, pa.list_(pa.int64())), pa.array(right, pa.list_(pa.int64()))],
                ["doc_id", "source_id", "at", "other"],
            )

    many = anchors.where(F.size("matches") >= least)
    return many.mapInArrow(rows, "doc_id long, source_id long, at array<long>, other array<long>")


def _window(text: str, known: list, at: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Word hashes around a chain and the position of the first; ``known`` keeps the last text's."""
    if not known or known[0] != text:
        known[:] = [text, word_hashes(text).astype(np.uint32)]
    begin = max(int(at[0]) - MARGIN, 0)
    return known[1][begin : int(at[-1]) + k + MARGIN], begin


def passages(
    docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, k: int = K, window: int = WINDOW
) -> DataFrame:
    """Passages of ``docs`` (``doc_id``, ``text``) that an earlier place has too.

    A row has ``doc_id``, ``start``, ``end`` (words from 0, end excluded), ``source_id``, ``source_start``,
    ``source_end`` and ``matched`` (equal words). Earlier means a smaller doc_id, or the same document
    further ahead; of all places that share a seed the first is the source, so that n copies give n - 1 rows;
    where the seeds of a passage first occur in several documents, the first place of a run of three or eight
    seeds is. Passages have at least ``min_words`` words and this share of equal words; one whose changed
    words leave no two seeds whole is missed. Words are compared with A-Z lower-cased. Rows with a null doc_id or text take
    no part; a doc_id that repeats is one document if the text is the same, and otherwise has the passages
    of each text.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return settled(docs.sparkSession, "found", lambda: _passages(docs, min_words, identity, k, window))


def _passages(docs: DataFrame, min_words: int, identity: float, k: int, window: int) -> DataFrame:
    listed, found = staged(_seeds(docs, k, window), "seeds"), None
    for width, wider in zip(WIDTHS, (*WIDTHS[1:], None), strict=True):
        repeated = staged(_repeated(listed), "repeated")
        # A run of seeds is a chain by itself.
        chained = staged(_chains(_anchors(repeated), k, 2 if width == 1 else 1), "chains")
        more = _aligned(docs, chained, min_words, identity, k)
        found = staged(more if found is None else found.unionByName(more).distinct(), "passages")
        if width == 1:
            single = repeated
        if wider is not None:
            listed = staged(_open(single, found, wider, k, window), "runs")
    return found


def _aligned(docs: DataFrame, found: DataFrame, min_words: int, identity: float, k: int) -> DataFrame:
    """The passages around the chains ``found``, as ``passages`` returns them."""
    ids = found.select("doc_id").unionByName(found.select(F.col("source_id").alias("doc_id"))).distinct()
    texts = members(docs, staged(ids, "ids"), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = []
        for batch in _pieces(batches):
            ats, begins, parts = batch.column(2).to_pylist(), [], []
            for at, text in zip(ats, batch.column(4).to_pylist(), strict=True):
                part, begin = _window(text, known, at, k)
                parts.append(part.tobytes())
                begins.append(begin)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(begins, pa.int64()), pa.array(parts, pa.binary())],
                ["doc_id", "source_id", "at", "other", "begin", "part"],
            )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = []
        names = ["doc_id", "start", "end", "source_id", "source_start", "source_end", "matched"]
        for batch in _pieces(batches):
            out: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                doc_id, source_id, at, other, begin, part, text = row
                a, (b, begin_b) = np.frombuffer(part, np.uint32), _window(text, known, other, k)
                at, other = np.array(at) - begin, np.array(other) - begin_b
                # A repeated doc_id may have brought a text that the chain isn't of.
                if at[-1] + k > len(a) or other[-1] + k > len(b):
                    continue
                s, e, t, u, matched = align(a, b, at, other, k)
                if e - s >= min_words and matched >= identity * max(e - s, u - t):
                    out.append((doc_id, s + begin, e + begin, source_id, t + begin_b, u + begin_b, matched))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    one = found.join(texts, "doc_id").select("doc_id", "source_id", "at", "other", "text")
    one = one.mapInArrow(cut, "doc_id long, source_id long, at array<long>, other array<long>, begin long, part binary")
    two = one.join(texts.withColumnRenamed("doc_id", "source_id"), "source_id")
    two = two.select("doc_id", "source_id", "at", "other", "begin", "part", "text")
    schema = "doc_id long, start long, end long, source_id long, source_start long, source_end long, matched long"
    return two.mapInArrow(aligned, schema).distinct()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these word ranges; what stands between kept words stays."""
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    kept, end = [], 0
    for start, stop in sorted(spans):
        start, stop = min(start, len(places) - 1), min(stop, len(places) - 1)
        if places[start] > end:
            kept.append(text[end : places[start]])
        end = max(end, places[stop])
    return "".join(kept) + text[end:]


def drop_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the passages ``found`` (``doc_id``, ``start``, ``end``) cut out of ``text``; other columns stay.

    Null texts and rows without passages stay as they are; a text that was one passage becomes empty.
    """
    spans = found.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = bounded(staged(spans, "spans"), more=2 * F.size("starts"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        rows = zip(text, starts, ends, strict=True)
        return pd.Series([t if s is None or t is None else without(t, list(zip(s, e, strict=True))) for t, s, e in rows], dtype=object)

    # The row as one value, so that no name of its columns can meet one of these.
    joined = docs.select(F.struct("*").alias("d"), "doc_id").join(spans, "doc_id", "left")
    text = F.when(F.col("starts").isNull(), F.col("d.text")).otherwise(cut("d.text", "starts", "ends"))
    return joined.select(*[text.alias(c) if c.lower() == "text" else F.col("d").getField(c).alias(c) for c in docs.columns])
