"""Passages against brute force: pieces from several documents, changed words, odd tables."""

from __future__ import annotations

import random

from roleledger.llm import passages

SCHEMA = "doc_id long, text string"


def fresh(rng: random.Random, count: int) -> list[str]:
    return [f"{rng.choice('bcdfgklmnprstv')}{rng.randrange(10**6)}" for _ in range(count)]


def covered(found: list, doc_id: int, start: int, end: int) -> bool:
    places = {i for r in found if r["doc_id"] == doc_id for i in range(r["start"], r["end"])}
    return places >= set(range(start, end))


def test_halves_that_first_occur_in_two_documents(spark):
    rng = random.Random(1)
    a, b = fresh(rng, 30), fresh(rng, 30)
    rows = [(1, fresh(rng, 40) + a + fresh(rng, 40)), (2, fresh(rng, 40) + b), (3, a + b), (4, fresh(rng, 9) + a + b)]
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(4, 3)}
    assert covered(found, 4, 9, 69)


def test_every_repeated_window_is_found(spark):
    """Documents pieced together from a pool: windows of 60 words that stand in an earlier document too."""
    rng = random.Random(7)
    pool = [fresh(rng, rng.randrange(12, 45)) for _ in range(40)]
    joined = [[*rng.choice(pool), *rng.choice(pool), *rng.choice(pool), *rng.choice(pool)] for _ in range(12)]
    texts = []
    for _ in range(90):
        parts = [fresh(rng, 25), rng.choice(pool), fresh(rng, 10), rng.choice(joined), fresh(rng, 5)]
        texts.append([word for part in parts for word in part])
    found = passages.passages(spark.createDataFrame(list(enumerate(" ".join(w) for w in texts)), SCHEMA)).collect()
    places: dict[int, set[int]] = {}
    for r in found:
        places.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    seen: set[tuple[str, ...]] = set()
    repeated = lost = 0
    for doc_id, words in enumerate(texts):
        windows = [(i, tuple(words[i : i + 60])) for i in range(len(words) - 59)]
        for i, window in windows:
            if window in seen:
                repeated += 1
                lost += not places.get(doc_id, set()) >= set(range(i, i + 60))
        seen.update(window for _, window in windows)
    assert repeated > 1000 and lost == 0, (repeated, lost)
    # And nothing that is in no other document: a passage's words are those of its source, but for the share allowed.
    for r in found:
        ours, theirs = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["source_id"]][r["source_start"] : r["source_end"]]
        assert len(ours) >= passages.MIN_WORDS and len(set(ours) & set(theirs)) >= 0.8 * len(set(ours))


def test_recall_of_changed_passages(spark):
    rng = random.Random(3)
    rows, planted = [], []
    for i in range(240):
        passage = fresh(rng, 80)
        changed = list(passage)
        for at in rng.sample(range(80), (8, 12, 14)[i % 3]):
            changed[at] = fresh(rng, 1)[0]
        rows += [(2 * i, fresh(rng, 60) + passage + fresh(rng, 60)), (2 * i + 1, fresh(rng, 40) + changed + fresh(rng, 60))]
        planted.append(2 * i + 1)
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)).collect()
    assert all(r["source_id"] == r["doc_id"] - 1 for r in found)
    assert len({r["doc_id"] for r in found}) >= 0.9 * len(planted)


def test_odd_tables(spark):
    rng = random.Random(5)
    words = " ".join(fresh(rng, 70))
    empty = spark.createDataFrame([], SCHEMA)
    assert passages.passages(empty).count() == 0 and passages.drop_passages(empty, passages.passages(empty)).count() == 0
    # Repeated rows of one document are that document; one word over and over; an equal text thrice.
    long = " ".join(["again"] * 20_000)
    rows = [(1, words, "a"), (1, words, "b"), (2, words, "c"), (3, words, "d"), (4, long, "e"), (None, words, "f"), (5, "", "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _starts string")
    found = passages.passages(table).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found if r["doc_id"] != 4} == {(2, 1), (3, 1)}
    assert sum(r["doc_id"] == 4 for r in found) <= 1
    left = {(r["_starts"]): r["text"] for r in passages.drop_passages(table, passages.passages(table)).collect()}
    assert left["a"] == left["b"] == left["f"] == words and left["c"] == left["d"] == "" and left["g"] == ""


def test_runs_and_uncovered():
    import numpy as np

    at, values = np.array([0, 3, 9, 30, 33]), np.arange(5).astype(np.uint64)
    assert passages.runs(at, values, np.ones(5, bool), 2)[0].tolist() == [0, 3, 30]
    assert passages.runs(at, values, np.arange(5) == 4, 2)[0].tolist() == [30]
    assert passages.runs(at, values, np.ones(5, bool), 4)[0].tolist() == []
    again = np.arange(0, 400, 4)
    assert passages.runs(again, np.ones(100, np.uint64), np.ones(100, bool), 3)[0].tolist() == [0]
    assert passages.uncovered(at, np.array([8, 0]), np.array([14, 6])).tolist() == [False, True, False, True, True]
    assert passages.uncovered(at, np.array([0, 2]), np.array([40, 5])).tolist() == [False] * 5
