"""Shards against what they promise, counted in plain Python."""

import random
import zlib
from collections import defaultdict

import pytest

from roleledger.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, row string, range int, h double"


def placed(spark, rows, shards=16, **more):
    table = spark.createDataFrame([(*r, "clash", "kept", 7, 0.5) for r in rows], SCHEMA).repartition(4)
    out = sharding.sharded(table, shards, **more)
    assert sorted(out.columns) == ["doc_id", "h", "range", "row", "shard", "size", "slot", "text"]
    return out.collect()


def promised(found, rows, shards, unit=None):
    """Every row once, slots without gaps, bytes nearly equal; returns bytes and texts by shard."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=key) == sorted(rows, key=key)
    slots, held, where = defaultdict(list), [0] * shards, defaultdict(set)
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        where[r["text"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(held)
    largest = max(r["size"] for r in found)
    assert max(held) - min(held) <= max(largest, unit or total / shards / 8)
    return held, where


def words(pick, most):
    return " ".join(f"w{pick.randrange(5000)}é" for _ in range(pick.randrange(most)))


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shares(spark, shards):
    pick = random.Random(shards)
    rows = [(i, words(pick, 60)) for i in range(1500)] + [(2000, words(pick, 4000)), (None, None), (None, "no id"), (3, None), (3, "")]
    held, where = promised(placed(spark, rows, shards), rows, shards)
    # Copies stay together unless they outweigh half a shard.
    assert all(len(s) == 1 for s in where.values())


def test_hot_text_is_spread(spark):
    pick = random.Random(2)
    hot = "the same words again and again " * 4
    rows = [(i, hot) for i in range(1200)] + [(i, words(pick, 60)) for i in range(1200, 3600)]
    rows += [(7, "one row many times")] * 800 + [(i, None) for i in range(4000, 5500)]
    found = placed(spark, rows, 8)
    total = sum(r["size"] for r in found)
    _, where = promised(found, rows, 8, unit=total / 8 / 4)
    assert len(where[hot]) > 1
    assert all(len(s) == 1 for text, s in where.items() if text != hot)


def test_ranges_stay_small(spark, monkeypatch):
    """No range, that is no sorted group, holds a good part of the rows, hot text or not."""
    monkeypatch.setattr(sharding, "RANGES_A_SHARD", 8)
    pick = random.Random(3)
    rows = [(i, "hot " * 30) for i in range(2000)] + [(i, None) for i in range(2000)] + [(i, words(pick, 40)) for i in range(2000)]
    seen = []
    whole = sharding._dealt
    monkeypatch.setattr(sharding, "_dealt", lambda ranges, *rest: seen.extend(ranges) or whole(ranges, *rest))
    found = placed(spark, rows, 8)
    promised(found, rows, 8)
    due = 8 * 8
    assert all((r["rows"] / len(rows) + r["bytes"] / sum(x["size"] for x in found)) * due / 2 <= 4 for r in seen)


def test_splitters():
    assert sharding.splitters([], 4) == []
    found = sharding.splitters([(5, 1, 4), (9, 1, 4), (9, 3, 4), (12, 2, 1)], 4)
    assert found == [(5, sharding.LEAST), (9, sharding.LEAST), (9, 1), (9, 3), (10, sharding.LEAST)]


def test_nothing_and_little(spark):
    assert placed(spark, []) == []
    (row,) = placed(spark, [(1, "alone")])
    assert row["slot"] == 0
    rows = [(i, "x" * 100_000 if i == 3 else "y") for i in range(6)]
    promised(placed(spark, rows, 4), rows, 4)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op11_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
