"""Conversation repair against a plain row-by-row search."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from roleledger.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, result string, chunk long"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """Least (cost, edits, lines) over all edits of rows (role, text, fault), by a search over positions and states."""
    best = {"": (0, "", ())}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best.items()):
                for role, name in NAMES.items():
                    then = NEXT.get((state, role))
                    found = (cost + 3, edits + "I", (*lines, f"{name}:"))
                    if then is not None and found[:2] < best.get(then, (1e9, ""))[:2]:
                        best[then] = found
        return best

    for role, text, fault in rows:
        new = {}

        def offer(state, cost, edits, lines, new=new):
            if (cost, edits) < new.get(state, (1e9, ""))[:2]:
                new[state] = (cost, edits, lines)

        for state, (cost, edits, lines) in with_inserts(best).items():
            offer(state, cost + 4, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (state, role[:1]) in NEXT:
                offer(NEXT[state, role[:1]], cost + more, edits + "K", (*lines, f"{role}:{text}"))
            for to, name in NAMES.items():
                if (state, to) in NEXT:
                    offer(NEXT[state, to], cost + more + 3, edits + "R", (*lines, f"{name}:{text}"))
        best = new
    ends = with_inserts(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def brute(rows):
    """Results by conversation for damaged rows (conv_id, turn, role, text); None for a conversation without rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and r[2] is not None), key=lambda r: (r[1] is not None, r[1] or 0))
        seen, faulty, known = set(), [], []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, turn, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            faulty.append((role, text, fault))
            if turn is not None:
                known.append(turn)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, lines = cheapest(faulty)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, edits, digest)
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            out.append((conv, turn, None, None))
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def found(table):
    return {r["conv_id"]: tuple(r)[1:] for r in table.collect()}


def random_rows(seed, convs, most):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(pick.randrange(1, most)):
            role = pick.choice(["user", "assistant"] * 4 + ["system", "tool", "", None])
            text = pick.choice(["Well.", "no end", "Yes!", " \t", "", None, "said 　", f"number {pick.random()}.", f"odd {pick.random()}"])
            rows.append((conv, None if pick.random() < 0.05 else turn * pick.choice([1, 1, 1, 2]) + turn, role, text))
    return rows


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_repair(spark, partitions, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK_ROWS", 3 if partitions == "40" else 4096)
    rows = list(dict.fromkeys(random_rows(int(partitions), 30, 14)))
    # Equal turns have no order but that of the damaged rows' roles and texts.
    rows = list({(r[0], r[1]): r for r in rows}.values())
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(turns.repair(turns.damaged(table), F.col("there")))
        lines = turns.repaired_turns(turns.damaged(table), F.col("there")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(damage(rows))
    for conv, result in got.items():
        own = sorted((r["turn"], f"{r['role']}:{r['text']}") for r in lines if r["conv_id"] == conv)
        assert [t for t, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(line for _, line in own).encode()).hexdigest() == result[-1]


def test_a_long_conversation_spread_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(turns, "CHUNK_ROWS", 16)
    rows = [(1, i, "user" if i % 7 else "assistant", f"line {i % 400}." if i % 5 else "cut") for i in range(900)]
    rows += [(2, i, "user", f"u {i}.") for i in range(300)] + [(3, 0, "system", "Only.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(turns.repair(table)) == brute(rows)


def test_runs_are_crossed_by_powers():
    for symbol in "suaoSUAOx":
        costs = step = turns.END
        for length in range(1, 40):
            step = turns._times(turns.power(symbol, 0), step)
            assert turns.backwards(symbol, length, costs) == step
            edits, _ = turns.unrolled(symbol * length, 0, costs)
            assert len(edits.replace("I", "")) == length


def test_ties_repeats_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turns.repair(spark.createDataFrame([], schema)).collect() == []
    same = [(1, 0, "user", "Twice.")] * 3 + [(1, 1, "assistant", "Yes.")]
    (row,) = turns.repair(spark.createDataFrame(same, schema)).collect()
    assert (row["duplicate"], row["cost"], row["audit"]) == (2, 8, "KDDK")
    long = "word " * 400_000
    rows = [(1, 0, "user", long + "."), (1, 1, "assistant", long + "x."), (2, 0, "user", long)]
    assert found(turns.repair(spark.createDataFrame(rows, schema))) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_turns(spark, sf)) == brute(damage(rows))
