"""Repair of the structure of conversations by a run-length dynamic programme.

A row is one symbol of its role and its first fault. The repair reads the symbols with an automaton of four
states, and each symbol is a transition matrix over (min, +). Equal neighbours are one run, and a run is
crossed by the cached powers of its matrix whose exponents are powers of two, both for the costs, from the
end backwards, and for the edits, from the start.

Rows are range-partitioned by conversation and turn, so that a conversation of any length is spread. One
that lies within a partition and is short is repaired on the spot. The others are cut into chunks: what
repeats across chunks is found by grouping, costs run backwards over the chunks' symbols and edits forwards,
one chunk in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from roleledger.llm.tables import staged

# Rows and characters of a chunk; a single longer text is a chunk of its own.
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 20

# What edits cost, the states, and the roles that lead from state to state.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEVER = 1 << 60

# Marks: the role's initial, "o" for another, upper case where the text is truncated; else the fault.
BLANK, DUPLICATE = "b", "d"
LEGAL = {"su", "ua", "au"}
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

Costs = tuple[int, int, int, int]


def _wanted(state: int) -> int:
    """The state after a row of the role that the state asks for."""
    return NEXT[state, NEEDED[state][0]]


def _after(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """Edit, cost and next state for what may be done with one row, apart from inserting before it."""
    yield "D", DELETE, state
    if symbol != "x":
        more = CUT_SHORT if symbol.isupper() else 0
        if (state, symbol.lower()) in NEXT:
            yield "K", KEEP + more, NEXT[state, symbol.lower()]
        yield "R", REROLE + more, _wanted(state)


def _times(one: tuple[Costs, ...], costs: Costs) -> Costs:
    return tuple(min(a + b for a, b in zip(row, costs, strict=True)) for row in one)  # type: ignore[return-value]


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple[Costs, ...]:
    """Least costs from state to state over 2**k rows of a symbol, with inserts before each; nine symbols, so a small cache."""
    if k:
        half = power(symbol, k - 1)
        columns = [_times(half, column) for column in zip(*half, strict=True)]
        return tuple(zip(*columns, strict=True))  # type: ignore[arg-type]
    table = []
    for start in range(4):
        row, state = [NEVER] * 4, start
        # Three inserts lead to every state that inserts can reach.
        for inserts in range(4):
            for _, cost, then in _after(symbol, state):
                row[then] = min(row[then], inserts * INSERT + cost)
            state = _wanted(state)
        table.append(tuple(row))
    return tuple(table)


def _ending() -> Costs:
    """What it costs to end in each state: inserts until the conversation is empty or ends with the assistant."""
    out = []
    for start in range(4):
        state, cost = start, 0
        while state not in (START, ASSISTANT):
            state, cost = _wanted(state), cost + INSERT
        out.append(cost)
    return tuple(out)  # type: ignore[return-value]


END = _ending()


def symbols(marks: str) -> list[tuple[str, int]]:
    """Runs of equal symbols; a row that has to go is ``x``."""
    return [(symbol, len(list(run))) for symbol, run in groupby(re.sub(f"[{BLANK}{DUPLICATE}]", "x", marks))]


def backwards(symbol: str, length: int, costs: Costs) -> Costs:
    """Costs before a run, from those after it."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            costs = _times(power(symbol, k), costs)
    return costs


@lru_cache(maxsize=100_000)
def _unrolled(symbol: str, k: int, state: int, costs: Costs) -> tuple[str, int]:
    """The edits of 2**k rows of a symbol from ``state``, ``costs`` being those after them; and the state then."""
    if k:
        first, middle = _unrolled(symbol, k - 1, state, _based(_times(power(symbol, k - 1), costs)))
        second, last = _unrolled(symbol, k - 1, middle, costs)
        return first + second, last
    out = ""
    left = _times(power(symbol, 0), costs)[state]
    while True:
        options = [(edit, cost + costs[then], then) for edit, cost, then in _after(symbol, state)]
        then = _wanted(state)
        options.append(("I", INSERT + _times(power(symbol, 0), costs)[then], then))
        # The least letter that still leads to the least cost; ASCII-least edits come of it.
        edit, cost, state = min(o for o in options if o[1] == left)
        out += edit
        if edit != "I":
            return out, state
        left -= INSERT


def _based(costs: Costs) -> Costs:
    """Costs less the smallest; choices depend on differences only."""
    least = min(costs)
    return tuple(c - least for c in costs)  # type: ignore[return-value]


def unrolled(marks: str, state: int, costs: Costs) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a chunk, and the state after it. ``costs`` are those after the chunk."""
    runs, after = symbols(marks), []
    for symbol, length in reversed(runs):
        after.append(costs)
        costs = backwards(symbol, length, costs)
    out = []
    for (symbol, length), costs in zip(runs, reversed(after), strict=True):
        # Largest powers first, so the rest of the run is what the costs are carried back over.
        for k in reversed(range(length.bit_length())):
            if length >> k & 1:
                length -= 1 << k
                edits, state = _unrolled(symbol, k, state, _based(backwards(symbol, length, costs)))
                out.append(edits)
    return "".join(out), state


def ending(state: int) -> str:
    """The inserts at the end of a conversation."""
    out = ""
    while state not in (START, ASSISTANT):
        out, state = out + "I", _wanted(state)
    return out


def repaired_lines(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> list[tuple[str, str]]:
    """Role and text of what the edits make of the rows (role, text)."""
    out = []
    for edit in edits:
        if edit == "I":
            out.append((NEEDED[state], ""))
            state = _wanted(state)
            continue
        role, text = next(rows)
        if edit == "K":
            out.append((role, text))
            state = NEXT[state, role[:1]]
        elif edit == "R":
            out.append((NEEDED[state], text))
            state = _wanted(state)
    return out


def mark(role: str, text: str, seen: bool) -> str:
    """The mark of a row; ``seen`` says that the conversation had its role and text before."""
    body = text.rstrip(SPACES)
    if not body:
        return BLANK
    if seen:
        return DUPLICATE
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if body[-1] in ".!?" else initial.upper()


class Report:
    """Counts, edits and the hash of one conversation, fed chunk by chunk in order of turn."""

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.least = self.most = None
        self.distinct, self.initial, self.state = 0, None, START
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0

    def feed(self, marks: str, turns: list[int | None], roles: list[str], texts: list[str], costs: Costs) -> list[tuple[str, str]]:
        for turn, role in zip(turns, roles, strict=True):
            if turn is not None and turn != self.most:
                self.least = turn if self.least is None else self.least
                self.most, self.distinct = turn, self.distinct + 1
            if self.initial is not None and self.initial + role[:1] not in LEGAL:
                self.counts["illegal"] += 1
            self.initial = role[:1]
        self.counts["blank"] += marks.count(BLANK)
        self.counts["duplicate"] += marks.count(DUPLICATE)
        self.counts["truncated"] += sum(m.isupper() for m in marks)
        edits, then = unrolled(marks, self.state, costs)
        lines = repaired_lines(edits, self.state, iter(zip(roles, texts, strict=True)))
        self.state = then
        return self._written(edits, lines)

    def _written(self, edits: str, lines: list[tuple[str, str]]) -> list[tuple[str, str]]:
        self.audit.append(edits)
        for role, text in lines:
            self.digest.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1
        return lines

    def end(self) -> list[tuple[str, str]]:
        edits = ending(self.state)
        return self._written(edits, repaired_lines(edits, self.state, iter(())))

    def result(self, cost: int) -> dict:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LINES = "array<struct<role:string,text:string>>"
RESULT_TYPE = pa.struct(
    [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RESULT.split(", ")]
)
LINES_TYPE = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _as_lines(lines: list[tuple[str, str]] | None) -> list[dict] | None:
    return None if lines is None else [{"role": role, "text": text} for role, text in lines]


class _Cutter:
    """Turns the sorted rows of one partition into repaired conversations and chunks of the others."""

    def __init__(self, number: int, keep: bool) -> None:
        self.chunk, self.keep = number << 33, keep
        self.out: dict[str, list] = {c: [] for c in ("conv_id", "result", "lines", "chunk", "marks", "turns", "roles", "texts", "keys")}
        self.own: object = None
        self.begun = self.first = False
        self.waiting = 0
        self._clear()

    def _clear(self) -> None:
        self.marks: list[str] = []
        self.turns: list = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.keys: list[bytes | None] = []
        self.chars = 0

    def row(self, conv: object, turn: int | None, role: str, text: str, there: bool) -> None:
        if not self.begun or conv != self.own:
            self.close(edge=self.first)
            # The first conversation of a partition may have begun in the one before.
            self.own, self.first, self.begun = conv, not self.begun, True
            self.seen: set[bytes] = set()
            self.long = False
        if not there:
            return
        if self.marks and (len(self.marks) >= CHUNK_ROWS or self.chars + len(text) > CHUNK_CHARS):
            self.long = True
            self._cut()
        key = hashlib.blake2b(f"{role}\0{text}".encode(), digest_size=16).digest()
        found = mark(role, text, key in self.seen)
        self.keys.append(None if found in (BLANK, DUPLICATE) else key)
        self.seen.add(key)
        self.marks.append(found)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def _put(self, **values: object) -> None:
        for column, held in self.out.items():
            held.append(self.own if column == "conv_id" else values.get(column))

    def _cut(self) -> None:
        self.waiting += self.chars
        self._put(chunk=self.chunk, marks="".join(self.marks), turns=self.turns, roles=self.roles, texts=self.texts, keys=self.keys)
        self.chunk += 1
        self._clear()

    def close(self, edge: bool) -> None:
        if not self.begun:
            return
        if edge or self.long:
            self._cut()
            return
        marks, report = "".join(self.marks), Report()
        cost = END
        for symbol, length in reversed(symbols(marks)):
            cost = backwards(symbol, length, cost)
        lines = report.feed(marks, self.turns, self.roles, self.texts, END) + report.end()
        self.waiting += self.chars if self.keep else len(lines)
        self._put(result=report.result(cost[START]), lines=_as_lines(lines) if self.keep else None)
        self._clear()

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        """What is ready; ``kind`` is the type of conv_id."""
        texts = pa.list_(pa.string())
        types = [kind, RESULT_TYPE, LINES_TYPE, pa.int64(), pa.string(), pa.list_(pa.int64()), texts, texts, pa.list_(pa.binary())]
        made = pa.record_batch([pa.array(v, t) for v, t in zip(self.out.values(), types, strict=True)], list(self.out))
        self.out, self.waiting = {c: [] for c in self.out}, 0
        return made


def _cut(rows: DataFrame, keep: bool) -> DataFrame:
    """Conversations repaired on the spot (``result``), and chunks of the others."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(TaskContext.get().partitionId(), keep)
        kind = None
        for batch in batches:
            kind = batch.column("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "there")), strict=True):
                cutter.row(*row)
                if cutter.waiting >= CHUNK_CHARS or len(cutter.out["conv_id"]) >= CHUNK_ROWS:
                    yield cutter.batch(kind)
        if cutter.begun:
            # The last one may go on in the next partition.
            cutter.close(edge=True)
            yield cutter.batch(kind)

    schema = f"conv_id {conv}, result struct<{RESULT.replace(' ', ':').replace(',:', ',')}>, lines {LINES}, chunk long, "
    schema += "marks string, turns array<long>, roles array<string>, texts array<string>, keys array<binary>"
    return rows.mapInArrow(cut, schema)


def _repeats(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``repeats``: places of rows whose role and text an earlier chunk of the conversation has."""
    # A chunk names a key once for each stretch of a partition, so a key has at most one row a partition.
    named = chunks.select("conv_id", "chunk", F.posexplode("keys").alias("at", "key")).where("key is not null")
    again = named.groupBy("conv_id", "key").agg(F.min("chunk").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    met = named.alias("n").join(
        again.alias("f"), F.col("n.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("n.key") == F.col("f.key")) & (F.col("n.chunk") > F.col("f.first"))
    )
    return met.groupBy("n.chunk").agg(F.collect_list("n.at").alias("repeats"))


def _costs(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``marks`` with all repeats, ``costs`` after the chunk, ``total`` before it; chunks last to first."""

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, begun, after = None, False, END
        for batch in batches:
            out: dict[str, list] = {"chunk": [], "marks": [], "costs": [], "total": []}
            for conv, chunk, marks, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != own:
                    own, begun, after = conv, True, END
                held = list(marks)
                for at in repeats or ():
                    held[at] = DUPLICATE
                marks = "".join(held)
                out["chunk"].append(chunk)
                out["marks"].append(marks)
                out["costs"].append(list(after))
                for symbol, length in reversed(symbols(marks)):
                    after = backwards(symbol, length, after)
                out["total"].append(after[START])
            types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    narrow = chunks.select("conv_id", "chunk", "marks").join(_repeats(chunks), "chunk", "left").select("conv_id", "chunk", "marks", "repeats")
    falling = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("chunk"))
    return falling.mapInArrow(costs, "chunk long, marks string, costs array<long>, total long")


def _joined(chunks: DataFrame, keep: bool) -> DataFrame:
    """Repairs the conversations that are in chunks: one row with the result for each, and rows of lines if asked for."""

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, report, total, last, kind = None, None, 0, 0, None
        for batch in batches:
            kind = batch.column("conv_id").type
            out: list[tuple] = []
            for conv, chunk, marks, costs, before, turns, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if report is None or conv != own:
                    if report is not None:
                        out.append((own, last + 1, _as_lines(report.end()), report.result(total)))
                    # Of the first chunk: what everything costs.
                    own, report, total = conv, Report(), before
                last = chunk
                lines = report.feed(marks, turns, roles, texts, tuple(costs))
                if keep:
                    out.append((conv, chunk, _as_lines(lines), None))
            yield _batch(out, kind)
        if report is not None:
            yield _batch([(own, last + 1, _as_lines(report.end()), report.result(total))], kind)

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        types = [kind, pa.int64(), LINES_TYPE, RESULT_TYPE]
        return pa.record_batch([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["conv_id", "chunk", "lines", "result"])

    wide = chunks.select("conv_id", "chunk", "turns", "roles", "texts").join(_costs(chunks), "chunk")
    rising = wide.select("conv_id", "chunk", "marks", "costs", "total", "turns", "roles", "texts")
    rising = rising.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    conv = chunks.schema["conv_id"].dataType.simpleString()
    return rising.mapInArrow(repair, f"conv_id {conv}, chunk long, lines {LINES}, result struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")


def _repaired(rows: DataFrame, there: Column | None, keep: bool) -> tuple[DataFrame, DataFrame]:
    blank = F.lit(" ")
    own = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
        (F.lit(True) if there is None else there).alias("there"),
        F.xxhash64("text").alias("t"),
        F.monotonically_increasing_id().alias("n"),
    )
    order = ["conv_id", "turn", "role", "t", "n"]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "there")
    cut = staged(_cut(ordered, keep), "turns")
    return cut.where("chunk is null"), cut.where("chunk is not null")


def repair(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """One row for each conversation of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``): what is wrong and the cheapest repair.

    ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``,
    ``repaired_sha256``. Rows whose ``there`` is false only name their conversation; one without other rows
    has zeros, no edits and the hash of nothing. A null role or text is one space; null turns come first; rows
    without a conv_id are one conversation. Equal turns go by role, then by a hash of the text. Repeated rows
    are duplicates. An empty table gives an empty one; other columns are not read. The edits of a conversation
    are one string and its hash takes its lines in turn, so a conversation's chunks pass through one task, one
    chunk at a time; all that precedes is spread.
    """
    done, chunks = _repaired(rows, there, keep=False)
    ends = _joined(chunks, keep=False).select("conv_id", "result.*")
    return done.select("conv_id", "result.*").unionByName(ends)


def repaired_turns(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """``conv_id``, ``turn`` from 0, ``role``, ``text`` of the repaired conversations; takes what ``repair`` takes."""
    done, chunks = _repaired(rows, there, keep=True)
    short = done.select("conv_id", F.posexplode("lines").alias("turn", "line")).select("conv_id", F.col("turn").cast("long"), "line.*")
    parts = staged(_joined(chunks, keep=True).select("conv_id", "chunk", "lines"), "lines")
    # Numbers of lines before each chunk: two numbers a chunk.
    sizes = parts.select("conv_id", "chunk", F.size("lines").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select("chunk", F.coalesce(before, F.lit(0)).alias("first"), "conv_id")
    same = F.col("p.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("p.chunk") == F.col("f.chunk"))
    lines = parts.alias("p").join(firsts.alias("f"), same).select("p.conv_id", "first", F.posexplode("lines").alias("at", "line"))
    return short.unionByName(lines.select("conv_id", (F.col("first") + F.col("at")).alias("turn"), "line.*"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (``there`` is false), 1 empties its
    text, 2 takes its ``[.!?]`` out, 3 repeats it, 4 makes its role user. Nulls, but for the turn, become one space."""

    def spaced(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), kind.alias("kind"))
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")
