"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

The graph starts from blocks of vectors with like signs under random hyperplanes. A round of NN-descent
joins every node's neighbours, forward and back, with each other: whoever is found nearer than a node's
present neighbours takes a place among them. Queries then search the graph greedily: the best vectors
known are expanded to their neighbours, round by round. Graph and search use vectors of one byte a
component; the vectors found are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roleledger.llm.tables import staged

NEIGHBOURS = 24
TABLES = 16
SIGN_BITS = 16
BLOCK = 1024
KEPT_OF_BLOCK = 16
# Rounds go on until fewer than this share of the lists change, or so many are done.
SETTLED = 0.05
ROUNDS = 5
# Neighbours that a node offers each member of its neighbourhood in a round.
OFFERED = 4
SEARCH_ROUNDS = 4
EXPANDED = 24
BEAM = 160
TOP = 20
CODE = "id long, scale float, code binary"


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``embedding``: the vectors that take part, each id once."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").where(good & some)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("embedding") == (sizes[0]["size"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.array(batch.column(1).to_pylist(), np.float32).reshape(batch.num_rows, -1)
        scale = np.abs(x).max(axis=1, initial=0) / 127
        code = np.round(x / scale[:, None]).astype(np.int8) if len(x) else x.astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scale, pa.float32()), pa.array([c.tobytes() for c in code], pa.binary())],
            ["id", "scale", "code"],
        )


def _matrix(scale: pa.Array, code: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(len(code), -1)
    return raw.astype(np.float32) * scale.to_numpy(zero_copy_only=False)[:, None]


def _lists(ids: np.ndarray, near: np.ndarray, likeness: np.ndarray) -> pa.RecordBatch:
    """A row per id and neighbour, without neighbours of likeness -inf."""
    to, n, s = np.repeat(ids, near.shape[1]), near.ravel(), likeness.ravel()
    keep = np.isfinite(s)
    return pa.RecordBatch.from_arrays([pa.array(to[keep]), pa.array(n[keep]), pa.array(s[keep].astype(np.float32))], ["id", "near", "sim"])


def _best(matrix: np.ndarray, most: int) -> np.ndarray:
    most = min(most, matrix.shape[1])
    return np.argpartition(-matrix, most - 1, axis=1)[:, :most]


def _start(codes: DataFrame) -> DataFrame:
    """First neighbours: the best within blocks that are consecutive in the order of sign codes, in each table."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), batch.column(2))
            planes = np.random.default_rng(7).standard_normal((x.shape[1], TABLES * SIGN_BITS)).astype(np.float32)
            bits = (x @ planes > 0).reshape(len(x), TABLES, SIGN_BITS)
            order = bits.astype(np.int64) @ (1 << np.arange(SIGN_BITS)[::-1])
            order += np.arange(TABLES) << SIGN_BITS
            yield batch.append_column("orders", pa.array(list(order), pa.list_(pa.int64())))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def joined(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Neighbours of all full blocks, and of the rest if no more rows come; then the rows left."""
            table = rows["order"].to_numpy() >> SIGN_BITS
            ends = [*(np.flatnonzero(np.diff(table)) + 1), len(table)]
            at = 0
            for end in ends:
                final = last or end != len(table)
                while end - at > (0 if final else 2 * BLOCK):
                    size = BLOCK if end - at >= 2 * BLOCK else end - at
                    part = rows.slice(at, size).combine_chunks()
                    ids, x = part["id"].to_numpy(), _matrix(part["scale"].combine_chunks(), part["code"].combine_chunks())
                    matrix = x @ x.T
                    matrix[ids[:, None] == ids] = -np.inf
                    best = _best(matrix, KEPT_OF_BLOCK)
                    yield _lists(ids, ids[best], np.take_along_axis(matrix, best, 1))
                    at += size
            yield rows.slice(at)

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 4 * BLOCK:
                for out in joined(pa.Table.from_batches(waiting), False):
                    if isinstance(out, pa.Table):
                        waiting = out.to_batches()
                    else:
                        yield out
        if waiting:
            yield from (out for out in joined(pa.Table.from_batches(waiting), True) if isinstance(out, pa.RecordBatch))

    ordered = codes.mapInArrow(signs, f"{CODE}, orders array<long>").select("id", "scale", "code", F.explode("orders").alias("order"))
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionByRange(parts, "order", "id").sortWithinPartitions("order", "id")
    return dealt.mapInArrow(blocks, "id long, near long, sim float")


def _nearest(rows: DataFrame, most: int) -> DataFrame:
    """``id``, ``near`` (array, nearest first), ``worst``: the best of the proposed neighbours; each once."""
    found = F.reverse(F.array_sort(F.collect_set(F.struct("sim", "near"))))
    lists = rows.groupBy("id").agg(F.slice(found, 1, most).alias("f"))
    worst = F.when(F.size("f") < most, F.lit(float("-inf"))).otherwise(F.element_at("f", -1)["sim"])
    return lists.select("id", F.col("f.near").alias("near"), F.col("f.sim").alias("sims"), worst.cast("float").alias("worst"))


def _both_ways(graph: DataFrame, most: int) -> DataFrame:
    """``node``, ``member``: neighbours forward, and as many back, chosen by a hash."""
    ahead = graph.select(F.col("id").alias("node"), F.explode("near").alias("member"))
    back = ahead.select(F.col("member").alias("node"), F.struct(F.xxhash64("node", "member").alias("h"), F.col("node").alias("m")).alias("s"))
    # A node that many others point to is cut into parts first, so that no task gathers all of them.
    parts = back.groupBy("node", F.pmod("s.h", F.lit(64)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("s")), 1, most).alias("l"))
    some = parts.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, most).alias("l"))
    return ahead.unionByName(some.select("node", F.explode("l.m").alias("member"))).distinct()


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the members of each neighbourhood: what each of them should know of the others."""
    for batch in batches:
        for members in batch.column(1):
            part = members.values
            ids = part.field("id").to_numpy(zero_copy_only=False)
            if len(ids) < 2:
                continue
            x = _matrix(part.field("scale"), part.field("code"))
            matrix = x @ x.T
            np.fill_diagonal(matrix, -np.inf)
            best = _best(matrix, OFFERED)
            sims = np.take_along_axis(matrix, best, 1)
            sims[sims <= part.field("worst").to_numpy(zero_copy_only=False)[:, None]] = -np.inf
            yield _lists(ids, ids[best], sims)


def build_graph(codes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """``id``, ``near``, ``sims``, ``worst`` for every vector of the staged table ``codes``; ``rounds`` at most."""
    graph = staged(_nearest(_start(codes), neighbours), "graph")
    nodes, changed = graph.count(), 1.0
    for _ in range(rounds):
        if changed < SETTLED:
            break
        member = codes.join(graph.select("id", "worst"), "id").select(F.struct("id", "scale", "code", "worst").alias("m"), F.col("id").alias("member"))
        around = _both_ways(graph, neighbours).join(member, "member")
        # At most twice ``neighbours`` members.
        offered = around.groupBy("node").agg(F.collect_list("m").alias("m")).mapInArrow(_offers, "id long, near long, sim float")
        known = graph.select("id", F.explode(F.arrays_zip("near", "sims")).alias("k")).select("id", "k.near", F.col("k.sims").alias("sim"))
        before, graph = graph, staged(_nearest(known.unionByName(offered), neighbours), "graph")
        lists = graph.select("id", F.sort_array("near").alias("now")).join(before.select("id", F.sort_array("near").alias("then")), "id")
        changed = lists.where("now != then").count() / max(nodes, 1)
    return graph


def _wider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score a query's new candidates and merge them into its beam."""
    for batch in batches:
        out = []
        for query in batch.to_struct_array() if batch.num_rows else []:
            found = query["found"].values
            beam = {b["near"]: (b["sim"], b["done"]) for b in query["beam"].as_py()}
            x = _matrix(found.field("scale"), found.field("code"))
            own = np.frombuffer(query["code"].as_py(), np.int8).astype(np.float32) * query["scale"].as_py()
            for near, sim in zip(found.field("id").to_pylist(), (x @ own).tolist(), strict=True):
                beam.setdefault(near, (sim, False))
            best = sorted(((s, n, d) for n, (s, d) in beam.items()), key=lambda b: (-b[0], b[1]))[:BEAM]
            out.append({"id": query["id"].as_py(), "beam": [{"near": n, "sim": s, "done": d} for s, n, d in best]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), ("beam", pa.list_(BEAM_TYPE))]))


BEAM_TYPE = pa.struct([("near", pa.int64()), ("sim", pa.float32()), ("done", pa.bool_())])
BEAM_SQL = "array<struct<near:bigint,sim:float,done:boolean>>"


def search(codes: DataFrame, graph: DataFrame, queries: DataFrame, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """``id``, ``beam`` for the vectors in ``queries`` (``id``): the nearest found, themselves left out."""
    links = staged(_both_ways(graph, NEIGHBOURS).groupBy("node").agg(F.collect_list("member").alias("members")), "links")
    start = F.transform(F.arrays_zip("near", "sims"), lambda x: F.struct(x["near"].alias("near"), x["sims"].alias("sim"), F.lit(False).alias("done")))
    beams = staged(graph.join(queries, "id", "left_semi").select("id", start.cast(BEAM_SQL).alias("beam")), "beams")
    for _ in range(rounds):
        open_places = F.slice(F.filter(F.col("beam"), lambda b: ~b["done"]), 1, EXPANDED)
        chosen = F.transform(open_places, lambda b: b["near"])
        expanded = beams.select("id", F.explode(chosen).alias("node")).join(links, "node")
        found = expanded.select("id", F.explode("members").alias("near")).distinct()
        # Vectors of the beam are known already.
        known = beams.select("id", F.explode("beam.near").alias("near"))
        found = found.where("id != near").join(known, ["id", "near"], "left_anti")
        vectors = codes.select(F.col("id").alias("near"), F.struct("id", "scale", "code").alias("v"))
        found = found.join(vectors, "near").groupBy("id").agg(F.collect_list("v").alias("found"))
        marked = F.transform("beam", lambda b: F.struct(b["near"].alias("near"), b["sim"].alias("sim"), (b["done"] | F.array_contains(F.col("chosen"), b["near"])).alias("done")))
        own = beams.withColumn("chosen", chosen).select("id", marked.alias("beam")).join(codes, "id")
        joined = own.join(found, "id", "left")
        merged = joined.where("found is not null").select("id", "scale", "code", "beam", "found").mapInArrow(_wider, f"id long, beam {BEAM_SQL}")
        beams = staged(merged.unionByName(joined.where("found is null").select("id", F.col("beam").cast(BEAM_SQL).alias("beam"))), "beams")
    return beams


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``top`` nearest found of every query, nearest first.

    Queries are the rows of ``vectors`` (``vec_id``, ``embedding``) that ``is_query`` picks; candidates all
    others. Nearness is the inner product, in double precision; ties go to the smaller vec_id. Vectors that
    are null or zero, hold null or non-finite components, have no id, or another length than most take no
    part; of rows that repeat an id one counts. An empty table gives no rows.
    """
    rows = staged(usable(vectors.select("vec_id", "embedding")), "vectors")
    nodes = staged(rows.groupBy("embedding").agg(F.min("vec_id").alias("node")), "nodes")
    of = staged(rows.join(nodes, "embedding").select("vec_id", "node"), "of")
    # No query needs more than these ids of a node: one of them may be its own.
    place = F.row_number().over(W.partitionBy("node").orderBy("vec_id"))
    ids = staged(of.withColumn("place", place).where(F.col("place") <= top + 1).select("node", "vec_id"), "node-ids")
    codes = staged(nodes.select(F.col("node").alias("vec_id"), "embedding").mapInArrow(_codes, CODE), "codes")
    graph = build_graph(codes)
    asked = rows.where(is_query).select("vec_id").join(of, "vec_id").select(F.col("vec_id").alias("query_id"), "node")
    asked = staged(asked, "asked")
    wanted = staged(asked.select("node").distinct(), "wanted")
    beams = search(codes, graph, wanted.select(F.col("node").alias("id")))
    found = beams.select(F.col("id").alias("node"), F.explode(F.slice(F.col("beam.near"), 1, 3 * top)).alias("near"))
    found = found.unionByName(wanted.select("node", F.col("node").alias("near"))).join(nodes.withColumnRenamed("node", "near"), "near")
    own = nodes.select("node", F.col("embedding").alias("query"))
    product = F.zip_with("query", "embedding", lambda a, b: a.cast("double") * b.cast("double"))
    score = F.aggregate(product, F.lit(0.0), lambda total, x: total + x)
    scored = found.join(own, "node").select("node", "near", score.alias("score"))
    each = scored.join(ids.withColumnRenamed("node", "near"), "near").select("node", F.struct((-F.col("score")).alias("s"), "vec_id").alias("b"))
    # At most ``top + 1`` ids of each of some three times ``top`` nodes.
    best = each.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("b")), 1, top + 1).alias("best"))
    lists = asked.join(staged(best, "best"), "node").select(
        "query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top).alias("best")
    )
    ranked = lists.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
