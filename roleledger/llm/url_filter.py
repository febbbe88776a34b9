"""URL rules by a cascade of Bloom filters that is exact on the corpus's own keys.

The keys of a URL are its host and parent domains joined to the beginnings of its path that are as long
as some rule's path. Level one of a cascade encodes the listed keys, level two those other keys of the
corpus that level one lets through, level three the listed keys that level two lets through, and so on
until nothing is let through. As every key of the corpus was tried when the cascade was made, its answer
for such a key is right, and no URL is joined with the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from roleledger.llm.tables import staged
from roleledger.llm.words import mixed

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Longer lists are joined instead: a cascade takes about 30 bits a key on each executor.
MAX_LISTED = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    bits: np.ndarray
    hashes: int
    seed: int

    def _positions(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(len(self.bits) * 64)
        one, two = mixed(keys[:, 0] + np.uint64(self.seed)), mixed(keys[:, 1] ^ np.uint64(self.seed)) | np.uint64(1)
        for i in range(self.hashes):
            yield (one + np.uint64(i) * two) % size

    def add(self, keys: np.ndarray) -> Level:
        for at in self._positions(keys):
            np.bitwise_or.at(self.bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        return self

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._positions(keys):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def level(keys: np.ndarray, error: float, seed: int) -> Level:
    """A Bloom filter of the keys (two hashes each) with about this rate of false positives."""
    bits = max(64, int(np.ceil(-len(keys) * np.log(error) / np.log(2) ** 2)))
    words = np.zeros(-(-bits // 64), np.uint64)
    return Level(words, max(1, round(-np.log2(error))), seed).add(keys)


def holds(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed: the first level that doesn't hold it decides."""
    listed = np.zeros(len(keys), bool)
    alive = np.arange(len(keys))
    for i, own in enumerate(levels):
        alive = alive[own.holds(keys[alive])]
        listed[alive] = i % 2 == 0
    return listed


def _pairs(df: DataFrame) -> np.ndarray:
    rows = df.select("key.a", "key.b").toPandas()
    return np.ascontiguousarray(rows[["a", "b"]].to_numpy(np.int64)).view(np.uint64).reshape(-1, 2)


def _in(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    known = set(map(tuple, others.tolist()))
    return np.fromiter((tuple(k) in known for k in keys.tolist()), bool, len(keys))


def cascade(listed: np.ndarray, universe: DataFrame) -> list[Level]:
    """Levels that answer rightly for the listed keys and every ``key`` (struct of two hashes) of ``universe``.

    Only the keys that level one lets through come to the driver: with the error rate chosen here they
    are expected to be fewer than the listed ones.
    """
    if not len(listed):
        return []
    several = max(universe.agg(F.approx_count_distinct("key")).first()[0], 1)
    error = float(np.clip(len(listed) * np.sqrt(0.5) / several, 1e-12, 0.5))
    first = level(listed, error, 1)

    def let_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(first.holds(_hashes(batch.column(0), batch.column(1)))))

    passing = universe.select("key.a", "key.b").mapInArrow(let_through, "a long, b long").distinct()
    inside, outside, levels = listed, _pairs(passing.select(F.struct("a", "b").alias("key"))), [first]
    outside = outside[~_in(outside, listed)]
    while len(outside):
        levels.append(level(outside, 0.5, len(levels) + 1))
        inside, outside = outside, inside[levels[-1].holds(inside)]
    return levels


def _hashes(a: pa.Array, b: pa.Array) -> np.ndarray:
    return np.column_stack([a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)]).astype(np.int64).view(np.uint64)


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for a null URL or one without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(known, pattern, 1), UPPER, LOWER), F.regexp_extract(known, pattern, 2)


def _candidates(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """All rule texts that could fit: as many last labels and first characters as some rule has."""
    labels = F.split(host, r"\.")
    ends = F.array(*[F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), ".")) for d in depths])
    starts = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    both = F.flatten(F.transform(F.array_compact(ends), lambda e: F.transform(F.array_compact(starts), lambda s: F.concat(e, s))))
    return F.when((host != "") & F.lit(bool(depths and lengths)), both).otherwise(F.array().cast("array<string>"))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages`` (``url``).

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all its
    subdomains if the path begins with the rule's; the longest one wins, and block wins over an equally
    long allow. Where no rule fits, the key is on neither list and ``default`` holds. Null, empty and
    malformed URLs have an empty host and path and fit no rule; rules with a null part are ignored.
    """
    known = staged(
        rules.where("host is not null and path is not null and verdict in ('allow', 'block')")
        .select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct(),
        "rules",
    )
    shapes = known.agg(
        F.collect_set(F.size(F.split("host", r"\."))), F.collect_set(F.length("path")), F.count("*")
    ).first()
    host, path = url_parts(F.col("url"))
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*columns, host.alias("host"), path.alias("path"))
    texts = _candidates(F.col("host"), F.col("path"), sorted(shapes[0]), sorted(shapes[1]))
    listed = known.select(F.concat("host", "path").alias("text"), "verdict")
    if shapes[2] > MAX_LISTED:
        return _joined(rows.withColumn("_texts", texts), listed, default)

    universe = rows.select(F.explode(texts).alias("text")).unionByName(listed.select("text")).select(_key(F.col("text")).alias("key"))
    lists = [
        cascade(_pairs(listed.where(F.col("verdict") == verdict).select(_key(F.col("text")).alias("key"))), universe)
        for verdict in ("block", "allow")
    ]
    held = pages.sparkSession.sparkContext.broadcast(lists)

    @F.pandas_udf("array<int>")
    def listing(a: pd.Series, b: pd.Series) -> pd.Series:
        """For each key 2 if it is blocked, 1 if it is allowed, else 0."""
        sizes = a.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        keys = np.column_stack([np.concatenate(a.to_numpy()), np.concatenate(b.to_numpy())]).astype(np.int64).view(np.uint64)
        block, allow = (holds(levels, keys) for levels in held.value)
        return pd.Series(np.split(np.where(block, 2, allow.astype(int)), np.cumsum(sizes)[:-1]))

    tried = rows.withColumn("_texts", texts).withColumn(
        "_kinds",
        listing(F.transform("_texts", lambda t: F.xxhash64(t)), F.transform("_texts", lambda t: F.xxhash64(F.lit("second"), t))),
    )
    fitting = F.filter(
        F.zip_with("_texts", "_kinds", lambda t, k: F.struct(F.length(t).alias("n"), k.alias("k"), t.alias("t"))),
        lambda x: x["k"] > 0,
    )
    best = F.array_max(fitting)
    return tried.select(
        *columns, "host", "path", best["t"].alias("rule"),
        F.when(best.isNull(), default).otherwise(F.when(best["k"] == 2, "block").otherwise("allow")).alias("verdict"),
    )


def _joined(rows: DataFrame, listed: DataFrame, default: str) -> DataFrame:
    """The same by joins, for lists too long to send to every executor."""
    columns = [c for c in rows.columns if c != "_texts"]
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    tried = numbered.select("_row", F.explode("_texts").alias("text")).join(listed, "text")
    kind = F.when(F.col("verdict") == "block", 2).otherwise(1)
    best = tried.groupBy("_row").agg(F.max(F.struct(F.length("text").alias("n"), kind.alias("k"), F.col("text").alias("t"))).alias("_best"))
    verdict = F.when(F.col("_best").isNull(), default).otherwise(F.when(F.col("_best.k") == 2, "block").otherwise("allow"))
    return numbered.join(best, "_row", "left").select(*columns, F.col("_best.t").alias("rule"), verdict.alias("verdict"))
