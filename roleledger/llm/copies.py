"""Classes of texts that are copies of each other, with DataFrame functions only.

Texts with the same words are one. Of the others, each is sketched by the smallest hashes of its shingles,
and neighbours in the sketch are its keys. Texts that share a good part of their keys with the first text
that has them are linked, and linked texts are one class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roleledger.llm.components import components
from roleledger.llm.tables import bounded, staged

SPACE = " \t\n\r\f\x0B"
SHINGLE = 3
SKETCH = 32
# Hashes kept before sorting, on average: three times the sketch, so that hardly ever too few are left.
SIFTED = 3 * SKETCH
# Two texts of Jaccard similarity 0.75 share half of their keys, of 0.3 less than a tenth.
SHARED = 1 / 3


def copy_classes(docs: DataFrame) -> DataFrame:
    """``row``, ``class``, ``words`` (how many) for the rows of ``docs`` (``row``, ``text``) whose text has words."""
    # Blank ends are cut off first and rows chosen by their raw text, so that a text is cut into words once.
    words = F.split(F.btrim(F.lower("text"), F.lit(SPACE)), f"[{SPACE}]+")
    texts = docs.where(F.col("text").rlike(f"[^{SPACE}]")).select("row", words.alias("words"))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - SHINGLE, F.lit(0)))
    grams = F.transform(places, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(SHINGLE))))
    hashes = texts.select("row", F.xxhash64("words").alias("t"), F.size("words").alias("count"), F.array_distinct(grams).alias("h"))
    top = F.lit(-(2.0**63)) + 2.0**64 * F.least(F.lit(1.0), F.lit(float(SIFTED)) / F.size("h"))
    low = F.filter("h", lambda x: x.cast("double") <= F.col("top"))
    # Staged, as the filter that comes with explode would repeat all this for every hash.
    sketch = hashes.withColumn("top", top).select("row", "t", "count", F.slice(F.sort_array(low), 1, SKETCH).alias("h"))
    sketch = staged(sketch, "sketches")
    rows = sketch.select("row", "t", F.col("count").alias("words"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("h") - 2), lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1)))
    keyed = sketch.select("t", F.when(F.size("h") > 1, pairs).otherwise(F.col("h")).alias("keys"))
    need = F.ceil(F.size("keys") * SHARED).alias("need")
    keys = staged(keyed.select("t", need, F.explode("keys").alias("key")).distinct(), "keys")
    first = keys.groupBy("key").agg(F.min("t").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    met = keys.join(bounded(staged(first, "first")), "key").where("t != first")
    links = met.groupBy("t", "first").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    found = components(links.select(F.col("t").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "t")
    return rows.join(bounded(found), "t", "left").select("row", F.coalesce("component", "t").alias("class"), "words")
