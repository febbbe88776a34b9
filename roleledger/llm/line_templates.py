"""Line dedup by a tree of line templates, with DataFrame functions only.

A line's path in the tree is its number of words and its first ``LEAD`` words, digits generalised. Beyond the lead,
a word that enough lines of the leaf have at its place may be a constant of a template, and the other places are
variable fields. A leaf keeps many templates: for every line all its common words, and these without a field of
one to three words, or without the least common ones, as long as enough of the words beyond the lead are
constant. A template recurs if enough classes of documents hold it, where a document and its near copies
are one class. So the lines of a copied document are no boilerplate, however many copies there are and however many
words were edited in some of them, and the lines of a block of boilerplate are, though they always have the
same neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roleledger.llm.copies import copy_classes
from roleledger.llm.tables import bounded, members, settled, staged

LEAD = 3
# Classes of documents that hold a recurring template.
MIN_DOCUMENTS = 10
# A template has at least this share of the words beyond the lead as constants.
SIMILARITY = 0.6
# Neighbouring common words that may be one variable field.
FIELD = 3
BLANKS = " \t\r\f\x0B"
SPACE = f"[{BLANKS}]+"


# Digits of words without letters; other words with digits are names, which differ or not as they are.
NUMBER = r"(?=[0-9])(?<!\p{L}[^ ]{0,30})[0-9]+(?![^ ]*\p{L})"


def _masked(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.when(line.rlike("[0-9]") & line.rlike(r"\p{L}"), F.regexp_replace(plain, NUMBER, "0")).otherwise(plain)


def _lead(line: Column) -> Column:
    return F.regexp_replace(F.substring_index(line, " ", LEAD), "[0-9]+", "0")


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: document, number, masked line, words and path."""
    found = docs.select("row", F.posexplode(F.split("text", "\n")).alias("number", "line"))
    # Blank lines go by their raw text, or the filter would mask every line once more.
    found = found.where(F.btrim("line", F.lit(BLANKS)) != "")
    found = found.select("row", "number", _masked(F.col("line")).alias("line"))
    words = F.size(F.split("line", " "))
    # Short lines are their own template, and lines of numbers have none.
    lead = F.when(words <= LEAD, F.col("line")).otherwise(_lead(F.col("line")))
    return found.select("row", "number", "line", words.alias("words"), F.concat_ws(" ", words, lead).alias("path"))


def templates(lines: DataFrame, min_documents: int, similarity: float = SIMILARITY) -> DataFrame:
    """``line``, ``template``: for each different line of ``lines`` (``path``, ``line``, ``words``) the templates it follows.

    Both are hashes. Templates that fewer than ``min_documents`` lines follow are left out.
    """
    variants = lines.groupBy("path", "words", "line").agg(F.count("*").alias("n"))
    variants = staged(variants.withColumns({"id": F.xxhash64("path", "line"), "leaf": F.xxhash64("path")}), "variants")
    short = variants.where(F.col("words") <= LEAD).select("id", "n", F.array("leaf").alias("templates"))
    tails = variants.where(F.col("words") > LEAD).select("id", "leaf", "n", "words", F.split("line", " ").alias("w"))
    places = tails.select("id", "leaf", "n", "words", F.posexplode(F.slice("w", LEAD + 1, F.col("words") - LEAD)).alias("place", "word"))
    places = staged(places.withColumn("key", F.xxhash64("leaf", "place", "word")).select("id", "leaf", "n", "words", "place", "key"), "places")
    common = places.groupBy("key").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_documents)
    held = places.join(bounded(staged(common, "common")), "key")
    need = F.ceil(F.lit(similarity) * (F.col("words") - LEAD)).cast("int").alias("need")
    # A set of constants is hashed by sums over its members, which run along the line, so that a line of n words
    # costs in proportion to n. Two sums of forty bits each; neither can overflow.
    bits = [F.col("key").bitwiseAND(F.lit((1 << 40) - 1)), F.shiftrightunsigned("key", 24)]
    held = held.select("id", "leaf", "n", need, "place", "lines", *(b.alias(f"s{i}") for i, b in enumerate(bits)))
    whole, along = W.partitionBy("id"), W.partitionBy("id").orderBy("place")
    ranked = W.partitionBy("id").orderBy(F.desc("lines"), "place")
    sums = {"size": F.count("*").over(whole), "at": F.row_number().over(along), "rank": F.row_number().over(ranked)}
    for i in range(len(bits)):
        sums[f"all{i}"] = F.sum(f"s{i}").over(whole)
        sums[f"best{i}"] = F.sum(f"s{i}").over(ranked.rowsBetween(W.unboundedPreceding, 0))
        for width in range(1, FIELD + 1):
            sums[f"run{width}{i}"] = F.sum(f"s{i}").over(along.rowsBetween(0, width - 1))
    held = held.select("*", *(f.alias(k) for k, f in sums.items())).where("size >= need")
    found = [F.when(F.col("rank") >= F.col("need"), F.xxhash64("leaf", "best0", "best1"))]
    for width in range(1, FIELD + 1):
        rest = [F.col(f"all{i}") - F.col(f"run{width}{i}") for i in range(len(bits))]
        fits = (F.col("at") + width - 1 <= F.col("size")) & (F.col("size") - width >= F.col("need"))
        found.append(F.when(fits, F.xxhash64("leaf", *rest)))
    own = F.array_distinct(F.flatten(F.collect_list(F.array_compact(F.array(*found)))))
    long = held.groupBy("id").agg(F.first("n").alias("n"), own.alias("templates"))
    all_lines = staged(short.unionByName(long), "line-templates").select("id", "n", F.explode("templates").alias("template"))
    often = all_lines.groupBy("template").agg(F.sum("n").alias("lines")).where(F.col("lines") >= min_documents).select("template")
    return all_lines.join(bounded(staged(often, "often")), "template", "left_semi").select(F.col("id").alias("line"), "template")


def recurring_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY) -> DataFrame:
    """``row``, ``number``: the lines of ``docs`` (``row``, ``text``) that follow a recurring template."""
    # Staged, so that lines are cut and masked once.
    lines = staged(_lines(docs), "all-lines")
    leaves = lines.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents).select("path")
    held = staged(lines.join(bounded(staged(leaves, "leaves")), "path", "left_semi"), "lines")
    known = staged(templates(held, min_documents, similarity), "templates")
    follow = held.select("row", "number", F.xxhash64("path", "line").alias("line"))
    follow = staged(members(follow, staged(known.select("line").distinct(), "known"), "line"), "follow")
    rows = staged(follow.select("row").distinct(), "ids")
    classes = copy_classes(members(docs, rows, "row"))
    holders = follow.join(classes, "row").select("line", "class").distinct()
    holders = holders.join(bounded(known), "line").select("template", "class").distinct()
    counts = holders.groupBy("template").agg(F.count("*").alias("n"))
    recurring = staged(counts.where(F.col("n") >= min_documents).select("template"), "recurring")
    chosen = known.join(bounded(recurring), "template", "left_semi").select("line").distinct()
    return members(follow, staged(chosen, "chosen"), "line").select("row", "number")


def drop_recurring_lines(docs: DataFrame, **settings: float) -> DataFrame:
    """``docs`` (any columns, ``doc_id`` and ``text``) without lines of recurring templates, plus ``_dropped``: how many.

    All occurrences go; other lines keep their order and exact text. Null and empty texts stay as they
    are; a text whose lines all go becomes empty. Rows with the same doc_id and text count as one
    document. Lines end at ``\\n``.
    """
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    keyed = docs.select("doc_id", "text").where("text is not null").select(row.alias("row"), "text")

    def numbers() -> DataFrame:
        return recurring_lines(keyed, **settings).groupBy("row").agg(F.collect_set("number").alias("numbers"))

    dropped = settled(docs.sparkSession, "dropped", numbers)
    # The row as one value, so that no name of its columns can meet one of these.
    out = docs.select(F.struct("*").alias("d"), row.alias("row")).join(bounded(dropped, more=F.size("numbers")), "row", "left")
    out = out.withColumn("lines", F.when(F.col("numbers").isNotNull(), F.split("d.text", "\n")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "numbers"), lambda i: F.get("lines", i))
    gone = F.col("d.text").isNotNull() & F.col("numbers").isNotNull()
    text = F.when(gone, F.array_join(kept, "\n")).otherwise(F.col("d.text"))
    count = F.when(gone, F.size("numbers")).otherwise(0)
    own = [text.alias(c) if c.lower() == "text" else F.col("d").getField(c).alias(c) for c in docs.columns if c.lower() != "_dropped"]
    return out.select(*own, count.alias("_dropped"))
