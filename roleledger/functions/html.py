"""Pieces of HTML pages, all in the JVM.

Elements are cut by their own tags: the tags of one name are taken out of the page in order, an end tag closes
the last start tag still open, and what lies between the two is the element, whatever it holds. Comments,
scripts and styles are passed over.
"""

from __future__ import annotations

import functools
import html
import json
import zlib
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"^[\s\x{A0}]+|[\s\x{A0}]+$"


# Numeric or named, as HTML reads them: the semicolon may lack.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names that work without a semicolon are no longer than this.
LONGEST_BARE = max(len(name) for name in html5 if not name.endswith(";"))
NAME_BUCKETS = 4096


def _literal(table: str, schema: str = "map<string,string>") -> Column:
    # One literal of the plan, rather than a call with thousands of arguments.
    return F.from_json(F.lit(table), schema)


@functools.cache
def _names() -> str:
    # Few names share a remainder, so one is found without going through all of them.
    buckets: list[dict[str, str]] = [{} for _ in range(NAME_BUCKETS)]
    for name, char in html5.items():
        buckets[zlib.crc32(name.encode()) % NAME_BUCKETS][name] = char
    return json.dumps(buckets)


@functools.cache
def _odd_numbers() -> str:
    """Code points below 0xA0 that stand for something else, by the rule of the standard library."""
    return json.dumps({str(i): html.unescape(f"&#{i};") for i in range(0xA0) if html.unescape(f"&#{i};") != chr(i)})


def _numbered(reference: Column) -> Column:
    hexadecimal = F.lower(F.substring(reference, 3, 1)) == "x"
    digits = F.regexp_replace(reference, "^&#[xX]?0*(?=.)|;$", "")
    # No code point has more than seven digits, and more would overflow.
    code = F.when(F.length(digits) <= 7, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)).try_cast("bigint")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    beyond = code.isNull() | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    unused = code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
    odd = F.element_at(_literal(_odd_numbers()), code.cast("string"))
    return F.coalesce(odd, F.when(beyond, "\ufffd").when(unused, "").otherwise(char))


def _named(reference: Column, names: Column) -> Column:
    """By the longest name that the reference begins with; what is no name stays as it is."""
    name = F.substring(reference, 2, 64)
    sizes = F.array(F.length(name), *[F.lit(size) for size in range(LONGEST_BARE, 1, -1)])

    def char(begin: Column) -> Column:
        return F.element_at(F.get(names, F.pmod(F.crc32(begin), F.lit(NAME_BUCKETS)).cast("int")), begin)

    tried = F.transform(sizes, lambda k: F.struct(char(F.substring(name, F.lit(1), k)).alias("char"), F.substring(name, k + 1, F.lit(64)).alias("rest")))
    found = F.get(F.filter(tried, lambda t: t["char"].isNotNull()), F.lit(0))
    return F.coalesce(F.concat(found["char"], found["rest"]), reference)


def unescaped(text: Column) -> Column:
    """Character references replaced by what they stand for, in one pass from left to right."""
    names = _literal(_names(), "array<map<string,string>>")

    def replaced(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({REFERENCE})"), F.lit(1))
        decoded = F.transform(found, lambda r: F.when(r.startswith("&#"), _numbered(r)).otherwise(_named(r, names)))
        both = F.zip_with(F.split(t, REFERENCE, -1), decoded, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(both, "")).otherwise(t)

    # As the element of an array the text, which may be the outcome of much work, is made once.
    return F.get(F.transform(F.array(text), replaced), F.lit(0))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def stripped(text: Column) -> Column:
    """Without blanks, line ends and no-break spaces at both ends."""
    return F.regexp_replace(text, SPACE, "")


def inner_text(html: Column) -> Column:
    return stripped(unescaped(without_tags(html)))


def block_pattern(tag: str, css_class: str | None = None) -> str:
    """Pattern of one ``tag`` block that holds no other block of that tag; group 1 is its inside."""
    attributes = r"(?:\s[^>]*)?" if css_class is None else rf'\s[^>]*\bclass="(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"[^>]*'
    return rf"(?is)<{tag}{attributes}>(.*?)</{tag}\s*>"


def first_match(html: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null, not an empty text, when nothing matches."""
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, group))


def attribute(html: Column, name: str) -> Column:
    """Value of the first attribute of that name, with quotes of either kind or none."""
    value = first_match(html, rf"""(?is)<[^>]*\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
    return unescaped(F.regexp_replace(value, """^["']|["']$""", ""))


# What may hold tags that are none.
PASSED_OVER = r"<!--.*?-->|<script(?=[\s/>]).*?</script\s*>|<style(?=[\s/>]).*?</style\s*>"
_REST_OF_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
# A tag of another name matters only if a value of its attributes looks like a tag.
_MISLEADING_TAG = r"<[a-z](?=[^>]*<)" + _REST_OF_TAG


def has_class(css_class: str) -> str:
    """Pattern of a start tag with this class, in quotes of either kind or none."""
    return rf"""(?is)^<[^>]*?\sclass\s*=\s*(?:"(?:[^"]*\s)?{css_class}(?:\s[^"]*)?"|'(?:[^']*\s)?{css_class}(?:\s[^']*)?'|{css_class}(?=[\s/>]))"""


def has_id(element_id: str) -> str:
    return rf"""(?is)^<[^>]*?\sid\s*=\s*(?:"{element_id}"|'{element_id}'|{element_id}(?=[\s/>]))"""


def with_elements(df: DataFrame, source: str, tag: str | Column, wanted: str | None, name: str) -> DataFrame:
    """Add ``name``, the elements of the column ``source`` with this tag whose start tag matches ``wanted``, in order.

    Elements in elements of the same tag come out whole, and each of them if it matches. One that is never closed
    runs to the end. A tag given as a column may differ from row to row.
    """
    own = F.concat(F.lit("</?"), F.lit(tag) if isinstance(tag, str) else tag, F.lit(r"(?=[\s/>])"))
    pattern = F.concat(F.lit(f"(?is)({PASSED_OVER}|"), own, F.lit(f"{_REST_OF_TAG}|{_MISLEADING_TAG})"))
    # Columns of their own, since the functions below read them by position for every tag.
    df = df.withColumn("_pattern", pattern).withColumn("_own", F.concat(F.lit("(?i)^"), own))
    df = df.withColumn("_tags", F.regexp_extract_all(source, F.col("_pattern"), F.lit(1)))
    df = df.withColumn("_between", F.split(F.col(source), F.col("_pattern"), -1))

    def step(state: Column, at: Column) -> Column:
        text = F.get("_tags", at)
        top = F.try_element_at(state["open"], F.lit(-1))
        opened = F.concat(state["open"], F.array(F.struct(at.alias("at"), (F.lit(True) if wanted is None else text.rlike(wanted)).alias("wanted"))))
        closed = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        done = F.when(F.coalesce(top["wanted"], F.lit(False)), F.concat(state["done"], F.array(F.struct(top["at"].alias("first"), at.alias("last")))))
        return (
            F.when(~F.regexp(text, F.col("_own")) | text.endswith("/>"), state)
            .when(text.startswith("</"), F.struct(closed.alias("open"), F.coalesce(done, state["done"]).alias("done")))
            .otherwise(F.struct(opened.alias("open"), state["done"].alias("done")))
        )

    start = F.struct(
        F.array().cast("array<struct<at:int,wanted:boolean>>").alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("done")
    )
    # The array of places, not of texts: the state stays small.
    places = F.when(F.size("_tags") > 0, F.sequence(F.lit(0), F.size("_tags") - 1)).otherwise(F.array().cast("array<int>"))
    left_open = lambda s: F.transform(
        F.filter(s["open"], lambda o: o["wanted"]), lambda o: F.struct(o["at"].alias("first"), F.lit(-1).alias("last"))
    )
    spans = F.aggregate(places, start, step, lambda s: F.sort_array(F.concat(s["done"], left_open(s))))
    df = df.withColumn("_spans", F.when(F.col("_tags").isNotNull(), spans))

    def cut(span: Column) -> Column:
        last = F.when(span["last"] < 0, F.size("_tags") - 1).otherwise(span["last"])
        after = lambda i: F.when((i < last) | (span["last"] < 0), F.get("_between", i + 1)).otherwise("")
        return F.array_join(F.transform(F.sequence(span["first"], last), lambda i: F.concat(F.get("_tags", i), after(i))), "")

    return df.withColumn(name, F.transform("_spans", cut)).drop("_pattern", "_own", "_tags", "_between", "_spans")


def with_text_by_id(df: DataFrame, source: str, element_id: str, name: str) -> DataFrame:
    """Add ``name``, the text of the element with this id, nested ones included; null where there is none."""
    opening = rf"""(?is)<([a-z][a-z0-9]*)(?=\s)(?:[^>"']++|"[^"]*+"|'[^']*+')*?\sid\s*=\s*(?:"{element_id}"|'{element_id}'|{element_id}(?=[\s/>]))"""
    found = F.regexp_extract(source, opening, 1)
    df = df.withColumn("_tag", F.nullif(found, F.lit("")))
    # Only from the element on, so that the tags before it are not gone through.
    rest = F.regexp_substr(F.col(source), F.concat(F.lit(opening), F.lit("(?s).*")))
    df = with_elements(df.withColumn("_rest", rest), "_rest", F.col("_tag"), has_id(element_id), "_elements")
    plain = F.regexp_replace(F.get("_elements", F.lit(0)), f"(?is){PASSED_OVER}", "")
    return df.withColumn(name, inner_text(plain)).drop("_tag", "_rest", "_elements")
