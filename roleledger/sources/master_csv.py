"""The master file that users edit: CSV with a header and multi-line quoted text."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from roleledger.operators import normalize
from roleledger.operators.filters import with_invalid_reason
from roleledger.operators.keys import last_wins
from roleledger.schema import MASTER_CSV_COLUMNS, POSTING_COLUMNS
from roleledger.scratch import staged

_NAME = {"date": "post_date", "blurb": "description", "link": "url", "id": "key_id"}
_TEXT = ["key_id", "title", "company", "location", "description", "short_description", "url", "provider", "query", "wage"]


def read_master(spark: SparkSession, path: str, tag_separator: str = "\n") -> DataFrame:
    """Typed postings of a master file or a folder of them.

    Columns are taken by name, so older files that lack some still read, alone or beside others. Bytes that
    are no UTF-8 are left out. A later line replaces an earlier one with the same key; lines without a key are
    among those of ``rejected_master_rows``. A file is one task, since quoted line ends hide where lines begin.
    """
    postings = _lines(spark, path, tag_separator)
    return last_wins(postings.where("key_id != ''"), ["_file", "_line"]).drop("_file", "_line")


def rejected_master_rows(spark: SparkSession, path: str, tag_separator: str = "\n") -> DataFrame:
    """The lines that are no valid postings, each with ``invalid_reason``."""
    return with_invalid_reason(_lines(spark, path, tag_separator)).where("invalid_reason is not null").drop("_file", "_line")


def _layouts(spark: SparkSession, path: str) -> list[str | list[str]]:
    """What to read together, by header: the whole path if there is one header, else lists of file names."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), "value")
    headers = staged(lines.groupBy("file").agg(F.min_by("value", "place").alias("header")), "headers")
    number = headers.agg(F.count_distinct("header")).first()[0]
    if number < 2:
        return [path] * number
    by_header = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # Spark gives names of files as addresses, and wants them as paths.
    return [[unquote(file) for file in row["files"]] for row in by_header.orderBy("header").collect()]


def _lines(spark: SparkSession, path: str, tag_separator: str) -> DataFrame:
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    tables = [_named(read.csv(files)) for files in _layouts(spark, path)]
    if not tables:
        none = spark.createDataFrame([], ", ".join(f"`{_NAME.get(c, c)}` string" for c in MASTER_CSV_COLUMNS))
        tables = [none.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_line"))]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    df = normalize.legacy_columns(df)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in _TEXT})
    df = normalize.parse_status(df)
    df = normalize.parse_locale(df)
    df = normalize.parse_remoteness(df)
    df = normalize.parse_dates(df)
    df = normalize.split_tags(df, sep=tag_separator)
    return df.select(*POSTING_COLUMNS, "locale_reason", "remoteness_reason", "_file", "_line")


def _named(raw: DataFrame) -> DataFrame:
    columns = raw.columns
    # One file is one task here, so a line number within its file orders the lines.
    df = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return df.select(
        *[F.replace(F.col(c), F.lit("�"), F.lit("")).alias(_NAME.get(c, c)) for c in columns], "_file", "_line"
    )


def master_rows(postings: DataFrame) -> DataFrame:
    """The 14 columns of the file, as text, in the order of the file."""
    by_name = {
        **{c: F.col(_NAME.get(c, c)) for c in MASTER_CSV_COLUMNS},
        "date": F.date_format("post_date", "yyyy-MM-dd"),
        "tags": F.array_join("tags", "\n"),
    }
    return postings.select(*[by_name[c].alias(c) for c in MASTER_CSV_COLUMNS])


def write_master(postings: DataFrame, path: str) -> None:
    """Write a folder of part files, each with the header, so that any of them opens on its own."""
    (
        master_rows(postings)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
