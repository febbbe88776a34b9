"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_RUN: ContextVar[str | None] = ContextVar("run", default=None)
# Else shuffle files stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or else its warehouse, which all executors share too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = _RUN.get() or f"{shared_dir(spark)}/roleledger"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Cuts the lineage, survives lost executors, and lets later readers fetch only the columns they use.
    """
    return _written(df, fresh_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    with unshuffled(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def unshuffled(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a write or an action go when it ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def settled(spark: SparkSession, name: str, job: Callable[[], DataFrame]) -> DataFrame:
    """What ``job`` returns, staged; what was staged on the way there goes."""
    path = fresh_path(spark, name)
    with cleared(spark), unshuffled(spark):
        return _written(job(), path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[str]:
    """Within it, tables are staged in one folder, which goes at the end, also after an error.

    What is still wanted then has to be written elsewhere before: tables made from staged ones are lazy.
    """
    folder = fresh_path(spark, "run")
    before = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
