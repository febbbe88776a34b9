"""Keyed tables that one run leaves for the next, as a base and the changes since.

A run writes the rows that it changed, never the table, and a small commit row last. Readers follow the
commits, so a run that dies half-way changes nothing, and a run that is repeated replaces its own folders
only. Reading merges: keys with changes take their newest one, and the others come from the base, whose
rows are not shuffled while the changed keys are few enough for a broadcast. When the changes have grown to
a share of the base, the run that made them writes a new base, so that all the writing together stays in
proportion to the changes. Folders that no kept commit refers to are removed after a commit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

# A new base is written when the rows of the changes reach this share of the base.
COMPACT_SHARE = 0.25
# Commits that stay readable, besides the newest.
KEPT_RUNS = 2

# Of each table: the run that wrote its base, the runs that changed it since, and their rows.
_LAYOUT = "map<string,struct<base:bigint,base_rows:bigint,changes:array<bigint>,changed_rows:bigint>>"


class RunState:
    """``key`` names the column that identifies a row of every table; rows without one are a key as well."""

    def __init__(self, spark: SparkSession, root: str, key: str = "key_id") -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def runs(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"run_id bigint, tables {_LAYOUT}").parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def latest_run(self, before: int | None = None) -> int | None:
        runs = self.runs()
        if runs is None:
            return None
        if before is not None:
            runs = runs.where(F.col("run_id") < before)
        return runs.agg(F.max("run_id")).first()[0]

    def is_committed(self, run_id: int) -> bool:
        runs = self.runs()
        return runs is not None and not runs.where(F.col("run_id") == run_id).isEmpty()

    def layout(self, run_id: int | None) -> dict:
        """Where the tables are, as that run left them."""
        if run_id is None:
            return {}
        row = self.runs().where(F.col("run_id") == run_id).first()
        return {name: held.asDict() for name, held in row["tables"].items()} if row else {}

    def _path(self, table: str, kind: str, run_id: int) -> str:
        return f"{self.root}/{table}/{kind}/run_id={run_id}"

    def read(self, table: str, run_id: int | None) -> DataFrame | None:
        """The table as that run left it; None before the first run."""
        held = self.layout(run_id).get(table)
        return None if held is None else self._merged(table, held)

    def _merged(self, table: str, held: dict) -> DataFrame:
        base = self.spark.read.parquet(self._path(table, "base", held["base"]))
        if not held["changes"]:
            return base
        each = [
            self.spark.read.parquet(self._path(table, "changes", run)).withColumn("_run", F.lit(run)) for run in held["changes"]
        ]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
        fields = [c for c in rows.columns if c != "_run"]
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*fields), "_run").alias("_row"))
        keys = newest.select(F.col(self.key).alias("_key"))
        kept = base.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        return kept.unionByName(newest.select("_row.*").where("not _gone").drop("_gone"), allowMissingColumns=True)

    def commit(self, run_id: int, changes: dict[str, DataFrame]) -> None:
        """Write what a run changed: whole new rows of the tables, or with ``_gone`` the keys that left them.

        A table has at most one changed row a key and run. The first run of a table writes its base.
        """
        layout = self.layout(self.latest_run(before=run_id))
        for name, df in changes.items():
            held = layout.get(name)
            df = df if "_gone" in df.columns else df.withColumn("_gone", F.lit(False))
            if held is None:
                rows = self._written(df.where("not _gone").drop("_gone"), name, "base", run_id)
                layout[name] = {"base": run_id, "base_rows": rows, "changes": [], "changed_rows": 0}
                continue
            rows = self._written(df, name, "changes", run_id)
            if rows:
                held = held | {"changes": [*held["changes"], run_id], "changed_rows": held["changed_rows"] + rows}
            if held["changed_rows"] > COMPACT_SHARE * held["base_rows"]:
                rows = self._written(self._merged(name, held), name, "base", run_id)
                held = {"base": run_id, "base_rows": rows, "changes": [], "changed_rows": 0}
            layout[name] = held
        marker = self.spark.createDataFrame([(run_id, layout)], f"run_id bigint, tables {_LAYOUT}")
        marker.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        self._prune()

    def _written(self, df: DataFrame, table: str, kind: str, run_id: int) -> int:
        path = self._path(table, kind, run_id)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path).count()

    def _prune(self) -> None:
        """Remove the folders that none of the last commits refers to. The commits themselves stay."""
        last = self.runs().orderBy(F.desc("run_id")).limit(KEPT_RUNS + 1).collect()
        used = set()
        for row in last:
            for name, held in row["tables"].items():
                used.add(self._path(name, "base", held["base"]))
                used.update(self._path(name, "changes", run) for run in held["changes"])
        names = {name for row in last for name in row["tables"]}
        # Runs newer than the last commit, if there are any, are not committed yet and not ours to remove.
        newest = max(row["run_id"] for row in last)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in (f"{self.root}/{name}/{kind}" for name in names for kind in ("base", "changes")):
            path = hadoop(folder)
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(path) if files.exists(path) else ():
                name = status.getPath().getName()
                if f"{folder}/{name}" not in used and int(name.removeprefix("run_id=")) <= newest:
                    files.delete(status.getPath(), True)
