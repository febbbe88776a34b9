"""Connected components of a table of links: nodes hook to their smallest neighbour, and what hangs together becomes one node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roleledger.llm.tables import bounded, staged


def _roots(hooks: DataFrame) -> DataFrame:
    """``node``, ``root`` of the staged ``hooks`` (each node's ``root`` is smaller): the last root on each node's way, by doubling."""
    while True:
        further = bounded(hooks.select(F.col("node").alias("root"), F.col("root").alias("next")))
        longer = hooks.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), "next")
        longer = staged(longer, "roots")
        if longer.where("next is not null").isEmpty():
            return hooks
        hooks = longer.select("node", "root")


def _moved(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of what is in ``column``, if it has one."""
    named = bounded(roots.select(F.col("node").alias(column), F.col("root").alias("to")))
    others = [c for c in rows.columns if c != column]
    return rows.join(named, column, "left").select(F.coalesce("to", column).alias(column), *others)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node reachable, for every node of the links ``a``, ``b`` but these smallest.

    Null links and links to oneself are ignored; repeated links count once. In each round every node with a
    smaller neighbour hooks to the smallest, and links are moved to the roots; those left between different roots
    go on. Each round writes its tables, so that a lost executor costs no earlier round. While the nodes are few
    enough for a broadcast, only the search for the smallest neighbour is shuffled.
    """
    now, found = staged(links.where("a != b").select("a", "b"), "links"), None
    while found is None or not now.isEmpty():
        hooks = now.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("root"))
        roots = _roots(staged(hooks, "hooks"))
        now = staged(_moved(_moved(now, "a", roots), "b", roots).where("a != b"), "links")
        # A node hooks once: from then on its root stands for it.
        found = roots if found is None else staged(_moved(found, "root", roots).unionByName(roots), "found")
    return found.select("node", F.col("root").alias("component"))
