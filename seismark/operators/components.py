"""Connected components of a graph given as edges, by local union-find and then alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.session import cut_lineage

MOST_ROUNDS = 60
#: Edges left after the first pass that one task joins on its own; more are contracted over all tasks.
EDGES_OF_ONE_TASK = 200_000


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a batch replaced by a spanning forest towards the least node of each of its components."""
    for batch in batches:
        if batch.empty:
            continue
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = p
            return x

        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"a": [root(x) for x in nodes], "b": nodes}, dtype="int64")


def _whole_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for all edges of a task."""
    yield from _local_forest(iter([pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *batches])]))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    turned = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")
    return turned.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (bigint): every node that has an edge to another node, and the least node it is connected with.

    Self-loops and edges with a null end are left out; repeated and turned edges change nothing. No component is ever
    gathered in one place, unless no more than ``EDGES_OF_ONE_TASK`` edges are left in all: after each task has joined what it holds, edges are only grouped by node, and a round's edges
    are written to the checkpoint folder. Raises RuntimeError if ``MOST_ROUNDS`` do not suffice rather than give a
    partial answer.
    """
    lean = edges.select(F.least(F.col(a), F.col(b)).cast("bigint").alias("a"), F.greatest(F.col(a), F.col(b)).cast("bigint").alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("a <> b")
    current = cut_lineage(lean.mapInPandas(_local_forest, "a bigint, b bigint").distinct())

    def stars(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()

    if current.count() <= EDGES_OF_ONE_TASK:
        return stars(cut_lineage(current.coalesce(1).mapInPandas(_whole_forest, "a bigint, b bigint")))
    fingerprint = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = fingerprint(current)
    for _ in range(MOST_ROUNDS):
        current = cut_lineage(_small_star(_large_star(current)))
        now = fingerprint(current)
        if now == before:
            return stars(current)
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
