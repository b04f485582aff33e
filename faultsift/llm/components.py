"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultsift.llm.common import staged


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each neighbour (the larger ones, or the smaller ones and the node itself) to the least of them."""
    if larger:
        ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ends.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 100, stage: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node reachable.

    Each round is written to the shared folder, so that the plan stays short and a lost executor
    costs one round at most; stage writes them. No edges give no rows; loops and repeated edges do no harm.
    """
    edges = stage(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = lambda e: tuple(
        e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = stage(_star(_star(edges, True), False), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
