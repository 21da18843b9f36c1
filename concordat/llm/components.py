"""Connected components of a large graph by alternating large-star and small-star steps, each a few DataFrame joins.

Every step's edges are written to the shared folder, so lineage stays short and a lost executor repeats one step at most.
A hub's edges are pre-aggregated to its smallest neighbour and joined back, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that is reachable. Nulls and loops are ignored.

    most_steps is a guard against endless work, not a cut: it raises when the steps haven't settled by then.
    """
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now, mark = written(ordered, "edges"), None
    for _ in range(most_steps):
        now = written(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
        mark = seen
    raise RuntimeError("the components didn't settle")
