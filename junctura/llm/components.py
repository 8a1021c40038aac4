"""Connected components of a graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import stored


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, root) where ``root`` may have a root itself: pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        jumped = parents.join(up, F.col("root") == F.col("_node"), "left")
        parents = stored(
            jumped.select("node", F.coalesce("_root", "root").alias("root"), (F.coalesce("_root", "root") != F.col("root")).alias("moved")), "jump"
        )
        if not parents.where("moved").limit(1).count():
            return parents.select("node", "root")
        parents = parents.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): ``root`` is the least node of its component.

    Each round points every node to its least neighbour if that is smaller, follows the pointers
    to their ends, and goes on with the edges between different ends.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    roots = nodes.withColumn("root", F.col("node"))
    while edges.limit(1).count():
        pointers = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        ends = _rooted(stored(pointers, "pointers"))
        end = lambda name: ends.select(F.col("node").alias(f"_{name}"), F.col("root").alias(f"_{name}_end"))
        moved = edges.join(end("a"), F.col("a") == F.col("_a"), "left").join(end("b"), F.col("b") == F.col("_b"), "left")
        moved = moved.select(F.coalesce("_a_end", "a").alias("a"), F.coalesce("_b_end", "b").alias("b")).where("a <> b")
        edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        roots = stored(roots.join(end("r"), F.col("root") == F.col("_r"), "left").select("node", F.coalesce("_r_end", "root").alias("root")), "roots")
    return roots
