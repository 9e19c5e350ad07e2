"""Connected components of a graph given as an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import checkpoint_folder, checkpointed, removed, written


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``; longs without nulls).

    Contraction: nodes get a fresh random order each round; each node takes the first one
    among itself and its neighbours as its parent, edges are rewritten to parents, loops and
    repeats go, until no edge is left. In a fresh order about half of the nodes of any graph
    are nobody's parent, chains too, so rounds grow with the logarithm of the size. Nothing
    is gathered by node, so hubs do not matter. The root is some node of the component.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    spark = edges.sparkSession
    path = f"{checkpoint_folder(spark)}/edges-{uuid.uuid4().hex}"
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{path}-0")
    roots, number = None, 0
    while not edges.isEmpty():
        number += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(number), F.col(c)).alias("by"), F.col(c).alias("node"))  # noqa: B023, E731
        firsts = both(edges).groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        parents = checkpointed(firsts.select("node", F.least("first", order("node"))["node"].alias("parent")))
        if roots is None:
            roots = parents.withColumnRenamed("parent", "root")
        else:
            step = parents.withColumnRenamed("node", "root")
            roots = checkpointed(roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root")))
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{path}-{number}")
        removed(spark, f"{path}-{number - 1}")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
