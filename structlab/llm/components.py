"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlab.llm.common import Scratch, bounded

#: Most nodes whose minimum is broadcast to the edges.
NODE_BOUND = 1_000_000


def is_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that one has none: then components are done."""
    roots = edges.select("v").distinct().select(F.col("v").alias("u"))
    if not edges.join(bounded(roots, NODE_BOUND), "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").count().filter("count > 1").isEmpty()


def connected_components(edges: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round points neighbours at the smallest node near them; the rounds
    needed grow with the logarithm of a component's size.  Minima are
    aggregates that combine before the shuffle, and reach the edges from a
    written table by a broadcast of checked size or by a join that adaptive
    execution splits at hub nodes.  No links come to the driver.
    """
    work = work or Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    current = work.save(pairs, "edges0")
    for k in range(1, 60):
        if is_stars(current):
            break
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = work.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"large{k}")
        large = both.join(bounded(low, NODE_BOUND), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = work.save(large.filter("u <> v").distinct(), f"mid{k}")
        low2 = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"small{k}")
        small = large.join(bounded(low2, NODE_BOUND), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        current = work.save(small.filter("u <> v").distinct(), f"edges{k}")
        work.drop(f"edges{k - 1}", f"large{k}", f"mid{k}", f"small{k}")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
