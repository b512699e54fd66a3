"""Connected components of an edge table, by rounds of joins: labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``edges`` (a, b) reaches.

    Borůvka's rounds: every node picks its smallest neighbour. With edges in the order of their smaller and then their
    larger end, that is each node's first edge, so picks form trees whose only cycle is one pair of nodes that pick each
    other; the smaller of them is the tree's smallest node. Trees are contracted to it by doubling pointers, and the edges
    between trees are left for the next round. Whatever the ids, a round leaves at most half of a component's nodes, so n
    nodes need at most log2(n) rounds of log2(n) joins; rounds go on until no edge is left. A node with very many
    neighbours costs one row an edge, split like any skewed join. Null ends and loops are left out; no edges give no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    left = C.saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        picks = C.saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")))
        roots = picks.groupBy(F.least("node", "label").alias("node"), F.greatest("node", "label").alias("other")).agg(F.count(F.lit(1)).alias("n"))
        roots = roots.where("n = 2").select("node", F.lit(True).alias("root"))
        trees = C.saved(picks.join(roots, "node", "left").select("node", F.when(F.col("root"), F.col("node")).otherwise(F.col("label")).alias("label")))
        moved = True
        while moved:
            up = trees.select(F.col("node").alias("label"), F.col("label").alias("next"))
            new = C.saved(trees.join(up, "label").select("node", F.col("label").alias("was"), F.col("next").alias("label")))
            moved = not new.where("was <> label").isEmpty()
            trees = new.select("node", "label")
        a, b = (trees.select(F.col("node").alias(end), F.col("label").alias(f"{end}2")) for end in ("a", "b"))
        ends = left.join(a, "a").join(b, "b").where("a2 <> b2")
        left = C.saved(ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if labels is None:
            labels = trees
        else:
            up = trees.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = C.saved(labels.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    return labels
