"""Connected components of an edge table, by rounds of joins: labels never reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import saved

C = F.col


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of ``edges`` (a, b) reaches.

    Borůvka's rounds: every node picks its smallest neighbour, so picks form trees whose only cycle is a pair that pick each
    other; the smaller of that pair is the tree's root. Trees are contracted to their roots by doubling pointers, and the
    edges between trees are the next round's. A round leaves at most half of a component's nodes, whatever the ids, and rounds
    go on until no edge is left. Null ends and loops are left out; no edges give no rows.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = saved(edges.where("a is not null and b is not null and a <> b").select(*ordered("a", "b")).distinct())
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(C("b").alias("a"), C("a").alias("b")))
        picks = saved(both.groupBy(C("a").alias("node")).agg(F.min("b").alias("label")))
        back = picks.select(C("node").alias("label"), C("label").alias("back"))
        root = (C("back") == C("node")) & (C("node") < C("label"))
        trees, moving = saved(picks.join(back, "label").select("node", F.when(root, C("node")).otherwise(C("label")).alias("label"))), True
        while moving:
            nxt = trees.select(C("node").alias("label"), C("label").alias("top"))
            step = saved(trees.join(nxt, "label").select("node", "label", "top"))
            moving = not step.where("label <> top").isEmpty()
            trees = step.select("node", C("top").alias("label"))
        a, b = (trees.select(C("node").alias(end), C("label").alias(f"{end}_root")) for end in ("a", "b"))
        left = saved(left.join(a, "a").join(b, "b").where("a_root <> b_root").select(*ordered("a_root", "b_root")).distinct())
        nxt = trees.select(C("node").alias("label"), C("label").alias("top"))
        labels = trees if labels is None else saved(labels.join(nxt, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    return labels
