"""Connected components of a link table, in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every linked node, the root being its class's smallest node.

    Rounds of hooking and jumping: each node hooks onto its smallest neighbour if that is smaller,
    the trees this makes are flattened by pointer jumping, and the links are carried over to
    the trees' roots until none is left between two of them.  A round at least halves the
    classes' open roots in practice, and jumping takes the logarithm of a tree's depth.
    """
    open_links = written(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    known = None
    while open_links.limit(1).count():
        both = open_links.union(open_links.select("b", "a"))
        parents = flattened(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        if known is None:
            known = parents
        else:
            p = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = written(known.join(p, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = open_links.join(a, "a").join(b, "b").filter("ra != rb")
        open_links = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return known if known is not None else open_links.selectExpr("a AS node", "b AS root")


def flattened(hooks: DataFrame) -> DataFrame:
    """Every node with the root of its tree; a node whose neighbours are all larger is a root."""
    tree = written(hooks.select("node", F.least("node", "root").alias("root")))
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(tree.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        moved = jumped.filter("moved").limit(1).count()
        tree = jumped.select("node", "root")
        if not moved:
            return tree
