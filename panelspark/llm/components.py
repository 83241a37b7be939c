"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node that edges (a, b) of longs reach; nodes without an edge to another are left out.

    In each round every node points to its smallest neighbour, if that is smaller, and the graph is contracted to where
    the pointers end; at least half of the nodes left go, as only local minima stay. A component's smallest node always points to itself, so it is what is left in the end. Rounds grow as the
    logarithm of the number of nodes; each is cut, so that a lost executor costs no earlier round.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    labels = None
    while labels is None or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "node"))
        moved = True
        while moved:  # to the end of the pointers, twice as far each time
            twice = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = cut(up.join(twice, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")))
            up, moved = jumped.select("node", "up"), not jumped.where("moved").isEmpty()
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            labels = labels.join(up.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = cut(labels)
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        left = cut(left.join(a, "a").join(b, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b").distinct())
    return labels
