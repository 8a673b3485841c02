"""Connected components by label propagation with pointer jumping.

Each round, a node takes the smallest label among its own and its neighbours',
and then the label of the node that it is labelled with.  Labels are written
each round, which cuts the lineage.  Nothing is collected but one count a
round; a node with very many links is aggregated partially, and its joins are
between written tables, so they can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibspark.llm.scratch import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``edges`` (a, b): the smallest node of each component."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = materialise(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new")), "step")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("jump"))
        after = materialise(step.join(jump, "new").select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved")),
                            "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
