"""Connected components by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import write_shared


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for undirected ``edges(a, b)``; root is the least node.

    Each round every node takes the least label among its neighbours' and its
    own, then the label of that label; labels fall along paths twice as fast
    each time. Sums are partial before the shuffle, and every round ends in a
    written table, so a lost executor repeats one round at most.
    """
    both = write_shared(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = write_shared(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        taken = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        new = write_shared(
            taken.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), (F.least("mid", "far") < F.col("old")).alias("moved")), "labels"
        )
        labels = new.select("node", "root")
        if not new.filter("moved").head(1):
            return labels
