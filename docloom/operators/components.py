"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.sources.store import forget, written


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of links (a, b) with a <> b; a component is named by its smallest node.

    Every round takes the smallest label among a node's neighbours and then the label of that label, so labels
    travel twice as far each time; the loop ends when a round changes nothing. Hot nodes are only ever join keys
    between plain shuffles, which adaptive execution splits.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    n = both.count()
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), n)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        better = written(labels.join(near, "node").select("node", F.least("component", "m").alias("to"), "component"), n)
        heads = better.select(F.col("node").alias("head"), F.col("to").alias("beyond"))
        jumped = better.join(heads, better["to"] == heads["head"]).select("node", "component", F.least("to", "beyond").alias("to"))
        moved = written(jumped, n)
        forget(better)
        if not moved.filter("to < component").take(1):
            forget(moved, both)
            return labels
        forget(labels)
        labels = written(moved.select("node", F.col("to").alias("component")), n)
        forget(moved)
