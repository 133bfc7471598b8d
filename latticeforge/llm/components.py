"""Connected components of a link table, as a loop of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _session


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node that links reach.

    Each round takes the least label among neighbours and then jumps to the label's own label, so
    rounds grow with the logarithm of a component's diameter.  Labels are written each round.
    """
    both = _session.stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))), "links")
    labels = _session.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        lowered = labels.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = lowered.join(up, "root", "left").select("node", "old", F.least("root", "higher").alias("root"))
        done = _session.stored(jumped, "labels")
        moved = done.where(F.col("old") != F.col("root")).limit(1).count()
        _session.drop(labels)
        labels = done.select("node", "root")
        if not moved:
            _session.drop(both)
            return labels
