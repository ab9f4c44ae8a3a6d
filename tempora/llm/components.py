"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (its least node) for every node of the links (columns a, b; self-links allowed, nulls not).

    Each round a node takes the least label among its neighbours' and then its label's label, so long chains halve. A hub's
    links are combined before they are shuffled, and its join is one that Spark can split. Labels are written every round.
    """
    ends = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    for _ in range(max_rounds):
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        near = ends.join(of, "b").groupBy("a").agg(F.min("other").alias("near"))
        nearer = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        # a link to the least neighbour label also tells the old label's node about it
        hooks = nearer.groupBy("label").agg(F.min("new").alias("hook"))
        hooked = nearer.join(hooks, "label").select("node", "label", F.least("new", "hook").alias("new"))
        jump = hooked.select(F.col("node").alias("new"), F.col("new").alias("jumped"))
        following = written(hooked.join(jump, "new", "left").select("node", F.col("label").alias("was"), F.least("new", F.coalesce("jumped", "new")).alias("label")), "labels")
        labels = following.select("node", "label")
        if following.filter("was <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError("components did not settle")
