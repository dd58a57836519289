"""Connected components of links, by labels that shrink."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrends.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node that it reaches.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, so the number of rounds grows with the
    logarithm of the longest path, not with the size of a group. The rounds
    are stored in the shared folder; the driver only learns whether one
    changed anything. Loops and repeated links do no harm; no links give no rows.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a is not null and b is not null").distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "least").alias("label")
        )
        target = step.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = materialize(step.join(target, "label").select("node", "old", F.col("jump").alias("label")))
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
