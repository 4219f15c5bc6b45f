"""Connected components of a link table by joins and minimum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node`` and ``component``: the least node that links reach.

    Each round takes the least label among the neighbours (a partial aggregate
    before the shuffle, so a hot node is no burden) and then the label of that
    label, so long chains halve.  Labels are checkpointed each round.  Nodes
    without a link are absent; null ends and loops are dropped; an empty
    table gives an empty table.
    """
    one = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst")
    both = materialise(one.unionByName(one.select(F.col("dst").alias("src"),
                                                  F.col("src").alias("dst"))).distinct())
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(
        F.min(F.least("src", "dst")).alias("component")))
    while True:
        near = (both.join(labels, both.src == labels.node).groupBy("dst")
                .agg(F.min("component").alias("near")))
        step = (labels.join(near, labels.node == near.dst, "left")
                .select("node", "component", F.least("component", "near").alias("next")))
        known = step.select(F.col("node").alias("k"), F.col("next").alias("jump"))
        moved = materialise(
            step.join(known, F.col("next") == F.col("k"), "left")
            .select("node", F.least("next", "jump").alias("to"), "component"))
        changed = moved.where("`to` <> component").limit(1).count()
        labels = moved.select("node", F.col("to").alias("component"))
        if not changed:
            return labels
