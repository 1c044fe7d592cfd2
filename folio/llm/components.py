"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(a, b) long links -> (node, label): label is the smallest node reachable; only nodes that have a link appear.

    Each round every node takes the smallest label among its neighbours', then its label's label (pointer jumping), so a
    chain of n nodes needs about log n rounds. A node of very many links is combined before the shuffle by min(), and
    the joins have one row a node on one side, so that adaptive execution can split the other. Nulls and loops are left out;
    repeated links and both directions of one link count once.
    """
    ab = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both = scratch.table(ab.union(ab.select("b", "a")).distinct(), "links")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        new = scratch.table(low.join(up, low.low == up["at"], "left").select("node", F.least("low", F.coalesce("up", "low")).alias("label"), (F.least("low", F.coalesce("up", "low")) < F.col("label")).alias("moved")), "labels")
        scratch.drop(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
