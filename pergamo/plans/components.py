"""Connected components by rounds of minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergamo.plans.skew import attach_groups
from pergamo.session import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node that links reach.

    Distributed union-find: each round gives every node the smallest label among its neighbours, then replaces
    each label by its label's label, so paths shorten by half or more a round; it ends when nothing changes.
    Both joins are safe against hot keys: a node with very many neighbours and a label with very many nodes are
    met by a broadcast. Every round is written to the shared folder; the driver sees counts and one flag a round.
    Nulls and self-links are ignored.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    both = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    total = both.count()
    labels = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("node", "degree", F.least("node", "m").alias("component")))
    while True:
        met = attach_groups(both, labels.select(F.col("node").alias("v"), "degree", "component"), "v", "degree", total)
        near = met.groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        hooked = settle(labels.join(near, "node").select("node", "degree", F.col("component").alias("old"), F.least("component", "m").alias("label")))
        sizes = hooked.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        tops = hooked.select(F.col("node").alias("label"), F.col("label").alias("component")).join(sizes, "label")
        labels = settle(attach_groups(hooked, tops, "label", "size", total).select("node", "degree", "old", "component"))
        if labels.where("old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.drop("old")
