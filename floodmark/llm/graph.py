"""Connected components of a table of links, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the smallest node reachable), for every node that a link names.

    Each round every node takes the smallest label beside it and then the label of
    its label, so the rounds grow with the logarithm of the longest chain. Minima
    are taken before the shuffle; each round is written to the shared folder.
    Links with a null end are left out; no links give no rows.
    """
    one = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = stored(one.union(one.select("v", "u")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        beside = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(beside, F.col("node") == F.col("u")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stored(step, "labels")
        up = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = stored(step.join(up, F.col("label") == F.col("at")).select("node", "old", F.least("label", "further").alias("label")), "labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
