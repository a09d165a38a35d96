"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import stage


def connected(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable from every node of ``links(a, b)``, itself included.

    Every node takes the smallest label among its own and its neighbours', then the label of that label,
    until nothing changes; the second step halves long chains. Minima are taken before the shuffle, so a
    node with very many links costs a few rows per task. Each round is written and read again.
    """
    both = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")
    ))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", "component", F.least("component", "near").alias("lower")
        )
        jump = labels.select(F.col("node").alias("lower"), F.col("component").alias("jumped"))
        step = lower.join(jump, "lower").select("node", "component", F.least("lower", "jumped").alias("now"))
        step = stage(step)
        labels = step.select("node", F.col("now").alias("component"))
        if step.filter("now <> component").isEmpty():
            return labels
