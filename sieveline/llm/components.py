"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import dropped, written


def _through(labels: DataFrame, of_roots: DataFrame) -> DataFrame:
    """Every node's component's component."""
    up = of_roots.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    return labels.join(up, labels["component"] == F.col("n2"), "left").select("node", F.coalesce("c2", "component").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b), written; component is the smallest node that can be reached.

    In each round every node hooks onto its smallest neighbour, paths are halved twice, and the graph is contracted, so
    that at most half of the nodes that still have links remain. Minima are combined before they are exchanged; nothing
    reaches the driver but whether links are left. Links to itself, repeated and null ones do no harm.
    """
    left = written(links.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("least", "node").alias("component"))
        hooked = written(hooked, "hooked")
        halved = written(_through(hooked, hooked), "halved")
        parents = written(_through(halved, halved), "parents")
        rounds.append(parents)
        a = parents.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        b = parents.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        rest = written(left.join(a, "a").join(b, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        dropped(left, hooked, halved)
        left = rest
        if left.isEmpty():
            break
    # A node's component is found in the last round that still knew the node it had become.
    labels = rounds[-1]
    for earlier in rounds[-2::-1]:
        labels = written(_through(earlier, labels), "labels")
    return labels
