"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyship.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of ``links`` (columns a and b, both long).

    Every round sends each node to its smallest neighbour and contracts the links to
    distinct pairs of what is left, until no link remains. A hub's links become few
    as soon as its neighbours have been contracted.
    """
    links = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        parents = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("up")), "parents")
        one = links.join(parents.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        two = one.join(parents.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        links = stored(two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if labels is None:
            labels = parents.select("node", F.col("up").alias("label"))
        else:
            moved = parents.select(F.col("node").alias("label"), "up")
            labels = stored(labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
