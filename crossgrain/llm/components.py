"""Connected components of a link table that no machine holds, by alternating large and small stars.

Each half step takes a node's smallest neighbour (an aggregation with partial minima) and links its
other neighbours to that. Smallest neighbours and links are written to the shared folder after each
half step: lineage stays short, and the joins read plain tables, so that Spark splits a hub's rows
among tasks. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossgrain.sources.scratch import materialize


def _star(links: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), the smallest of b and a itself for each a), both written."""
    links = materialize(links, f"{label}-links")
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-least")
    return links, least


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b), two columns of one ordered type; root: the smallest node of its component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    while True:
        both, least = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "large")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down, least = _star(large, "small")
        met = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(met.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        if edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi").isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
