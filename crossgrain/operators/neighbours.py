"""Aggregates of neighbours' values: an equi-join of edges with values on (date, dst), grouped by (date, src)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _joined(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    return edges.select("as_of", "src", "dst", "weight").join(values.select("as_of", F.col("asset").alias("dst"), F.col(value).alias("v")), ["as_of", "dst"], "left")


def neighbour_mean(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """as_of, asset, nbr: the plain mean over out-neighbours; assets without an edge have no row."""
    return _joined(edges, values, value).groupBy("as_of", F.col("src").alias("asset")).agg(F.avg("v").alias("nbr"))


def weighted_neighbour_mean(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """as_of, asset, nbr: the |weight|-weighted mean over out-neighbours; NULL if one of them has no value."""
    a = F.abs("weight")
    mean = F.try_divide(F.sum(a * F.col("v")), F.sum(a))
    return _joined(edges, values, value).groupBy("as_of", F.col("src").alias("asset")).agg(F.when(F.count("v") == F.count("*"), mean).alias("nbr"))


def present_neighbour_mean(edges: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """as_of, asset, nbr: the |weight|-weighted mean over the out-neighbours that have a value; NULL if none has."""
    a = F.abs("weight")
    return _joined(edges, values, value).where("v IS NOT NULL").groupBy("as_of", F.col("src").alias("asset")).agg(F.try_divide(F.sum(a * F.col("v")), F.sum(a)).alias("nbr"))


def message_mean(edges: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """as_of, asset, agg: the mean of what src nodes send along edges to dst; 0 for a node that gets none."""
    sent = edges.join(nodes.select("as_of", F.col("asset").alias("src"), F.col(value).alias("v")), ["as_of", "src"]).groupBy("as_of", F.col("dst").alias("asset")).agg(F.avg("v").alias("m"))
    return nodes.select("as_of", "asset").join(sent, ["as_of", "asset"], "left").select("as_of", "asset", F.coalesce("m", F.lit(0.0)).alias("agg"))
