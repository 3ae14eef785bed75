"""Cross-sectional functions: within a group of rows, by default one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """The rank of `value` within `by`, from 1, ties averaged; NULL is not ranked."""
    v = F.col(value)
    present = v.isNotNull()
    place = F.rank().over(W.partitionBy(*by, present).orderBy(v))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, present, v))
    return F.when(present, place + (ties - 1) / 2.0)


def percent_bucket(value: str, buckets: int, *by: str) -> Column:
    """The bucket g, from 0, with average rank / count in (g / n, (g + 1) / n]."""
    share = average_rank(value, *by) / F.count(value).over(W.partitionBy(*by))
    return F.when(F.col(value).isNotNull(), F.greatest(F.ceil(F.round(share * buckets, 9)) - 1, F.lit(0)).cast("int"))


def median_imputed(value: str, *by: str) -> Column:
    """NULL replaced by the median within `by`; 0 where all are NULL."""
    return F.coalesce(F.col(value), F.median(value).over(W.partitionBy(*by)), F.lit(0.0))


def zscored(df: DataFrame, values: list[str], *by: str) -> DataFrame:
    """`df` with each of `values` median-imputed and standardised (population deviation) within `by`; 0 where it is constant."""
    w = W.partitionBy(*by)
    df = df.withColumns({v: median_imputed(v, *by) for v in values})
    return df.withColumns({v: F.when(F.stddev_pop(v).over(w) > 1e-15, F.try_divide(F.col(v) - F.avg(v).over(w), F.stddev_pop(v).over(w))).otherwise(F.lit(0.0)) for v in values})


def rank_normalised(df: DataFrame, values: list[str], *by: str) -> DataFrame:
    """`df` with each of `values` median-imputed, ranked with ties averaged, and standardised within `by`."""
    df = df.withColumns({v: median_imputed(v, *by) for v in values})
    return zscored(df.withColumns({v: average_rank(v, *by) for v in values}), values, *by)


def rank_ic(df: DataFrame, pred: str, target: str, *by: str) -> DataFrame:
    """by, ic and n: Spearman correlation of rows where both are present; NULL under 3 rows or where a side is constant."""
    both = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(pred).alias("p"), F.col(target).alias("t"))
    ranked = both.select(*by, average_rank("p", *by).alias("a"), average_rank("t", *by).alias("b"))
    corr = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy(*by).agg(F.when(F.count("*") >= 3, corr).alias("ic"), F.count("*").alias("n"))


def long_short_spread(df: DataFrame, pred: str, target: str, q: float, *by: str) -> DataFrame:
    """by, spread: mean target of the top less that of the bottom quantile of pred; NULL under 5 rows or where quantiles meet."""
    both = df.where(F.col(pred).isNotNull() & F.col(target).isNotNull()).select(*by, F.col(pred).alias("p"), F.col(target).alias("t"))
    w = W.partitionBy(*by)
    cut = both.withColumns({"hi": F.percentile("p", F.lit(1 - q)).over(w), "lo": F.percentile("p", F.lit(q)).over(w)})
    means = F.avg(F.when(F.col("p") >= F.col("hi"), F.col("t"))) - F.avg(F.when(F.col("p") <= F.col("lo"), F.col("t")))
    return cut.groupBy(*by).agg(F.when((F.count("*") >= 5) & (F.max("hi") > F.max("lo")), means).alias("spread"))


#: DuckDB: the average rank of {v} within {by}, over rows where it is present.
AVG_RANK_SQL = "(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)"


def rank_ic_sql(source: str, pred: str, target: str, by: str = "d") -> str:
    """DuckDB tables `ranked_ic` and `ic_series` ({by}, ic, n) of `source`."""
    a, b = AVG_RANK_SQL.format(by=by, v=pred), AVG_RANK_SQL.format(by=by, v=target)
    return f"""ranked_ic AS (SELECT {by}, {a} AS a, {b} AS b FROM {source} WHERE {pred} IS NOT NULL AND {target} IS NOT NULL),
ic_series AS (SELECT {by}, CASE WHEN count(*) >= 3 THEN covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) END AS ic, count(*) AS n FROM ranked_ic GROUP BY {by})"""
