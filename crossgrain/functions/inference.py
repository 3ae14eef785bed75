"""Statistics of series: one row each for a key and place, `x` the value."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def two_sided_p(t: float | None) -> float | None:
    """2 * (1 - Phi(|t|))."""
    return None if t is None or math.isnan(t) else math.erfc(abs(t) / math.sqrt(2))


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def two_sided_p_column(t: Column) -> Column:
    """`two_sided_p` over Arrow batches; for columns of results, a row a series."""
    def p(x: pd.Series) -> pd.Series:
        return x.map(two_sided_p, na_action="ignore").astype(float)

    return F.pandas_udf(p, "double")(t)


def hac_lag(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9)), within [0, n - 1]."""
    return F.greatest(F.least(F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))), n - 1), F.lit(0)).cast("int")


def numbered(series: DataFrame, order: str, *by: str) -> DataFrame:
    """by, t (from 0 in the order of `order`) and x of the rows with a value."""
    return series.where("x IS NOT NULL").select(*by, (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1).alias("t"), "x")


def newey_west(series: DataFrame, order: str, *by: str, lag: int | None = None) -> DataFrame:
    """by, n, mean, se and t with Bartlett weights; NULL under 3 values, t NULL where se is 0.

    Each value meets the L before it through an equi-join on (by, t), so the work is n * L.
    """
    w = W.partitionBy(*by)
    e = numbered(series, order, *by).withColumns({"n": F.count("*").over(w), "mean": F.avg("x").over(w)})
    e = e.select(*by, "t", "n", "mean", (F.col("x") - F.col("mean")).alias("e"), (F.lit(lag) if lag is not None else hac_lag(F.col("n"))).alias("lags"))
    asks = e.select(*by, "n", "mean", "lags", "e", "t", F.explode(F.sequence(F.lit(0), "lags")).alias("l")).withColumn("t", F.col("t") - F.col("l"))
    pairs = asks.join(e.select(*by, "t", F.col("e").alias("e0")), [*by, "t"])
    weight = F.when(F.col("l") == 0, 1.0).otherwise(2.0 * (1 - F.col("l") / (F.col("lags") + 1.0)))
    out = pairs.groupBy(*by).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), (F.sum(weight * F.col("e") * F.col("e0"))).alias("s"))
    se = F.sqrt(F.greatest(F.col("s"), F.lit(0.0))) / F.col("n")
    enough = F.col("n") >= 3
    return out.select(*by, "n", F.when(enough, F.col("mean")).alias("mean"), F.when(enough, se).alias("se"), F.when(enough, F.try_divide("mean", se)).alias("t"))


def ic_summary(series: DataFrame, order: str, *by: str) -> DataFrame:
    """by, mean_ic, sd, ir, naive_t, hac_t, n_dates."""
    hac = newey_west(series, order, *by)
    sds = series.where("x IS NOT NULL").groupBy(*by).agg(F.stddev_samp("x").alias("sd"))
    naive = F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))
    return hac.join(sds, [*by]).select(*by, F.col("mean").alias("mean_ic"), "sd", F.try_divide("mean", "sd").alias("ir"), naive.alias("naive_t"), F.col("t").alias("hac_t"), F.col("n").alias("n_dates"))


def ar1_phi(series: DataFrame, order: str, *by: str, short: float | None = 0.3) -> DataFrame:
    """by, phi: lag-1 autocorrelation within [0, 0.9]; `short` under 5 values."""
    w = W.partitionBy(*by)
    e = numbered(series, order, *by).withColumn("e", F.col("x") - F.avg("x").over(w))
    e = e.withColumn("before", F.lag("e").over(w.orderBy("t")))
    raw = F.coalesce(F.try_divide(F.sum(F.col("e") * F.col("before")), F.sum(F.col("e") * F.col("e"))), F.lit(0.0))
    return e.groupBy(*by).agg(F.when(F.count("*") < 5, F.lit(short)).otherwise(F.least(F.greatest(raw, F.lit(0.0)), F.lit(0.9))).alias("phi"))


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float, *by: str) -> DataFrame:
    """`tests` and q, fdr_sig within the families `by`; a NULL p counts as 1."""
    w = W.partitionBy(*by)
    ordered = tests.withColumn("_p", F.coalesce(p, F.lit(1.0))).withColumns({"_m": F.count("*").over(w), "_k": F.row_number().over(w.orderBy("_p"))})
    back = w.orderBy(F.desc("_p"), F.desc("_k")).rowsBetween(W.unboundedPreceding, 0)
    out = ordered.withColumn("q", F.least(F.min(F.col("_p") * F.col("_m") / F.col("_k")).over(back), F.lit(1.0)))
    last = F.max(F.when(F.col("_p") <= F.col("_k") / F.col("_m") * alpha, F.col("_k"))).over(w)
    return out.withColumn("fdr_sig", F.coalesce(F.col("_k") <= last, F.lit(False))).drop("_p", "_m", "_k")


def qlike(df: DataFrame, realized: str, forecast: str, *by: str) -> DataFrame:
    """by, qlike, n over rows where both are positive."""
    r = F.col(realized) / F.col(forecast)
    good = df.where((F.col(realized) > 0) & (F.col(forecast) > 0))
    return good.groupBy(*by).agg(F.avg(r - F.ln(r) - 1).alias("qlike"), F.count("*").alias("n"))


def newey_west_sql(source: str, by: str, order: str, x: str = "ic") -> str:
    """DuckDB table `hac` ({by}, n, mean, se, t) of `source`."""
    return f"""hac_n AS (SELECT {by}, {x} AS x, row_number() OVER (PARTITION BY {by} ORDER BY {order}) - 1 AS t, count(*) OVER (PARTITION BY {by}) AS n, avg({x}) OVER (PARTITION BY {by}) AS mean FROM {source} WHERE {x} IS NOT NULL),
hac_e AS (SELECT *, x - mean AS e, greatest(least(floor(4 * pow(n / 100.0, 2.0 / 9.0)), n - 1), 0) AS lags FROM hac_n),
hac_s AS (SELECT a.{by}, max(a.n) AS n, max(a.mean) AS mean, sum(CASE WHEN a.t = b.t THEN 1.0 ELSE 2.0 * (1 - (a.t - b.t) / (a.lags + 1.0)) END * a.e * b.e) AS s FROM hac_e a JOIN hac_e b ON a.{by} = b.{by} AND b.t BETWEEN a.t - a.lags AND a.t GROUP BY a.{by}),
hac AS (SELECT {by}, n, CASE WHEN n >= 3 THEN mean END AS mean, CASE WHEN n >= 3 THEN sqrt(greatest(s, 0)) / n END AS se, CASE WHEN n >= 3 THEN mean / nullif(sqrt(greatest(s, 0)) / n, 0) END AS t FROM hac_s)"""
