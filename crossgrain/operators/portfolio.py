"""Long-short books, costs, tranche strategies and backtest overfitting."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions.cross_section import average_rank
from crossgrain.functions.inference import newey_west

EULER = 0.5772156649015329


def longshort_weights(panel: DataFrame, q: float = 0.2) -> DataFrame:
    """`panel` (d, pos, asset, sig, fwd) and w: 1 / members on the long leg, minus that on the short; k = round half even of n q, 1 at least."""
    w = W.partitionBy("d")
    df = panel.withColumns({"r": average_rank("sig", "d"), "n": F.count("sig").over(w)})
    k = F.greatest(F.bround(F.col("n") * q, 0).cast("int"), F.lit(1))
    df = df.withColumns({"long": (F.col("r") > F.col("n") - k).cast("int"), "short": (F.col("r") <= k).cast("int")})
    leg = lambda c: F.try_divide(F.col(c), F.sum(c).over(w))
    return df.withColumn("w", F.coalesce(leg("long"), F.lit(0.0)) - F.coalesce(leg("short"), F.lit(0.0))).drop("r", "n", "long", "short")


def longshort_book(panel: DataFrame, q: float = 0.2) -> DataFrame:
    """d, gross (missing labels as 0) and turnover, the sum of |change of w| over both legs; the first date's is that from nothing."""
    df = longshort_weights(panel, q)
    before = F.coalesce(F.lag("w").over(W.partitionBy("asset").orderBy("pos")), F.lit(0.0))
    df = df.withColumn("trade", F.abs(F.col("w") - before))
    return df.groupBy("d").agg(F.sum(F.col("w") * F.coalesce("fwd", F.lit(0.0))).alias("gross"), F.sum("trade").alias("turnover"))


def cost_summary(book: DataFrame, costs: tuple[float, ...] = (1.0, 5.0, 10.0), periods_per_year: int = 252) -> DataFrame:
    """cost_bps and, over all but the first date: gross_mean_bps, turnover, breakeven_bps, sharpe_gross, net_mean_bps, sharpe_net."""
    df = book.withColumn("rn", F.row_number().over(W.orderBy("d"))).where("rn > 1")
    df = df.select("gross", "turnover", F.explode(F.array(*map(F.lit, costs))).alias("cost_bps")).withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 1e4)
    year = math.sqrt(periods_per_year)
    sharpe = lambda c: F.try_divide(F.avg(c), F.stddev_samp(c)) * year
    return df.groupBy("cost_bps").agg(
        (F.avg("gross") * 1e4).alias("gross_mean_bps"), F.avg("turnover").alias("turnover"), (F.try_divide(F.avg("gross"), F.avg("turnover")) * 1e4).alias("breakeven_bps"),
        sharpe("gross").alias("sharpe_gross"), (F.avg("net") * 1e4).alias("net_mean_bps"), sharpe("net").alias("sharpe_net"),
    )


def rank_turnover(panel: DataFrame, value: str = "sig") -> DataFrame:
    """d, turnover: mean over ranked assets of |change of average rank| over their number."""
    df = panel.withColumns({"r": average_rank(value, "d"), "n": F.count(value).over(W.partitionBy("d"))})
    df = df.withColumn("move", F.abs(F.col("r") - F.lag("r").over(W.partitionBy("asset").orderBy("pos"))))
    return df.groupBy("d").agg(F.try_divide(F.avg("move"), F.max("n")).alias("turnover"))


def tranche_books(panel: DataFrame, lookback: int, horizon: int, q: float = 0.2, warmup: int = 0, sign: int = -1) -> DataFrame:
    """d, pos, formed, r: long less short of each tranche; one formed at t is held over t + 1 .. t + horizon.

    k counts all assets; a formation date needs 2 k signals; a leg with a missing return has none that day.
    """
    w = W.partitionBy("asset").orderBy("pos")
    df = panel.withColumn("sig", sign * (F.try_divide(F.col("px"), F.lag("px", lookback).over(w)) - 1))
    day = W.partitionBy("d")
    df = df.withColumns({"n_all": F.count("*").over(day), "n_sig": F.count("sig").over(day)})
    k = F.greatest(F.bround(F.col("n_all") * q, 0).cast("int"), F.lit(1))
    formed = df.where((F.col("pos") >= max(warmup, lookback)) & F.col("sig").isNotNull()).withColumn("k", k).where(F.col("n_sig") >= 2 * F.col("k"))
    place = F.row_number().over(day.orderBy("sig", "asset"))
    formed = formed.withColumn("place", place).withColumn("leg", F.when(F.col("place") <= F.col("k"), -1).when(F.col("place") > F.col("n_sig") - F.col("k"), 1)).where("leg IS NOT NULL")
    live = formed.select(F.col("pos").alias("formed"), "asset", "leg", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + horizon)).alias("pos"))
    held = live.join(panel.select("d", "pos", "asset", "ret"), ["pos", "asset"])
    legs = held.groupBy("d", "pos", "formed", "leg").agg(F.when(F.count("ret") == F.count("*"), F.avg("ret")).alias("r"))
    books = legs.groupBy("d", "pos", "formed").agg((F.sum(F.when(F.col("leg") == 1, F.col("r"))) - F.sum(F.when(F.col("leg") == -1, F.col("r")))).alias("r"))
    return books.where("r IS NOT NULL")


def tranche_returns(panel: DataFrame, lookback: int, horizon: int, q: float = 0.2, warmup: int = 0, sign: int = -1) -> DataFrame:
    """d, pos, r: the mean over live tranches."""
    return tranche_books(panel, lookback, horizon, q, warmup, sign).groupBy("d", "pos").agg(F.avg("r").alias("r"))


def aligned(series: DataFrame, n_configs: int) -> DataFrame:
    """Rows of `series` (config, d, r) at the dates that all configs have, numbered from 0 in each."""
    present = series.where("r IS NOT NULL")
    full = present.groupBy("d").agg(F.count_distinct("config").alias("n")).where(F.col("n") == n_configs).select("d")
    return present.join(full, "d").select("config", "d", "r", (F.row_number().over(W.partitionBy("config").orderBy("d")) - 1).alias("t"))


def cscv(matrix: DataFrame, n_days: int, n_configs: int, n_blocks: int = 16, embargo: int = 4) -> DataFrame:
    """mask, best, rank: for each choice of half of the blocks, the config best in it and its rank among all in the others.

    `matrix`: config, t, r. Blocks are cut at whole numbers of linspace, with `embargo` rows off the end of all
    but the last. Blocks' counts, sums and sums of squares serve every split; splits are the numbers below
    2^blocks with half of their bits set.
    """
    if n_blocks % 2 or n_days < 10 * n_blocks:
        raise ValueError("needs an even number of blocks and ten days a block")
    edges = [int(n_days * b / n_blocks) for b in range(n_blocks + 1)]
    block = F.lit(None).cast("int")
    for b in range(n_blocks):
        end = edges[b + 1] - (embargo if b < n_blocks - 1 else 0)
        block = F.when((F.col("t") >= edges[b]) & (F.col("t") < end), b).otherwise(block)
    sums = matrix.withColumn("block", block).where("block IS NOT NULL").groupBy("config", "block").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("ss"))
    masks = matrix.sparkSession.range(1 << n_blocks).where(F.bit_count("id") == n_blocks // 2).select(F.col("id").alias("mask"))
    # each block row meets every mask: configs * blocks small rows, broadcast
    split = masks.join(F.broadcast(sums)).withColumn("inside", F.expr("(shiftright(mask, block) & 1) = 1"))
    total = lambda c, inside: F.sum(F.when(F.col("inside") == inside, F.col(c)))

    def ratio(inside):
        n, s, ss = (total(c, inside) for c in ("n", "s", "ss"))
        mean = s / n
        return mean / F.sqrt(F.greatest(ss / n - mean * mean, F.lit(1e-18)))

    scored = split.groupBy("mask", "config").agg(ratio(True).alias("is_sr"), ratio(False).alias("oos_sr"))
    best = scored.groupBy("mask").agg(F.max_by(F.struct("config", "oos_sr"), F.struct("is_sr", -F.col("config"))).alias("b"))
    joined = scored.join(best, "mask")
    return joined.groupBy("mask").agg(F.max("b.config").alias("best"), F.sum((F.col("oos_sr") <= F.col("b.oos_sr")).cast("int")).alias("rank"))


def pbo(splits: DataFrame, n_configs: int) -> DataFrame:
    """pbo and n_splits: the share of splits whose best config ranks under the median outside."""
    return splits.agg(F.avg((F.col("rank") < (n_configs + 1) / 2).cast("double")).alias("pbo"), F.count("*").alias("n_splits"))


def moments(series: DataFrame, *by: str) -> DataFrame:
    """by, n, sharpe, skew, kurt (raw, 3 for a normal) of r; population moments, the Sharpe ratio with the sample deviation."""
    sr = F.try_divide(F.avg("r"), F.stddev_samp("r"))
    return series.where("r IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), sr.alias("sharpe"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt"))


def probabilistic_sharpe(sr: float, n: float, skew: float, kurt: float, benchmark: float = 0.0, t_eff: float | None = None) -> float | None:
    """P(true Sharpe > benchmark); None under 10 values. `t_eff` stands for n where values are correlated."""
    if n < 10 or sr is None:
        return None
    spread = max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    return NormalDist().cdf((sr - benchmark) * math.sqrt((t_eff or n) - 1) / math.sqrt(spread))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """The expected best Sharpe ratio of `n_trials` without skill."""
    if n_trials < 2:
        raise ValueError("needs two trials")
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * z(1 - 1 / n_trials) + EULER * z(1 - 1 / (n_trials * math.e)))


def deflated_sharpe(sr: float, n: float, skew: float, kurt: float, n_trials: int, variance: float, t_eff: float | None = None) -> float | None:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(n_trials, variance), t_eff)


def effective_length(n: int, se_iid: float, se_hac: float) -> float:
    """Values that a correlated series is worth."""
    return n * (se_iid / se_hac) ** 2


def series_significance(series: DataFrame, order: str, by: str) -> DataFrame:
    """by, mean_ic, n, t_eff and ic_psr of `series` (by, order, x): the probabilistic Sharpe ratio against 0 with t_eff for n, finished on the driver from a row a series."""
    hac, iid = newey_west(series, order, by), newey_west(series, order, by, lag=0).select(by, F.col("se").alias("se_iid"))
    rows = hac.join(iid, by).join(moments(series.select(by, F.col("x").alias("r")), by).drop("n"), by).collect()
    out = []
    for r in rows:
        t_eff = effective_length(r["n"], r["se_iid"], r["se"]) if r["se"] else float(r["n"])
        out.append((r[by], r["mean"], r["n"], t_eff, probabilistic_sharpe(r["sharpe"], r["n"], r["skew"], r["kurt"], t_eff=t_eff)))
    return series.sparkSession.createDataFrame(out, f"{by} {series.schema[by].dataType.simpleString()}, mean_ic double, n long, t_eff double, ic_psr double")
