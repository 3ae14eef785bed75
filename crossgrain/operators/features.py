"""Point-in-time features and forward labels of a dense panel (d, pos, asset, px, volume, ret).

Everything of an asset is one window specification, so the panel is dealt and sorted by asset once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions.cross_section import zscored

YEAR = 252
BASE_FEATURES = ["mom_1m", "mom_3m", "mom_12_1", "rev_1w", "vol_20d", "turnover", "beta", "size"]


def _asset():
    """An asset's rows in the order of the calendar."""
    return W.partitionBy("asset").orderBy("pos")


def trailing(rows: int):
    """The last `rows` calendar rows up to the current one."""
    return _asset().rowsBetween(-(rows - 1), 0)


def performance(n: int, skip: int = 0) -> Column:
    """px[-skip] / px[-n] - 1 in calendar rows; NULL where either is."""
    recent = F.lag("px", skip).over(_asset()) if skip else F.col("px")
    return F.try_divide(recent, F.lag("px", n).over(_asset())) - 1


def trailing_return(rows: int, ret: str = "ret") -> Column:
    """The compounded return of the last `rows` rows; missing ones are skipped, and none at all is 0."""
    return F.coalesce(F.product(1 + F.col(ret)).over(trailing(rows)), F.lit(1.0)) - 1


def trailing_vol(rows: int) -> Column:
    """Sample deviation of the last `rows` returns; NULL until all are there."""
    w = trailing(rows)
    return F.when(F.count("ret").over(w) == rows, F.stddev_samp("ret").over(w))


def liquidity(rows: int = 20) -> Column:
    """Mean price times volume of the last `rows` rows; NULL until all are there."""
    w, value = trailing(rows), F.col("px") * F.col("volume")
    return F.when(F.count(value).over(w) == rows, F.avg(value).over(w))


def market_return(panel: DataFrame) -> DataFrame:
    """d, mkt_ret: the equal-weight mean of the cross-section."""
    return panel.groupBy("d").agg(F.avg("ret").alias("mkt_ret"))


def base_features(panel: DataFrame, market: DataFrame | None = None, beta_rows: int = 120, month: int = 21) -> DataFrame:
    """`panel` and BASE_FEATURES; `month` scales the momentum lags for calendars other than daily."""
    market = market_return(panel) if market is None else market
    p = panel.join(F.broadcast(market), "d", "left")
    w20, wb = trailing(20), trailing(beta_rows)
    value = F.col("px") * F.col("volume")
    joint = F.when(F.col("ret").isNotNull(), F.col("mkt_ret"))
    return p.withColumns({
        "mom_1m": performance(month),
        "mom_3m": performance(3 * month),
        "mom_12_1": performance(12 * month, month),
        "rev_1w": performance(5),
        "vol_20d": F.stddev_samp("ret").over(w20) * F.sqrt(F.lit(float(YEAR))),
        "turnover": F.ln(F.nullif(F.avg(value).over(w20), F.lit(0.0))),
        "beta": F.try_divide(F.covar_samp("ret", joint).over(wb), F.var_samp("mkt_ret").over(wb)),
        "size": F.ln(F.nullif(value, F.lit(0.0))),
    })


def forward_return(h: int) -> Column:
    """px[+h] / px - 1."""
    return F.try_divide(F.lead("px", h).over(_asset()), F.col("px")) - 1


def forward_log_vol(h: int) -> Column:
    """ln(population deviation of the next `h` returns * sqrt(252)); NULL at the end of the calendar and where it is 0."""
    ahead = _asset().rowsBetween(1, h)
    sd = F.stddev_pop("ret").over(ahead) * F.sqrt(F.lit(float(YEAR)))
    # a deviation of rounding errors alone is none
    return F.when(F.lead("pos", h).over(_asset()).isNotNull() & (sd > 1e-12), F.ln(sd))


def signal(lookback: int, sign: int = 1, skip: int = 0) -> Column:
    """sign * (px[-skip] / px[-skip-lookback] - 1)."""
    return sign * performance(skip + lookback, skip)


def sampled(df: DataFrame, start: int, step: int) -> DataFrame:
    """Rows at the dates start, start + step, ..."""
    return df.where((F.col("pos") >= start) & ((F.col("pos") - start) % step == 0))


def signal_panel(panel: DataFrame, lookback: int, horizon: int, sign: int = 1, skip: int = 0, warmup: int = 0) -> DataFrame:
    """d, pos, asset, sig, fwd at non-overlapping dates."""
    start = max(warmup, lookback + skip)
    df = panel.withColumns({"sig": signal(lookback, sign, skip), "fwd": forward_return(horizon), "ahead": F.lead("pos", horizon).over(_asset())})
    return sampled(df.where("ahead IS NOT NULL"), start, horizon).select("d", "pos", "asset", "sig", "fwd")


def last_date_of(calendar: DataFrame, period: str) -> DataFrame:
    """The last date of each week or month: period, d, pos."""
    return calendar.groupBy(F.date_trunc(period, "d").cast("date").alias("period")).agg(F.max("d").alias("d"), F.max("pos").alias("pos"))


def feature_frame(panel: DataFrame, lookbacks: tuple[int, ...] = (5, 20, 60)) -> DataFrame:
    """d, pos, asset and standardised trailing returns, NULL as 0."""
    names = [f"ret_{n}" for n in lookbacks]
    df = panel.withColumns({name: trailing_return(n) for name, n in zip(names, lookbacks, strict=True)})
    return zscored(df, names, "d").select("d", "pos", "asset", *names)


def residual(y: str, x: str, *by: str) -> Column:
    """y less its regression on x within `by`, on rows where both are; y itself under 3 such rows, slope 0 for a constant x."""
    w = W.partitionBy(*by)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    yy, xx = F.when(both, F.col(y)), F.when(both, F.col(x))
    slope = F.coalesce(F.try_divide(F.covar_pop(yy, xx).over(w), F.var_pop(xx).over(w)), F.lit(0.0))
    fitted = F.avg(yy).over(w) + slope * (xx - F.avg(xx).over(w))
    return F.when(F.count(yy).over(w) < 3, F.col(y)).otherwise(yy - fitted)


def residual_of_two(y: str, x1: str, x2: str, *by: str) -> Column:
    """y less its regression on x1 and x2 within `by`; all NULL under 4 joint rows; a collinear pair counts as x1 alone."""
    w = W.partitionBy(*by)
    both = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()
    yy, a, b = (F.when(both, F.col(c)) for c in (y, x1, x2))
    cov = lambda p, q: F.covar_pop(p, q).over(w)
    saa, sbb, sab, say, sby = cov(a, a), cov(b, b), cov(a, b), cov(a, yy), cov(b, yy)
    det = saa * sbb - sab * sab
    regular = det > 1e-12 * saa * sbb
    ba = F.when(regular, F.try_divide(say * sbb - sby * sab, det)).otherwise(F.coalesce(F.try_divide(say, saa), F.lit(0.0)))
    bb = F.when(regular, F.try_divide(sby * saa - say * sab, det)).otherwise(F.lit(0.0))
    mean = lambda c: F.avg(c).over(w)
    return F.when(F.count(yy).over(w) >= 4, yy - mean(yy) - ba * (a - mean(a)) - bb * (b - mean(b)))
