"""Registered queries of panels, features, labels, normalisation and rank statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.functions import inference as I
from crossgrain.operators import features as FE
from crossgrain.plans.catalog import register
from crossgrain.sources import panels as P
from crossgrain.sources.scratch import materialize

SM, BW, UD = P.SUPPLIER_MONTH_SQL, P.BRAND_WEEK_SQL, P.USER_DAY_SQL
W_ASSET = "(PARTITION BY asset ORDER BY pos"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six digits; other columns as they are."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keys else c for c, t in df.dtypes])


def months(spark, sf_dir):
    return P.with_returns(P.supplier_month(spark, sf_dir))


def weeks(spark, sf_dir):
    return P.with_returns(P.brand_week(spark, sf_dir))


@register("panel_dense_grid", f"WITH {SM} SELECT d, pos, asset, px, volume FROM panel")
def panel_dense_grid(spark, sf_dir):
    return P.supplier_month(spark, sf_dir).select("d", "pos", "asset", "px", "volume")


@register("panel_returns", f"WITH {SM} SELECT d, asset, round(ret, 6) + 0.0 AS ret FROM rets")
def panel_returns(spark, sf_dir):
    return rounded(months(spark, sf_dir).select("d", "asset", "ret"))


@register("panel_user_day", f"WITH {UD} SELECT d, asset, round(px, 6) AS px, round(ret, 6) + 0.0 AS ret FROM rets")
def panel_user_day(spark, sf_dir):
    return rounded(P.with_returns(P.user_day(spark, sf_dir)).select("d", "asset", "px", "ret"))


@register("complete_case_dates", f"WITH {UD} SELECT d, count(px) AS present, count(*) AS assets FROM panel GROUP BY d HAVING count(px) >= 0.9 * count(*)")
def complete_case_dates(spark, sf_dir):
    return P.user_day(spark, sf_dir).groupBy("d").agg(F.count("px").alias("present"), F.count("*").alias("assets")).where("present >= 0.9 * assets")


def _rebalance(period):
    def query(spark, sf_dir):
        return FE.last_date_of(P.calendar(P.user_day(spark, sf_dir)), period).select("period", "d", F.col("pos").cast("long").alias("pos"))

    return query


for _p in ("week", "month"):
    register(f"rebalance_last_day_{_p}", f"WITH {UD} SELECT CAST(date_trunc('{_p}', d) AS DATE) AS period, max(d) AS d, max(pos) AS pos FROM calendar GROUP BY 1")(_rebalance(_p))


@register("feat_momentum", f"""WITH {SM} SELECT d, asset, round(px / lag(px, 21) OVER w - 1, 6) + 0.0 AS mom_1m, round(px / lag(px, 63) OVER w - 1, 6) + 0.0 AS mom_3m,
round(px / lag(px, 5) OVER w - 1, 6) + 0.0 AS rev_1w FROM panel WINDOW w AS {W_ASSET})""")
def feat_momentum(spark, sf_dir):
    p = P.supplier_month(spark, sf_dir)
    return rounded(p.select("d", "asset", FE.performance(21).alias("mom_1m"), FE.performance(63).alias("mom_3m"), FE.performance(5).alias("rev_1w")))


@register("feat_mom_12_1", f"WITH {BW} SELECT d, asset, round(lag(px, 21) OVER w / lag(px, 252) OVER w - 1, 6) + 0.0 AS mom_12_1 FROM panel WINDOW w AS {W_ASSET})")
def feat_mom_12_1(spark, sf_dir):
    return rounded(P.brand_week(spark, sf_dir).select("d", "asset", FE.performance(252, 21).alias("mom_12_1")))


@register("feat_vol20", f"WITH {BW} SELECT d, asset, round(stddev_samp(ret) OVER {W_ASSET} ROWS 19 PRECEDING) * sqrt(252.0), 6) AS vol_20d FROM rets")
def feat_vol20(spark, sf_dir):
    return rounded(FE.base_features(weeks(spark, sf_dir)).select("d", "asset", "vol_20d"))


@register("feat_turnover", f"WITH {BW} SELECT d, asset, round(ln(nullif(avg(px * volume) OVER {W_ASSET} ROWS 19 PRECEDING), 0)), 6) AS turnover FROM panel")
def feat_turnover(spark, sf_dir):
    return rounded(FE.base_features(weeks(spark, sf_dir)).select("d", "asset", "turnover"))


@register("feat_size", f"WITH {BW} SELECT d, asset, round(ln(nullif(px * volume, 0)), 6) AS size FROM panel")
def feat_size(spark, sf_dir):
    return rounded(FE.base_features(weeks(spark, sf_dir)).select("d", "asset", "size"))


@register("feat_beta", f"""WITH {BW}, m AS (SELECT *, avg(ret) OVER (PARTITION BY d) AS mkt FROM rets)
SELECT d, asset, round(covar_samp(ret, CASE WHEN ret IS NOT NULL THEN mkt END) OVER w / nullif(var_samp(mkt) OVER w, 0), 6) + 0.0 AS beta FROM m WINDOW w AS {W_ASSET} ROWS 119 PRECEDING)""")
def feat_beta(spark, sf_dir):
    return rounded(FE.base_features(weeks(spark, sf_dir)).select("d", "asset", "beta"))


@register("label_forward_return", f"WITH {SM} SELECT d, asset, round(lead(px, 3) OVER {W_ASSET}) / px - 1, 6) + 0.0 AS fwd FROM panel")
def label_forward_return(spark, sf_dir):
    return rounded(P.supplier_month(spark, sf_dir).select("d", "asset", FE.forward_return(3).alias("fwd")))


FWD_VOL = "CASE WHEN lead(pos, 5) OVER {w}) IS NOT NULL AND stddev_pop(ret) OVER {w} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) * sqrt(252.0) > 1e-12 THEN ln(stddev_pop(ret) OVER {w} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) * sqrt(252.0)) END".format(w=W_ASSET)


@register("label_forward_logvol", f"WITH {BW} SELECT d, asset, round({FWD_VOL}, 6) + 0.0 AS fwd_vol FROM rets")
def label_forward_logvol(spark, sf_dir):
    return rounded(weeks(spark, sf_dir).select("d", "asset", FE.forward_log_vol(5).alias("fwd_vol")))


@register("xs_median_impute", f"WITH {SM} SELECT d, asset, round(coalesce(ret, median(ret) OVER (PARTITION BY d), 0), 6) + 0.0 AS ret FROM rets")
def xs_median_impute(spark, sf_dir):
    return rounded(months(spark, sf_dir).select("d", "asset", X.median_imputed("ret", "d").alias("ret")))


Z = "CASE WHEN stddev_pop({v}) OVER (PARTITION BY d) > 1e-15 THEN ({v} - avg({v}) OVER (PARTITION BY d)) / stddev_pop({v}) OVER (PARTITION BY d) ELSE 0 END"


@register("xs_zscore", f"WITH {SM}, x AS (SELECT d, asset, coalesce(ret, median(ret) OVER (PARTITION BY d), 0) AS v FROM rets) SELECT d, asset, round({Z.format(v='v')}, 6) + 0.0 AS z FROM x")
def xs_zscore(spark, sf_dir):
    return rounded(X.zscored(months(spark, sf_dir).select("d", "asset", F.col("ret").alias("z")), ["z"], "d"))


@register("xs_rank_norm", f"""WITH {SM}, x AS (SELECT d, asset, coalesce(ret, median(ret) OVER (PARTITION BY d), 0) AS v FROM rets),
r AS (SELECT d, asset, {X.AVG_RANK_SQL.format(by='d', v='v')} AS r FROM x) SELECT d, asset, round({Z.format(v='r')}, 6) + 0.0 AS z FROM r""")
def xs_rank_norm(spark, sf_dir):
    return rounded(X.rank_normalised(months(spark, sf_dir).select("d", "asset", F.col("ret").alias("z")), ["z"], "d"))


@register("feature_frame", f"""WITH {SM}, x AS (SELECT d, asset, coalesce(product(1 + ret) OVER {W_ASSET} ROWS 4 PRECEDING), 1) - 1 AS ret_5, coalesce(product(1 + ret) OVER {W_ASSET} ROWS 19 PRECEDING), 1) - 1 AS ret_20 FROM rets)
SELECT d, asset, round({Z.format(v='ret_5')}, 5) + 0.0 AS ret_5, round({Z.format(v='ret_20')}, 5) + 0.0 AS ret_20 FROM x""")
def feature_frame(spark, sf_dir):
    df = FE.feature_frame(months(spark, sf_dir), (5, 20))
    return df.select("d", "asset", F.round("ret_5", 5).alias("ret_5"), F.round("ret_20", 5).alias("ret_20"))


#: Signal and label of the supplier panel at every date: reversal over one row, and momentum over 12 rows less the last.
SIGNALS_SQL = f"""signals AS (SELECT d, pos, asset, -(px / lag(px) OVER w - 1) AS sig, lag(px) OVER w / lag(px, 13) OVER w - 1 AS mom, lead(px) OVER w / px - 1 AS fwd FROM panel WINDOW w AS {W_ASSET}))"""


def signals(spark, sf_dir):
    p = P.supplier_month(spark, sf_dir)
    return p.select("d", "pos", "asset", FE.signal(1, -1).alias("sig"), FE.performance(13, 1).alias("mom"), FE.forward_return(1).alias("fwd"))


def _ic(name, pred):
    @register(name, f"WITH {SM}, {SIGNALS_SQL}, {X.rank_ic_sql('signals', pred, 'fwd')} SELECT d, round(ic, 6) + 0.0 AS ic, n FROM ic_series")
    def query(spark, sf_dir):
        return rounded(X.rank_ic(signals(spark, sf_dir), pred, "fwd", "d"))

    return query


_ic("rank_ic_reversal", "sig")
_ic("rank_ic_momentum", "mom")


@register("rank_ic_canary", f"WITH {SM}, {SIGNALS_SQL}, {X.rank_ic_sql('signals', 'fwd', 'fwd')} SELECT d, round(ic, 6) + 0.0 AS ic, n FROM ic_series")
def rank_ic_canary(spark, sf_dir):
    return rounded(X.rank_ic(signals(spark, sf_dir).withColumn("leak", F.col("fwd")), "leak", "fwd", "d"))


@register("long_short_spread", f"""WITH {SM}, {SIGNALS_SQL}, x AS (SELECT * FROM signals WHERE sig IS NOT NULL AND fwd IS NOT NULL),
c AS (SELECT d, quantile_cont(sig, 0.8) AS hi, quantile_cont(sig, 0.2) AS lo FROM x GROUP BY d)
SELECT d, round(CASE WHEN count(*) >= 5 AND max(hi) > max(lo) THEN avg(CASE WHEN sig >= hi THEN fwd END) - avg(CASE WHEN sig <= lo THEN fwd END) END, 6) + 0.0 AS spread FROM x JOIN c USING (d) GROUP BY d""")
def long_short_spread(spark, sf_dir):
    return rounded(X.long_short_spread(signals(spark, sf_dir), "sig", "fwd", 0.2, "d"))


def ic_frame(spark, sf_dir):
    """key, d, x: the series of rank correlations of both signals."""
    s = materialize(signals(spark, sf_dir), "signals")
    one = lambda name, col: X.rank_ic(s, col, "fwd", "d").select(F.lit(name).alias("key"), "d", F.col("ic").alias("x"))
    return materialize(one("reversal", "sig").unionByName(one("momentum", "mom")), "series")


_A, _B = X.rank_ic_sql("signals", "sig", "fwd"), X.rank_ic_sql("signals", "mom", "fwd").replace("ranked_ic", "ranked_mom").replace("ic_series", "mom_series")
IC_FRAME_SQL = f"{SM}, {SIGNALS_SQL}, {_A}, {_B}, ics AS (SELECT 'reversal' AS key, d, ic FROM ic_series UNION ALL SELECT 'momentum', d, ic FROM mom_series)"
HAC_SQL = I.newey_west_sql("ics", "key", "d")


@register("hac_tstat", f"WITH {IC_FRAME_SQL}, {HAC_SQL} SELECT key, n, round(mean, 6) AS mean, round(se, 6) AS se, round(t, 5) AS t FROM hac")
def hac_tstat(spark, sf_dir):
    df = I.newey_west(ic_frame(spark, sf_dir), "d", "key")
    return df.select("key", "n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 5).alias("t"))


@register("ic_summary", f"""WITH {IC_FRAME_SQL}, {HAC_SQL}, sds AS (SELECT key, stddev_samp(ic) AS sd FROM ics GROUP BY key)
SELECT key, round(mean, 6) AS mean_ic, round(sd, 6) AS sd, round(mean / sd, 6) AS ir, round(mean / (sd / sqrt(n)), 5) AS naive_t, round(t, 5) AS hac_t, n AS n_dates FROM hac JOIN sds USING (key)""")
def ic_summary(spark, sf_dir):
    df = I.ic_summary(ic_frame(spark, sf_dir), "d", "key")
    return df.select("key", *[F.round(c, 5 if c.endswith("_t") else 6).alias(c) for c in ("mean_ic", "sd", "ir", "naive_t", "hac_t")], "n_dates")


PHI_SQL = """phi_n AS (SELECT key, ic - avg(ic) OVER (PARTITION BY key) AS e, row_number() OVER (PARTITION BY key ORDER BY d) AS t FROM ics WHERE ic IS NOT NULL),
phi_l AS (SELECT *, lag(e) OVER (PARTITION BY key ORDER BY t) AS b FROM phi_n)"""


@register("ar1_phi", f"WITH {IC_FRAME_SQL}, {PHI_SQL} SELECT key, round(CASE WHEN count(*) < 5 THEN 0.3 ELSE least(greatest(sum(e * b) / nullif(sum(e * e), 0), 0), 0.9) END, 6) AS phi FROM phi_l GROUP BY key")
def ar1_phi(spark, sf_dir):
    return rounded(I.ar1_phi(ic_frame(spark, sf_dir), "d", "key"))


#: A family of tests: each supplier's mean return, its p-value by 1 / (1 + t^2), a stand-in that both engines have exactly.
P_SQL = f"""{SM}, tests AS (SELECT asset, CASE WHEN count(ret) >= 3 THEN 1 / (1 + pow(avg(ret) / nullif(stddev_samp(ret) / sqrt(count(ret)), 0), 2) * 4) END AS p FROM rets GROUP BY asset),
o AS (SELECT asset, coalesce(p, 1) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY coalesce(p, 1), asset) AS k FROM tests),
b AS (SELECT *, least(min(p * m / k) OVER (ORDER BY k DESC), 1) AS q, max(CASE WHEN p <= k / m * 0.05 THEN k END) OVER () AS last FROM o)"""


def tests_frame(spark, sf_dir):
    t = F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("ret")))
    return months(spark, sf_dir).groupBy("asset").agg(F.when(F.count("ret") >= 3, 1 / (1 + t * t * 4)).alias("p"))


@register("bh_fdr", f"WITH {P_SQL} SELECT asset, round(p, 6) AS p, round(q, 6) AS q, coalesce(k <= last, false) AS fdr_sig FROM b")
def bh_fdr(spark, sf_dir):
    df = I.benjamini_hochberg(tests_frame(spark, sf_dir).withColumn("family", F.lit(1)), "p", 0.05, "family")
    return df.select("asset", F.round(F.coalesce("p", F.lit(1.0)), 6).alias("p"), F.round("q", 6).alias("q"), "fdr_sig")


VOLS_SQL = f"vols AS (SELECT d, asset, stddev_samp(ret) OVER {W_ASSET} ROWS 19 PRECEDING) AS vt, stddev_samp(ret) OVER {W_ASSET} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS realized, count(ret) OVER {W_ASSET} ROWS 19 PRECEDING) AS n FROM rets)"


@register("qlike", f"WITH {BW}, {VOLS_SQL} SELECT asset, round(avg(realized / vt - ln(realized / vt) - 1), 6) AS qlike, count(*) AS n FROM vols WHERE n = 20 AND realized > 0 AND vt > 0 GROUP BY asset")
def qlike(spark, sf_dir):
    w = W.partitionBy("asset").orderBy("pos")
    df = weeks(spark, sf_dir).select("asset", FE.trailing_vol(20).alias("trailing"), F.stddev_samp("ret").over(w.rowsBetween(1, 5)).alias("realized"))
    return rounded(I.qlike(df, "realized", "trailing", "asset"))


@register("trailing_vol", f"WITH {BW}, {VOLS_SQL} SELECT d, asset, round(CASE WHEN n = 20 THEN vt END, 6) AS vol FROM vols")
def trailing_vol(spark, sf_dir):
    return rounded(weeks(spark, sf_dir).select("d", "asset", FE.trailing_vol(20).alias("vol")))


@register("naive_vol_forecast", f"WITH {BW}, {VOLS_SQL} SELECT d, asset, round(CASE WHEN n = 20 AND vt > 0 THEN ln(vt * sqrt(252.0)) END, 6) + 0.0 AS forecast FROM vols")
def naive_vol_forecast(spark, sf_dir):
    vol = FE.trailing_vol(20)
    return rounded(weeks(spark, sf_dir).withColumn("v", vol).select("d", "asset", F.when(F.col("v") > 0, F.ln(F.col("v") * F.sqrt(F.lit(252.0)))).alias("forecast")))


@register("paired_ic_diff", f"""WITH {IC_FRAME_SQL}, ics2 AS (SELECT 'diff' AS key, a.d, a.ic - b.ic AS ic FROM ic_series a JOIN mom_series b ON a.d = b.d), {I.newey_west_sql('ics2', 'key', 'd')}
SELECT key, n, round(mean, 6) AS mean, round(t, 5) AS t FROM hac""")
def paired_ic_diff(spark, sf_dir):
    s = materialize(signals(spark, sf_dir), "signals")
    a, b = X.rank_ic(s, "sig", "fwd", "d"), X.rank_ic(s, "mom", "fwd", "d").withColumnRenamed("ic", "ic2")
    diff = a.select("d", "ic").join(b.select("d", "ic2"), "d").select(F.lit("diff").alias("key"), "d", (F.col("ic") - F.col("ic2")).alias("x"))
    return I.newey_west(diff, "d", "key").select("key", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@register("rank_turnover", f"""WITH {SM}, {SIGNALS_SQL}, r AS (SELECT d, pos, asset, CASE WHEN sig IS NOT NULL THEN {X.AVG_RANK_SQL.format(by='d, sig IS NULL', v='sig')} END AS r, count(sig) OVER (PARTITION BY d) AS n FROM signals),
m AS (SELECT *, abs(r - lag(r) OVER {W_ASSET})) AS move FROM r) SELECT d, round(avg(move) / nullif(max(n), 0), 6) AS turnover FROM m GROUP BY d""")
def rank_turnover(spark, sf_dir):
    from crossgrain.operators.portfolio import rank_turnover as turnover

    df = turnover(signals(spark, sf_dir))
    return rounded(df)
