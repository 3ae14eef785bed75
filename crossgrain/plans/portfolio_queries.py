"""Registered queries of portfolios, costs, overfitting and covariance."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.functions import inference as I
from crossgrain.operators import features as FE
from crossgrain.operators import portfolio as PF
from crossgrain.operators import risk as R
from crossgrain.plans.catalog import register
from crossgrain.plans.panel_queries import BW, SIGNALS_SQL, SM, W_ASSET, months, rounded, signals, weeks
from crossgrain.sources import panels as P
from crossgrain.sources.scratch import materialize

LIQ_SQL = f"""liq AS (SELECT d, asset, CASE WHEN count(px * volume) OVER w = 12 THEN avg(px * volume) OVER w END AS liq FROM panel WINDOW w AS {W_ASSET} ROWS 11 PRECEDING)),
lx AS (SELECT s.d, s.asset, sig, fwd, liq FROM signals s JOIN liq USING (d, asset)),
lb AS (SELECT *, greatest(CAST(ceil(round({X.AVG_RANK_SQL.format(by='d', v='liq')} / count(*) OVER (PARTITION BY d) * 3, 9)) AS INT) - 1, 0) AS bucket FROM lx WHERE liq IS NOT NULL),
{X.rank_ic_sql('lb', 'sig', 'fwd', 'd, bucket').replace('ranked_ic', 'ranked_b').replace('ic_series', 'bucket_ic')}"""


def liquidity_frame(spark, sf_dir):
    p = P.supplier_month(spark, sf_dir)
    df = p.select("d", "pos", "asset", FE.signal(1, -1).alias("sig"), FE.forward_return(1).alias("fwd"), FE.liquidity(12).alias("liq"))
    return df.withColumn("bucket", X.percent_bucket("liq", 3, "d")).where("bucket IS NOT NULL")


@register("liquidity_bucket_ic", f"WITH {SM}, {SIGNALS_SQL}, {LIQ_SQL} SELECT d, bucket, round(ic, 6) + 0.0 AS ic, n FROM bucket_ic")
def liquidity_bucket_ic(spark, sf_dir):
    return rounded(X.rank_ic(liquidity_frame(spark, sf_dir), "sig", "fwd", "d", "bucket"))


@register("liquidity_spread_test", f"""WITH {SM}, {SIGNALS_SQL}, {LIQ_SQL}, sp AS (SELECT 'low-high' AS key, a.d, a.ic - b.ic AS ic FROM bucket_ic a JOIN bucket_ic b ON a.d = b.d AND a.bucket = 0 AND b.bucket = 2), {I.newey_west_sql('sp', 'key', 'd')}
SELECT key, n, round(mean, 6) AS mean, round(t, 5) AS t FROM hac""")
def liquidity_spread_test(spark, sf_dir):
    ic = X.rank_ic(liquidity_frame(spark, sf_dir), "sig", "fwd", "d", "bucket")
    low, high = ic.where("bucket = 0").select("d", "ic"), ic.where("bucket = 2").select("d", F.col("ic").alias("high"))
    diff = low.join(high, "d").select(F.lit("low-high").alias("key"), "d", (F.col("ic") - F.col("high")).alias("x"))
    return I.newey_west(diff, "d", "key").select("key", "n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


BOOK_SQL = f"""pr AS (SELECT d, pos, asset, sig, fwd, CASE WHEN sig IS NOT NULL THEN {X.AVG_RANK_SQL.format(by='d, sig IS NULL', v='sig')} END AS r, count(sig) OVER (PARTITION BY d) AS n FROM signals),
pk AS (SELECT *, greatest(CAST(round_even(n * 0.2, 0) AS INT), 1) AS k FROM pr),
pl AS (SELECT *, CAST(r > n - k AS INT) AS lo, CAST(r <= k AS INT) AS sh FROM pk),
pw AS (SELECT *, coalesce(lo / nullif(sum(lo) OVER (PARTITION BY d), 0), 0) - coalesce(sh / nullif(sum(sh) OVER (PARTITION BY d), 0), 0) AS w FROM pl),
pt AS (SELECT *, abs(w - coalesce(lag(w) OVER {W_ASSET}), 0)) AS trade FROM pw),
book AS (SELECT d, sum(w * coalesce(fwd, 0)) AS gross, sum(trade) AS turnover FROM pt GROUP BY d)"""


@register("longshort_book", f"WITH {SM}, {SIGNALS_SQL}, {BOOK_SQL} SELECT d, round(gross, 6) + 0.0 AS gross, round(turnover, 6) AS turnover FROM book")
def longshort_book(spark, sf_dir):
    return rounded(PF.longshort_book(signals(spark, sf_dir)))


@register("cost_summary", f"""WITH {SM}, {SIGNALS_SQL}, {BOOK_SQL}, b AS (SELECT gross, turnover, row_number() OVER (ORDER BY d) AS rn FROM book), n AS (SELECT gross, turnover, c AS cost_bps, gross - turnover * c / 1e4 AS net FROM b, (SELECT unnest([1.0, 5.0, 10.0]) :: DOUBLE AS c) WHERE rn > 1)
SELECT cost_bps, round(avg(gross) * 1e4, 4) AS gross_mean_bps, round(avg(turnover), 6) AS turnover, round(avg(gross) / nullif(avg(turnover), 0) * 1e4, 4) AS breakeven_bps, round(avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(252.0), 5) AS sharpe_gross, round(avg(net) * 1e4, 4) AS net_mean_bps, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 5) AS sharpe_net FROM n GROUP BY cost_bps""")
def cost_summary(spark, sf_dir):
    df = PF.cost_summary(PF.longshort_book(signals(spark, sf_dir)))
    digits = {"gross_mean_bps": 4, "breakeven_bps": 4, "net_mean_bps": 4, "turnover": 6, "sharpe_gross": 5, "sharpe_net": 5}
    return df.select("cost_bps", *[F.round(c, k).alias(c) for c, k in digits.items()])


TRANCHE_SQL = """sg AS (SELECT pos, asset, -(px / lag(px, {lb}) OVER (PARTITION BY asset ORDER BY pos) - 1) AS sig, count(*) OVER (PARTITION BY pos) AS n_all FROM rets),
fm AS (SELECT pos, asset, n_all, count(*) OVER (PARTITION BY pos) AS n_sig, row_number() OVER (PARTITION BY pos ORDER BY sig, asset) AS place FROM sg WHERE sig IS NOT NULL AND pos >= {lb}),
lg AS (SELECT pos AS formed, asset, CASE WHEN place <= k THEN -1 WHEN place > n_sig - k THEN 1 END AS leg FROM (SELECT *, greatest(CAST(round_even(n_all * 0.2, 0) AS INT), 1) AS k FROM fm) WHERE n_sig >= 2 * k),
hd AS (SELECT r.d, r.pos, formed, leg, CASE WHEN count(ret) = count(*) THEN avg(ret) END AS r FROM lg JOIN rets r ON r.asset = lg.asset AND r.pos BETWEEN formed + 1 AND formed + {h} WHERE leg IS NOT NULL GROUP BY 1, 2, 3, 4),
bk AS (SELECT d, pos, formed, sum(CASE WHEN leg = 1 THEN r END) - sum(CASE WHEN leg = -1 THEN r END) AS r FROM hd GROUP BY 1, 2, 3),
tranche AS (SELECT d, pos, avg(r) AS r FROM bk WHERE r IS NOT NULL GROUP BY 1, 2)"""


@register("jt_tranche_returns", f"WITH {BW}, {TRANCHE_SQL.format(lb=5, h=5)} SELECT d, pos, round(r, 6) + 0.0 AS r FROM tranche")
def jt_tranche_returns(spark, sf_dir):
    return rounded(PF.tranche_returns(weeks(spark, sf_dir), 5, 5).select("d", F.col("pos").cast("long").alias("pos"), "r"))


GRID = [(lb, h) for lb in (1, 5, 21) for h in (1, 5, 21)]


def config_matrix(spark, sf_dir):
    """config, d, r of a 3 by 3 grid of lookbacks and horizons: tranches of a lookback are formed once, and each horizon takes those that are not older."""
    p = materialize(weeks(spark, sf_dir), "panel")
    out = None
    for lb in dict.fromkeys(lb for lb, _ in GRID):
        horizons = [(h, k) for k, (x, h) in enumerate(GRID) if x == lb]
        books = PF.tranche_books(p, lb, max(h for h, _ in horizons))
        ages = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(k).alias("config")) for h, k in horizons]))
        one = books.withColumn("of", ages).where(F.col("pos") - F.col("formed") <= F.col("of.h")).groupBy("of.config", "d").agg(F.avg("r").alias("r"))
        out = one if out is None else out.unionByName(one)
    return out


def _config_sql():
    parts = []
    for k, (lb, h) in enumerate(GRID):
        names = ("sg", "fm", "lg", "hd", "bk", "tranche")
        sql = TRANCHE_SQL.format(lb=lb, h=h)
        for n in names:
            sql = sql.replace(f"{n} AS (", f"{n}{k} AS (").replace(f"FROM {n} ", f"FROM {n}{k} ").replace(f"FROM {n})", f"FROM {n}{k})")
        parts.append(sql.replace("lg.asset", f"lg{k}.asset"))
    union = " UNION ALL ".join(f"SELECT {k} AS config, d, r FROM tranche{k}" for k in range(len(GRID)))
    return ", ".join(parts) + f""", cm AS ({union}), full_d AS (SELECT d FROM cm GROUP BY d HAVING count(DISTINCT config) = {len(GRID)}),
al AS (SELECT config, r, row_number() OVER (PARTITION BY config ORDER BY d) - 1 AS t FROM cm JOIN full_d USING (d)), nd AS (SELECT count(*) // {len(GRID)} AS n FROM al)"""


CONFIG_SQL = _config_sql()


@register("sharpe_moments", f"""WITH {BW}, {CONFIG_SQL}, m AS (SELECT config, r, avg(r) OVER (PARTITION BY config) AS mu FROM al)
SELECT config, count(*) AS n, round(avg(r) / stddev_samp(r), 6) AS sharpe, round(avg(pow(r - mu, 3)) / pow(stddev_pop(r), 3), 5) AS skew, round(avg(pow(r - mu, 4)) / pow(stddev_pop(r), 4), 5) AS kurt FROM m GROUP BY config""")
def sharpe_moments(spark, sf_dir):
    m = PF.moments(PF.aligned(config_matrix(spark, sf_dir), len(GRID)), "config")
    return m.select("config", "n", F.round("sharpe", 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


#: Twelve thousand eight hundred and seventy ways to choose half of them.
BLOCKS = 16
CSCV_SQL = f"""{BW}, {CONFIG_SQL}, bl AS (SELECT config, t, r, (SELECT max(b) FROM range({BLOCKS}) x(b) WHERE floor(n * b / {BLOCKS}.0) <= t) AS block, n FROM al, nd),
bs AS (SELECT config, block, count(*) AS c, sum(r) AS s, sum(r * r) AS ss FROM bl WHERE t < floor(n * (block + 1) / {BLOCKS}.0) - CASE WHEN block < {BLOCKS - 1} THEN 4 ELSE 0 END GROUP BY 1, 2),
mk AS (SELECT m AS mask FROM range({1 << BLOCKS}) x(m) WHERE bit_count(m) = {BLOCKS // 2}),
sc AS (SELECT mask, config, (mask >> block) & 1 AS inside, sum(s) / sum(c) AS mu, sum(ss) / sum(c) AS m2 FROM mk, bs GROUP BY 1, 2, 3),
sr AS (SELECT mask, config, max(CASE WHEN inside = 1 THEN mu / sqrt(greatest(m2 - mu * mu, 1e-18)) END) AS i, max(CASE WHEN inside = 0 THEN mu / sqrt(greatest(m2 - mu * mu, 1e-18)) END) AS o FROM sc GROUP BY 1, 2),
bt AS (SELECT mask, arg_max(config, (i, -config)) AS best, arg_max(o, (i, -config)) AS bo FROM sr GROUP BY 1),
cscv AS (SELECT sr.mask, max(best) AS best, sum(CAST(o <= bo AS INT)) AS rank FROM sr JOIN bt USING (mask) GROUP BY sr.mask)"""


def cscv_splits(spark, sf_dir):
    m = materialize(PF.aligned(config_matrix(spark, sf_dir), len(GRID)), "configs")
    n = m.where("config = 0").count()
    return PF.cscv(m, n, len(GRID), BLOCKS, 4)


@register("cscv_pbo", f"WITH {CSCV_SQL} SELECT CAST(mask AS BIGINT) AS mask, best, CAST(rank AS BIGINT) AS rank FROM cscv")
def cscv_pbo(spark, sf_dir):
    return cscv_splits(spark, sf_dir)


@register("cscv_rank_histogram", f"WITH {CSCV_SQL} SELECT CAST(rank AS BIGINT) AS rank, count(*) AS n FROM cscv GROUP BY 1")
def cscv_rank_histogram(spark, sf_dir):
    return cscv_splits(spark, sf_dir).groupBy("rank").agg(F.count("*").alias("n"))


# covariance: brands over the last 120 weeks of every fortieth week

COV_SQL = f"""{BW}, cw AS (SELECT e.e AS as_of, pos, asset, ret FROM (SELECT pos AS e FROM calendar WHERE pos >= 120 AND pos % 40 = 0) e JOIN rets ON pos BETWEEN e.e - 119 AND e.e),
cc AS (SELECT as_of, pos FROM cw GROUP BY 1, 2 HAVING count(ret) = (SELECT count(DISTINCT asset) FROM panel)),
cx AS (SELECT as_of, pos, asset, ret - avg(ret) OVER (PARTITION BY as_of, asset) AS x FROM cw JOIN cc USING (as_of, pos)),
pm AS (SELECT a.as_of, a.asset AS i, b.asset AS j, count(*) AS t, sum(a.x * b.x) / (count(*) - 1) AS cov, avg(a.x * b.x) AS s, avg(a.x * b.x * a.x * b.x) AS m22, avg(a.x * a.x * a.x * b.x) AS m31 FROM cx a JOIN cx b ON a.as_of = b.as_of AND a.pos = b.pos GROUP BY 1, 2, 3),
pv AS (SELECT p.*, vi.s AS vi, vj.s AS vj FROM pm p JOIN pm vi ON vi.as_of = p.as_of AND vi.i = p.i AND vi.j = p.i JOIN pm vj ON vj.as_of = p.as_of AND vj.i = p.j AND vj.j = p.j),
pr AS (SELECT *, avg(CASE WHEN i <> j THEN s / sqrt(vi * vj) END) OVER (PARTITION BY as_of) AS r_bar FROM pv),
pf AS (SELECT *, CASE WHEN i = j THEN s ELSE r_bar * sqrt(vi * vj) END AS f FROM pr),
lw AS (SELECT p.as_of, sum(p.m22 - p.s * p.s) AS pi, sum(CASE WHEN p.i = p.j THEN p.m22 - p.s * p.s ELSE p.r_bar / 2 * (sqrt(p.vj / p.vi) * (p.m31 - p.vi * p.s) + sqrt(p.vi / p.vj) * (q.m31 - p.vj * p.s)) END) AS rho, sum(pow(p.f - p.s, 2)) AS gamma, max(p.t) AS t FROM pf p JOIN pm q ON q.as_of = p.as_of AND q.i = p.j AND q.j = p.i GROUP BY p.as_of),
de AS (SELECT as_of, CASE WHEN gamma <= 0 THEN 0 ELSE least(greatest((pi - rho) / (gamma * t), 0), 1) END AS delta FROM lw)"""


def cov_pairs(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    spread = P.calendar(panel).where("pos >= 120 AND pos % 40 = 0").select(F.col("pos").alias("as_of"), F.explode(F.sequence(F.col("pos") - 119, F.col("pos"))).alias("pos"))
    rows = panel.join(F.broadcast(spread), "pos").select("as_of", "pos", "asset", "ret")
    return materialize(R.pair_moments(R.complete_case(materialize(rows, "window"), "as_of"), "as_of"), "pairs")


@register("sample_cov_pairs", f"WITH {COV_SQL} SELECT as_of, i, j, t, round(cov * 1e6, 4) + 0.0 AS cov FROM pm")
def sample_cov_pairs(spark, sf_dir):
    return cov_pairs(spark, sf_dir).select("as_of", "i", "j", "t", F.round(F.col("cov") * 1e6, 4).alias("cov"))


@register("const_corr_target", f"WITH {COV_SQL} SELECT as_of, i, j, round(f * 1e6, 4) + 0.0 AS f FROM pf")
def const_corr_target(spark, sf_dir):
    return R.constant_correlation_target(cov_pairs(spark, sf_dir), "as_of").select("as_of", "i", "j", F.round(F.col("f") * 1e6, 4).alias("f"))


@register("ledoit_wolf_cc", f"WITH {COV_SQL} SELECT as_of, i, j, round(delta, 6) AS delta, round((delta * f + (1 - delta) * s) * 1e6, 3) + 0.0 AS cov FROM pf JOIN de USING (as_of)")
def ledoit_wolf_cc(spark, sf_dir):
    pairs = cov_pairs(spark, sf_dir)
    cov = R.ledoit_wolf_cov(pairs, "as_of").join(R.ledoit_wolf_shrinkage(pairs, "as_of"), "as_of")
    return cov.select("as_of", "i", "j", F.round("delta", 6).alias("delta"), F.round(F.col("cov") * 1e6, 3).alias("cov"))


@register("diag_gmvp", f"WITH {COV_SQL} SELECT as_of, i AS asset, round((1 / cov) / sum(1 / cov) OVER (PARTITION BY as_of), 6) AS w FROM pm WHERE i = j")
def diag_gmvp(spark, sf_dir):
    return rounded(R.diagonal_gmvp(cov_pairs(spark, sf_dir), "as_of"))


@register("avg_pairwise_corr", f"WITH {COV_SQL} SELECT as_of, round(avg(s / sqrt(vi * vj)), 6) + 0.0 AS avg_corr FROM pv WHERE i <> j GROUP BY as_of")
def avg_pairwise_corr(spark, sf_dir):
    return rounded(R.average_pair_correlation(cov_pairs(spark, sf_dir), "as_of"))


#: Two books a week: equal weights of all brands, and of the brands of sector 1.
BOOKS_SQL = f"{BW}, bks AS (SELECT d, pos, avg(ret) AS a, avg(CASE WHEN asset LIKE 'Brand#1%' THEN ret END) AS b, stddev_samp(ret) AS disp FROM rets GROUP BY 1, 2), bk2 AS (SELECT *, disp >= (SELECT median(disp) FROM bks) AS high FROM bks WHERE a IS NOT NULL AND b IS NOT NULL)"


def books(spark, sf_dir):
    b = weeks(spark, sf_dir).groupBy("d", "pos").agg(F.avg("ret").alias("a"), F.avg(F.when(F.col("asset").like("Brand#1%"), F.col("ret"))).alias("b"), F.stddev_samp("ret").alias("disp"))
    cut = b.agg(F.median("disp").alias("cut"))
    return b.join(F.broadcast(cut)).where("a IS NOT NULL AND b IS NOT NULL").withColumn("high", F.col("disp") >= F.col("cut"))


@register("regime_split", f"""WITH {BOOKS_SQL}, v AS (SELECT ln(var_samp(CASE WHEN high THEN b END) / var_samp(CASE WHEN high THEN a END)) AS log_high, ln(var_samp(CASE WHEN NOT high THEN b END) / var_samp(CASE WHEN NOT high THEN a END)) AS log_low FROM bk2)
SELECT round(log_high, 6) AS log_high, round(log_low, 6) AS log_low, round(log_high - log_low, 6) AS spread FROM v""")
def regime_split(spark, sf_dir):
    return rounded(R.regime_spread(books(spark, sf_dir), "a", "b", "high"))


@register("realized_vol", f"WITH {BOOKS_SQL} SELECT year(d) AS y, round(stddev_samp(a) * sqrt(252.0), 6) AS realized_vol FROM bk2 GROUP BY 1")
def realized_vol(spark, sf_dir):
    return rounded(R.realized_vol(books(spark, sf_dir).select(F.year("d").cast("long").alias("y"), F.col("a").alias("r")), "y"))


@register("paired_sq_diff", f"WITH {BOOKS_SQL} SELECT d, round((pow(a - avg(a) OVER (), 2) - pow(b - avg(b) OVER (), 2)) * 1e4, 5) + 0.0 AS x FROM bk2")
def paired_sq_diff(spark, sf_dir):
    return R.paired_squared_difference(books(spark, sf_dir), "a", "b").select("d", F.round(F.col("x") * 1e4, 5).alias("x"))


def summary_statistics(spark, sf_dir):
    """One row a configuration with its probabilistic and deflated Sharpe ratios, by days and by the days that its series is worth, and the share of splits that overfit: finished on the driver from nine rows."""
    matrix = materialize(PF.aligned(config_matrix(spark, sf_dir), len(GRID)), "configs")
    rows = PF.moments(matrix, "config").collect()
    series = matrix.select("config", "t", F.col("r").alias("x"))
    iid = {r["config"]: r["se"] for r in I.newey_west(series, "t", "config", lag=0).collect()}
    hac = {r["config"]: r["se"] for r in I.newey_west(series, "t", "config").collect()}
    share = PF.pbo(PF.cscv(matrix, rows[0]["n"], len(GRID), BLOCKS, 4), len(GRID)).first()["pbo"]
    var = sum((r["sharpe"] - sum(x["sharpe"] for x in rows) / len(rows)) ** 2 for r in rows) / max(len(rows) - 1, 1)
    out = []
    for r in rows:
        c, one = r["config"], (r["sharpe"], r["n"], r["skew"], r["kurt"])
        t_eff = PF.effective_length(r["n"], iid[c], hac[c]) if hac[c] else float(r["n"])
        out.append((
            c, *GRID[c], r["n"], r["sharpe"], r["sharpe"] * math.sqrt(252), PF.probabilistic_sharpe(*one), PF.deflated_sharpe(*one, len(rows), var), t_eff,
            PF.probabilistic_sharpe(*one, t_eff=t_eff), PF.deflated_sharpe(*one, len(rows), var, t_eff), share,
        ))
    return spark.createDataFrame(out, "config int, lookback int, horizon int, n_days long, sharpe double, ann_sharpe double, psr double, dsr double, t_eff double, psr_t_eff double, dsr_t_eff double, pbo double")


@register("overfit_summary")
def overfit_summary(spark, sf_dir):
    return summary_statistics(spark, sf_dir)
