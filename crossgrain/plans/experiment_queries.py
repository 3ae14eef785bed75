"""Registered end-to-end studies on the test tables' panels."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.operators import features as FE
from crossgrain.operators import models as M
from crossgrain.operators import synthetic as Y
from crossgrain.plans import experiments as E
from crossgrain.plans.catalog import register
from crossgrain.plans.graph_queries import ASOF, CORR_SQL, asofs
from crossgrain.plans.panel_queries import BW, W_ASSET, months
from crossgrain.plans.portfolio_queries import BOOK_SQL
from crossgrain.sources import panels as P
from crossgrain.sources.scratch import materialize


def weeks(spark, sf_dir):
    """The brand panel, written once: a study reads it many times."""
    return materialize(P.with_returns(P.brand_week(spark, sf_dir)), "panel")


def weekly_edges(panel, kind="correlation", start=64, step=5):
    return materialize(E.G.make_graph(kind, panel, E.rebalances(panel, start, step), None, 60, 5), "edges")


@register("x_ablation")
def x_ablation(spark, sf_dir):
    return E.ablation(weeks(spark, sf_dir), P.brand_sectors(spark, sf_dir))


#: The studies' graphs: the five strongest correlations of sixty weeks, as of every fifth week.
WEEKLY_SQL = CORR_SQL.replace(ASOF, "pos >= 64 AND (pos - 64) % 5 = 0").replace("rn <= 10", "rn <= 5")


def _ics_sql(pairs):
    """Rank correlations of (signal, source, value, label), one table under another."""
    tables, rows = [], []
    for k, (name, source, value, label) in enumerate(pairs):
        tables.append(X.rank_ic_sql(source, value, label, "as_of").replace("ranked_ic", f"ranked_{k}").replace("ic_series", f"series_{k}"))
        rows.append(f"SELECT '{name}' AS signal, as_of AS d, round(ic, 6) + 0.0 AS ic FROM series_{k}")
    return ", ".join(tables), " UNION ALL ".join(rows)


LEADLAG_SQL = f"""{WEEKLY_SQL}, base AS (SELECT d AS as_of, asset, coalesce(product(1 + ret) OVER {W_ASSET} ROWS 4 PRECEDING), 1) - 1 AS own, lead(px, 5) OVER {W_ASSET}) / px - 1 AS fwd FROM rets),
sg AS (SELECT k.as_of, src AS asset, sum(abs(weight) * own) / nullif(sum(abs(weight)), 0) AS sig FROM knn k JOIN base b ON b.as_of = k.as_of AND b.asset = dst GROUP BY 1, 2),
sj AS (SELECT sg.as_of, sg.asset, sig, own, fwd, CASE WHEN fwd IS NOT NULL THEN own END AS oo FROM sg JOIN base USING (as_of, asset)),
sl AS (SELECT *, CASE WHEN count(fwd) OVER w < 3 THEN fwd ELSE fwd - avg(fwd) OVER w - coalesce(covar_pop(fwd, oo) OVER w / nullif(var_pop(oo) OVER w, 0), 0) * (oo - avg(oo) OVER w) END AS leftover FROM sj WINDOW w AS (PARTITION BY as_of))"""
LEADLAG_ICS = _ics_sql([("leadlag", "sl", "sig", "fwd"), ("leadlag_resid", "sl", "sig", "leftover"), ("own_mom", "sl", "own", "fwd")])
SPILL_SQL = f"""{WEEKLY_SQL}, v0 AS (SELECT d AS as_of, asset, CASE WHEN count(ret) OVER s = 20 THEN stddev_samp(ret) OVER s END AS own_s, CASE WHEN count(ret) OVER l = 60 THEN stddev_samp(ret) OVER l END AS own_l,
  CASE WHEN count(ret) OVER f = 5 THEN stddev_samp(ret) OVER f END AS fwd FROM rets WINDOW s AS {W_ASSET} ROWS 19 PRECEDING), l AS {W_ASSET} ROWS 59 PRECEDING), f AS {W_ASSET} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
vb AS (SELECT *, own_s - own_l AS innov FROM v0),
vs AS (SELECT k.as_of, src AS asset, sum(CASE WHEN innov IS NOT NULL THEN abs(weight) * innov END) / nullif(sum(CASE WHEN innov IS NOT NULL THEN abs(weight) END), 0) AS sig FROM knn k JOIN vb b ON b.as_of = k.as_of AND b.asset = dst WHERE innov IS NOT NULL GROUP BY 1, 2),
vn AS (SELECT k.as_of, src AS asset, sum(abs(weight) * own_s) / nullif(sum(abs(weight)), 0) AS sig FROM knn k JOIN vb b ON b.as_of = k.as_of AND b.asset = dst WHERE own_s IS NOT NULL GROUP BY 1, 2),
vj AS (SELECT vs.as_of, vs.asset, sig, own_s, own_l, fwd FROM vs JOIN vb USING (as_of, asset)),
vx AS (SELECT as_of, count(*) AS n, avg(fwd) AS my, avg(own_s) AS ma, avg(own_l) AS mb, var_pop(own_s) AS saa, var_pop(own_l) AS sbb, covar_pop(own_s, own_l) AS sab, covar_pop(own_s, fwd) AS say, covar_pop(own_l, fwd) AS sby FROM vj WHERE fwd IS NOT NULL AND own_s IS NOT NULL AND own_l IS NOT NULL GROUP BY 1),
vl AS (SELECT vj.*, CASE WHEN n >= 4 AND own_s IS NOT NULL AND own_l IS NOT NULL THEN fwd - my - (say * sbb - sby * sab) / (saa * sbb - sab * sab) * (own_s - ma) - (sby * saa - say * sab) / (saa * sbb - sab * sab) * (own_l - mb) END AS leftover FROM vj LEFT JOIN vx USING (as_of)),
vk AS (SELECT vn.as_of, vn.asset, sig, own_s, fwd, CASE WHEN fwd IS NOT NULL THEN own_s END AS oo, CASE WHEN own_s IS NOT NULL THEN fwd END AS yy FROM vn JOIN vb USING (as_of, asset)),
vm AS (SELECT *, CASE WHEN count(yy) OVER w < 3 THEN fwd ELSE yy - avg(yy) OVER w - coalesce(covar_pop(yy, oo) OVER w / nullif(var_pop(oo) OVER w, 0), 0) * (oo - avg(oo) OVER w) END AS leftover FROM vk WINDOW w AS (PARTITION BY as_of))"""
SPILL_ICS = _ics_sql([("spill_raw", "vl", "sig", "fwd"), ("spill_resid", "vl", "sig", "leftover"), ("own_vol", "vl", "own_s", "fwd")])
PROBE_ICS = _ics_sql([("naive", "vm", "sig", "leftover"), ("innov", "vl", "sig", "leftover")])


@register("leadlag_ic_series", f"WITH {LEADLAG_SQL}, {LEADLAG_ICS[0]} {LEADLAG_ICS[1]}")
def leadlag_ic_series(spark, sf_dir):
    """The series that the lead-lag study tests, over real edges."""
    panel = weeks(spark, sf_dir)
    return E.leadlag_series(materialize(E.momenta(panel), "returns"), weekly_edges(panel), "real").select("signal", "d", F.round("x", 6).alias("ic"))


@register("volspill_ic_series", f"WITH {SPILL_SQL}, {SPILL_ICS[0]} {SPILL_ICS[1]}")
def volspill_ic_series(spark, sf_dir):
    """The series that the spillover study tests, over real edges."""
    panel = weeks(spark, sf_dir)
    return E.spillover_series(materialize(E.volatilities(panel, 20, 60, 5), "volatility"), weekly_edges(panel), "real").select("signal", "d", F.round("x", 6).alias("ic"))


@register("x_leadlag")
def x_leadlag(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    return E.leadlag(panel, weekly_edges(panel))


@register("x_volspill")
def x_volspill(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    return E.volatility_spillover(panel, weekly_edges(panel))


@register("x_confound_probe", f"WITH {SPILL_SQL}, {PROBE_ICS[0]} SELECT round(avg(ic) FILTER (signal = 'naive'), 5) + 0.0 AS naive_ic, round(avg(ic) FILTER (signal = 'innov'), 5) + 0.0 AS innov_ic FROM ({PROBE_ICS[1]})")
def x_confound_probe(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    return E.confound_probe(panel, weekly_edges(panel)).select(F.round("naive_ic", 5).alias("naive_ic"), F.round("innov_ic", 5).alias("innov_ic"))


@register("x_positive_controls")
def x_positive_controls(spark, sf_dir):
    return E.positive_controls(weeks(spark, sf_dir))


@register("x_liquidity")
def x_liquidity(spark, sf_dir):
    return E.liquidity_conditioning(months(spark, sf_dir), rows=12)


def _costs_sql():
    """The books of all controls, one table under another."""
    tables, rows = [], []
    for k, (name, lookback, horizon, sign, skip) in enumerate(E.CONTROLS):
        w, start = W_ASSET, lookback + skip
        signal = f"""signals AS (SELECT d, pos, asset, {sign} * (lag(px, {skip}) OVER {w}) / lag(px, {skip + lookback}) OVER {w}) - 1) AS sig, lead(px, {horizon}) OVER {w}) / px - 1 AS fwd, lead(pos, {horizon}) OVER {w}) AS ahead FROM panel),
picked AS (SELECT * FROM signals WHERE ahead IS NOT NULL AND pos >= {start} AND (pos - {start}) % {horizon} = 0)"""
        book = BOOK_SQL.replace("FROM signals", "FROM picked")
        net = "bn AS (SELECT gross, turnover, row_number() OVER (ORDER BY d) AS rn FROM book), nt AS (SELECT gross, turnover, c AS cost_bps, gross - turnover * c / 1e4 AS net FROM bn, (SELECT unnest([1.0, 5.0, 10.0]) :: DOUBLE AS c) WHERE rn > 1)"
        sql = f"{signal}, {book}, {net}"
        for n in ("signals", "picked", "pr", "pk", "pl", "pw", "pt", "book", "bn", "nt"):
            sql = re.sub(rf"\b{n}\b(?= AS \(| WHERE|\)|,| GROUP|$)", f"{n}_{k}", sql) if n in ("signals", "picked", "book", "bn", "nt") else re.sub(rf"\b{n}\b", f"{n}_{k}", sql)
        tables.append(sql)
        rows.append(f"""SELECT '{name}' AS signal, cost_bps, round(avg(gross) * 1e4, 4) AS gross_mean_bps, round(avg(turnover), 6) AS turnover, round(avg(gross) / nullif(avg(turnover), 0) * 1e4, 4) AS breakeven_bps,
round(avg(gross) / nullif(stddev_samp(gross), 0) * sqrt(252.0), 5) AS sharpe_gross, round(avg(net) * 1e4, 4) AS net_mean_bps, round(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252.0), 5) AS sharpe_net FROM nt_{k} GROUP BY cost_bps""")
    return f"WITH {BW}, {', '.join(tables)} {' UNION ALL '.join(rows)}"


@register("x_costs", _costs_sql())
def x_costs(spark, sf_dir):
    digits = {"gross_mean_bps": 4, "breakeven_bps": 4, "net_mean_bps": 4, "turnover": 6, "sharpe_gross": 5, "sharpe_net": 5}
    return E.cost_table(weeks(spark, sf_dir)).select("signal", "cost_bps", *[F.round(c, k).alias(c) for c, k in digits.items()])


@register("x_vol_robustness")
def x_vol_robustness(spark, sf_dir):
    return E.volatility_robustness(weeks(spark, sf_dir), P.brand_sectors(spark, sf_dir))


def public_links(spark, sf_dir, days):
    """d, src, dst, weight: co-holding links, both ways, of the latest snapshot that is public at each of `days` (d)."""
    h = P.holders(spark, sf_dir)
    edges = E.G.coholding_links(h.select(F.col("snapshot").alias("as_of"), "holder", "asset"))
    shown = E.G.asof_snapshot(days, h.select("public")).where("as_of IS NOT NULL").select("d", (F.year("as_of") - 1).alias("snapshot"))
    both = E.G.symmetrize(edges)
    return materialize(both.join(F.broadcast(shown), both["as_of"] == shown["snapshot"]).select("d", "src", "dst", "weight"), "links")


def study_books(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    return E.estimator_books(panel, public_links(spark, sf_dir, P.calendar(panel).select("d")))


@register("x_estimators")
def x_estimators(spark, sf_dir):
    return E.evaluate_estimators(study_books(spark, sf_dir))


@register("x_estimator_regimes")
def x_estimator_regimes(spark, sf_dir):
    return E.estimator_regimes(study_books(spark, sf_dir))


@register("x_temporal")
def x_temporal(spark, sf_dir):
    """The recurrent network with the graph and without."""
    panel = weeks(spark, sf_dir)
    scores = E.recurrent_scores(panel, weekly_edges(panel))
    ic = E.X.rank_ic(scores, "pred", "target", "graph", "d").select("graph", "d", F.col("ic").alias("x"))
    return E.scored(ic, "graph").select("graph", "mean_ic", "hac_t", "p", "n_dates")


@register("x_primary_endpoint")
def x_primary_endpoint(spark, sf_dir):
    return E.primary_endpoint(E.out_of_sample_ic(weeks(spark, sf_dir), P.brand_sectors(spark, sf_dir), ("correlation", "sector"), ("mlp", "gnn"), ("y_ret", "y_vol"), 5, 64, 5, 10, 20))


def coholding_edges(spark, sf_dir, panel):
    days = E.rebalances(panel, 64, 5).select(F.col("as_of").alias("d"))
    return public_links(spark, sf_dir, days).withColumnRenamed("d", "as_of")


@register("x_coholding")
def x_coholding(spark, sf_dir):
    """The lead-lag study over co-holding graphs, each from the day it is public."""
    panel = weeks(spark, sf_dir)
    return E.leadlag(panel, coholding_edges(spark, sf_dir, panel))


@register("x_coholding_volspill")
def x_coholding_volspill(spark, sf_dir):
    panel = weeks(spark, sf_dir)
    return E.volatility_spillover(panel, coholding_edges(spark, sf_dir, panel))


@register("x_spillover_psr")
def x_spillover_psr(spark, sf_dir):
    """How sure the controlled spillover over co-holdings is, with the dates that its series is worth."""
    panel = weeks(spark, sf_dir)
    return E.spillover_significance(panel, coholding_edges(spark, sf_dir, panel))


@register("x_coholding_planted")
def x_coholding_planted(spark, sf_dir):
    """The lead-lag study on a market whose returns follow those of co-held assets: it finds what was planted."""
    import numpy as np

    links = Y.holder_links((np.random.default_rng(5).random((40, 24)) < 0.2).astype(float))
    panel = materialize(P.with_returns(Y.to_panel(spark, Y.leadlag_market(links, 500))), "panel")
    days = [r["d"] for r in E.rebalances(panel, 64, 5).select(F.col("as_of").alias("d")).collect()]
    return E.leadlag(panel, materialize(Y.edges_of(spark, links, days), "edges"))


@register("gbm_predictions")
def gbm_predictions(spark, sf_dir):
    """Boosted trees on the supplier panel: fitted on the first 60 months, applied to the rest."""
    p = months(spark, sf_dir).select("pos", "asset", FE.performance(1).alias("a"), FE.performance(3).alias("b"), FE.forward_return(1).alias("y"))
    return M.boosted_trees(p.where("pos < 60"), p.where("pos >= 60 AND y IS NOT NULL"), ["a", "b"], "y").select("pos", "asset", "pred", "y")


@register("neighbour_features_asof")
def neighbour_features_asof(spark, sf_dir):
    """The data set of the ablation at every rebalance: nine standardised features and both labels."""
    panel = weeks(spark, sf_dir)
    at = asofs(panel)
    return E.build_dataset(panel, "correlation", at, P.brand_sectors(spark, sf_dir))
