"""End-to-end studies over a panel, a row a result: from features and graphs to scores, tests and books.

Everything up to the series of scores is a plan; the last step, a handful of rows, gets p-values and
detectable effects where a normal distribution or a simulation is needed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.functions import inference as I
from crossgrain.operators import features as FE
from crossgrain.operators import graphs as G
from crossgrain.operators import models as M
from crossgrain.operators import neighbours as N
from crossgrain.operators import portfolio as PF
from crossgrain.operators import resampling as RS
from crossgrain.operators import risk as R
from crossgrain.operators import splits as S
from crossgrain.sources import panels as P
from crossgrain.sources.scratch import materialize


def rebalances(panel: DataFrame, start: int, step: int) -> DataFrame:
    """as_of, as_of_pos of every `step`-th date from `start`."""
    return FE.sampled(P.calendar(panel), start, step).select(F.col("d").alias("as_of"), F.col("pos").alias("as_of_pos"))


def scored(ics: DataFrame, *by: str, family: tuple[str, ...] = (), excluded: str | None = None, intervals: bool = False) -> DataFrame:
    """by, mean_ic, hac_t, naive_t, p, n_dates, mde_80, q, fdr_sig of `ics` (by, d, x); `excluded` (a condition) names controls outside the family. With `intervals`, ci_lo and ci_hi of a block bootstrap."""
    ics = materialize(ics, "series")
    s = I.ic_summary(ics, "d", *by).join(I.ar1_phi(ics, "d", *by), [*by]).withColumn("p", I.two_sided_p_column(F.col("hac_t")))
    s = RS.with_detectable(s, "n_dates", "sd", "phi")
    columns = [*by, "mean_ic", "hac_t", "naive_t", "p", "n_dates", "mde_80"]
    if intervals:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in by])
        ci = RS.bootstrap_ci(ics.select(key.alias("key"), "d", "x"), "d", "key", block=5)
        s = s.withColumn("key", key).join(ci.select("key", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi")), "key", "left")
        columns += ["ci_lo", "ci_hi"]
    s = materialize(s.select(*columns), "scores")
    tested = s.where(f"NOT ({excluded})") if excluded else s
    tested = I.benjamini_hochberg(tested.withColumn("_family", F.concat_ws("|", F.lit(""), *family)), "p", 0.05, "_family").drop("_family")
    if excluded:
        tested = tested.unionByName(s.where(excluded).withColumns({"q": F.lit(None).cast("double"), "fdr_sig": F.lit(False)}))
    return tested.select(*columns, "q", "fdr_sig")


def seeded(ics: DataFrame, excluded: str) -> DataFrame:
    """edges, signal, mean_ic, seed_std and scores of `ics` (edges, signal, seed, d, x): means over seeds, tests of the first."""
    ics = materialize(ics, "series")
    means = ics.groupBy("edges", "signal", "seed").agg(F.avg("x").alias("m")).groupBy("edges", "signal").agg(F.avg("m").alias("mean_ic"), F.stddev_pop("m").alias("seed_std"))
    return means.join(scored(ics.where("seed = 0").drop("seed"), "edges", "signal", excluded=excluded).drop("mean_ic"), ["edges", "signal"])


def members_only(panel: DataFrame, membership: DataFrame | None) -> DataFrame:
    """`panel` less the assets that are never members."""
    return panel if membership is None else panel.join(membership.where("member").select("asset").distinct(), "asset", "left_semi")


def build_dataset(panel: DataFrame, kind: str, as_ofs: DataFrame, sectors: DataFrame, horizon: int = 5, window: int = 60, k: int = 10, month: int = 4, membership: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """d, pos, asset, nine standardised features, y_ret, y_vol at the rebalances; graph kind `none` has a neighbour feature of 0.

    With `membership` (d, asset, member), the cross-section of a date is its members: graphs, neighbours and standardisation
    have no other assets. `edges` stands for the graph of `kind` where it is at hand.
    """
    if membership is not None and kind == "frozen":
        raise ValueError("a frozen graph has assets that are no members yet")
    base = FE.base_features(panel, month=month).withColumns({"own": FE.trailing_return(5), "y_ret": FE.forward_return(horizon), "y_vol": FE.forward_log_vol(horizon)})
    rows = base.join(F.broadcast(as_ofs), base["pos"] == as_ofs["as_of_pos"])
    if kind == "none":
        if membership is not None:
            rows = rows.join(membership.where("member").select("d", "asset"), ["d", "asset"], "left_semi")
        rows = rows.withColumn("nbr_ret", F.lit(0.0))
    else:
        if edges is None:
            edges = G.make_graph(kind, members_only(panel, membership), as_ofs, sectors, window, k)
        if membership is not None:
            rows = rows.join(membership.where("member").select("d", "asset"), ["d", "asset"], "left_semi")
            for side in ("src", "dst"):
                edges = edges.join(membership.where("member").select(F.col("d").alias("as_of"), F.col("asset").alias(side)), ["as_of", side], "left_semi")
        nbr = N.neighbour_mean(edges, rows.select("as_of", "asset", "own"), "own").withColumnRenamed("nbr", "nbr_ret")
        rows = rows.join(nbr, ["as_of", "asset"], "left")
    features = [*FE.BASE_FEATURES, "nbr_ret"]
    return X.zscored(rows, features, "d").select("d", "pos", "asset", *features, "y_ret", "y_vol")


def rebalance_folds(as_ofs: DataFrame, horizon: int, step: int, n_test: int, min_train: int) -> DataFrame:
    """fold_id, role and pos (of the panel) over the numbered rebalances, purged for the label's horizon."""
    numbered = as_ofs.select(F.col("as_of").alias("d"), "as_of_pos", (F.row_number().over(W.orderBy("as_of_pos")) - 1).alias("pos"))
    folds = S.purged_walk_forward(numbered.select("d", "pos"), S.purge_steps(horizon, step), n_test, min_train=min_train)
    return folds.join(F.broadcast(numbered.select("d", "as_of_pos")), "d").select("fold_id", "role", F.col("as_of_pos").alias("pos"))


KINDS = ("none", "correlation", "sector", "both", "rewire")


def out_of_sample_ic(panel: DataFrame, sectors: DataFrame, kinds: tuple[str, ...], names: tuple[str, ...], targets: tuple[str, ...], horizon: int, start: int, step: int, n_test: int, min_train: int, k: int = 5) -> DataFrame:
    """graph, model, target, d, x: the rank correlation of purged walk-forward predictions at each test date."""
    as_ofs = materialize(rebalances(panel, start, step), "rebalances")
    folds = materialize(rebalance_folds(as_ofs, horizon, step, n_test, min_train), "folds")
    ics = None
    for kind in kinds:
        edges = materialize(G.make_graph(kind, panel, as_ofs, sectors, 60, k), "edges")
        data = materialize(build_dataset(panel, kind, as_ofs, sectors, horizon, edges=edges), "dataset")
        for target in targets:
            preds = M.model_walk_forward(data, edges, folds, names, [*FE.BASE_FEATURES, "nbr_ret"], target, S.purge_steps(horizon, step))
            ic = X.rank_ic(preds, "pred", "target", "model", "pos").select(F.lit(kind).alias("graph"), "model", F.lit(target).alias("target"), F.col("pos").alias("d"), F.col("ic").alias("x"))
            ics = ic if ics is None else ics.unionByName(ic)
    return materialize(ics, "series")


def ablation(panel: DataFrame, sectors: DataFrame, kinds: tuple[str, ...] = KINDS, names: tuple[str, ...] = tuple(M.MODELS), horizon: int = 5, start: int = 64, step: int = 5, n_test: int = 10, min_train: int = 20) -> DataFrame:
    """graph, model, target and scores of out-of-sample predictions of every model; families by target, null controls outside."""
    ics = out_of_sample_ic(panel, sectors, kinds, names, ("y_ret", "y_vol"), horizon, start, step, n_test, min_train)
    return scored(ics, "graph", "model", "target", family=("target",), excluded="graph IN ('rewire', 'random', 'none')", intervals=True)


def leadlag(panel: DataFrame, edges: DataFrame, lookback: int = 5, horizon: int = 5, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """edges, signal and scores of neighbours' trailing returns against the forward return, and against what own momentum leaves of it.

    `edges` has an as_of for each date to score; rewired edges are the null, own momentum alone the yardstick.
    """
    base = materialize(momenta(panel, lookback, horizon), "returns")
    ics = leadlag_series(base, edges, "real")
    for seed, s in enumerate(seeds):
        ics = ics.unionByName(leadlag_series(base, G.degree_preserving_rewire(edges, s), "rewire", seed))
    return seeded(ics, "edges <> 'real'")


def momenta(panel: DataFrame, lookback: int = 5, horizon: int = 5) -> DataFrame:
    """as_of, asset, own (trailing return) and fwd (forward return)."""
    return panel.select(F.col("d").alias("as_of"), "asset", FE.trailing_return(lookback).alias("own"), FE.forward_return(horizon).alias("fwd"))


def leadlag_series(base: DataFrame, edges: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """edges, signal, seed, d, x: the lead-lag signal against the forward return and against what own momentum leaves of it and, for real edges, own momentum."""
    sig = N.weighted_neighbour_mean(edges, base, "own").withColumnRenamed("nbr", "sig").join(base, ["as_of", "asset"])
    sig = materialize(sig.withColumn("left", FE.residual("fwd", "own", "as_of")), "signals")
    return _series(sig, [(kind, "leadlag", "sig", "fwd"), (kind, "leadlag_resid", "sig", "left"), *([("none", "own_mom", "own", "fwd")] if kind == "real" else [])], seed)


def _series(sig: DataFrame, pairs: list[tuple[str, str, str, str]], seed: int) -> DataFrame:
    """edges, signal, seed, d, x: for each (edges, signal, value, label) of `pairs` the rank correlation by date."""
    ics = None
    for edges, name, value, label in pairs:
        ic = X.rank_ic(sig, value, label, "as_of").select(F.lit(edges).alias("edges"), F.lit(name).alias("signal"), F.lit(seed).alias("seed"), F.col("as_of").alias("d"), F.col("ic").alias("x"))
        ics = ic if ics is None else ics.unionByName(ic)
    return ics


def volatilities(panel: DataFrame, short: int, level: int, horizon: int) -> DataFrame:
    """as_of, asset, own_s and own_l (deviations of the last `short` and `level` returns), innov (their difference) and fwd (that of the next `horizon`); NULL where a return is missing."""
    ahead = W.partitionBy("asset").orderBy("pos").rowsBetween(1, horizon)
    vols = panel.withColumns({"own_s": FE.trailing_vol(short), "own_l": FE.trailing_vol(level), "fwd": F.when(F.count("ret").over(ahead) == horizon, F.stddev_samp("ret").over(ahead))})
    return vols.select(F.col("d").alias("as_of"), "asset", "own_s", "own_l", (F.col("own_s") - F.col("own_l")).alias("innov"), "fwd")


def volatility_spillover(panel: DataFrame, edges: DataFrame, short: int = 20, level: int = 60, horizon: int = 5, seeds: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """edges, signal and scores of neighbours' volatility innovations against the volatility to come, and against what own short and long volatility leave of it."""
    base = materialize(volatilities(panel, short, level, horizon), "volatility")
    ics = spillover_series(base, edges, "real")
    for seed, s in enumerate(seeds):
        ics = ics.unionByName(spillover_series(base, G.degree_preserving_rewire(edges, s), "rewire", seed))
    return seeded(ics, "edges <> 'real'")


def spillover_series(base: DataFrame, edges: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """edges, signal, seed, d, x: neighbours' innovations against the volatility to come and against what own volatilities leave of it and, for real edges, own short volatility."""
    sig = N.present_neighbour_mean(edges, base, "innov").withColumnRenamed("nbr", "sig").join(base, ["as_of", "asset"])
    sig = materialize(sig.withColumn("left", FE.residual_of_two("fwd", "own_s", "own_l", "as_of")), "signals")
    return _series(sig, [(kind, "spill_raw", "sig", "fwd"), (kind, "spill_resid", "sig", "left"), *([("none", "own_vol", "own_s", "fwd")] if kind == "real" else [])], seed)


def spillover_significance(panel: DataFrame, edges: DataFrame, short: int = 20, level: int = 60, horizon: int = 5) -> DataFrame:
    """key, mean_ic, n, t_eff, ic_psr of the controlled spillover: the chance that its mean is above 0, with the dates that a correlated series is worth."""
    base = volatilities(panel, short, level, horizon)
    sig = N.present_neighbour_mean(edges, base, "innov").withColumnRenamed("nbr", "sig").join(base, ["as_of", "asset"]).withColumn("left", FE.residual_of_two("fwd", "own_s", "own_l", "as_of"))
    ic = X.rank_ic(sig, "sig", "left", "as_of").select(F.lit("spill_resid").alias("key"), F.col("as_of").alias("d"), F.col("ic").alias("x"))
    return PF.series_significance(materialize(ic, "series"), "d", "key")


def confound_probe(panel: DataFrame, edges: DataFrame, short: int = 20, level: int = 60, horizon: int = 5) -> DataFrame:
    """naive_ic, innov_ic: neighbours' level of volatility with own short volatility taken out of the label still picks up fixed differences; their innovation, with both taken out, does not."""
    base = materialize(volatilities(panel, short, level, horizon), "volatility")

    def mean_ic(value, control, name):
        sig = N.present_neighbour_mean(edges, base, value).join(base, ["as_of", "asset"]).withColumn("left", control)
        return X.rank_ic(sig, "nbr", "left", "as_of").agg(F.avg("ic").alias(name))

    naive = mean_ic("own_s", FE.residual("fwd", "own_s", "as_of"), "naive_ic")
    return naive.join(F.broadcast(mean_ic("innov", FE.residual_of_two("fwd", "own_s", "own_l", "as_of"), "innov_ic")))


#: name, lookback, horizon, sign, skip.
CONTROLS = (("reversal_1d", 1, 1, -1, 0), ("reversal_1w", 5, 5, -1, 0), ("momentum_12_1", 48, 4, 1, 4))


def positive_controls(panel: DataFrame, specs: tuple = CONTROLS) -> DataFrame:
    """signal, scores and turnover of known anomalies; all are one family."""
    ics = turns = None
    for name, lookback, horizon, sign, skip in specs:
        sp = materialize(FE.signal_panel(panel, lookback, horizon, sign, skip), "signals")
        ic = X.rank_ic(sp, "sig", "fwd", "d").select(F.lit(name).alias("signal"), "d", F.col("ic").alias("x"))
        turn = PF.rank_turnover(sp).agg(F.avg("turnover").alias("turnover")).select(F.lit(name).alias("signal"), "turnover")
        ics, turns = (ic, turn) if ics is None else (ics.unionByName(ic), turns.unionByName(turn))
    return scored(ics, "signal").join(turns, "signal")


def liquidity_conditioning(panel: DataFrame, groups: int = 3, rows: int = 20, lookback: int = 1, horizon: int = 1) -> DataFrame:
    """label and scores of the reversal within buckets of liquidity, and of the difference of the first and last."""
    df = panel.select("d", "pos", "asset", FE.signal(lookback, -1).alias("sig"), FE.forward_return(horizon).alias("fwd"), FE.liquidity(rows).alias("liq"))
    df = FE.sampled(df.where("fwd IS NOT NULL"), rows, horizon).withColumn("bucket", X.percent_bucket("liq", groups, "d")).where("bucket IS NOT NULL")
    ic = materialize(X.rank_ic(df, "sig", "fwd", "d", "bucket"), "series")
    label = F.when(F.col("bucket") == 0, "least liquid").when(F.col("bucket") == groups - 1, "most liquid").otherwise(F.concat(F.lit("mid "), F.col("bucket").cast("string")))
    each = ic.select(label.alias("label"), "d", F.col("ic").alias("x"))
    low, high = ic.where("bucket = 0").select("d", F.col("ic").alias("a")), ic.where(f"bucket = {groups - 1}").select("d", F.col("ic").alias("b"))
    return scored(each.unionByName(low.join(high, "d").select(F.lit("low - high").alias("label"), "d", (F.col("a") - F.col("b")).alias("x"))), "label")


def cost_table(panel: DataFrame, specs: tuple = CONTROLS) -> DataFrame:
    """signal and the cost summary of its long-short book."""
    out = None
    for name, lookback, horizon, sign, skip in specs:
        one = PF.cost_summary(PF.longshort_book(FE.signal_panel(panel, lookback, horizon, sign, skip))).withColumn("signal", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def volatility_robustness(panel: DataFrame, sectors: DataFrame, horizon: int = 5, start: int = 64, step: int = 5) -> DataFrame:
    """ic_model, ic_naive, qlike_model, qlike_naive, n_obs, n_dates: ridge against the last volatility."""
    as_ofs = rebalances(panel, start, step)
    data = build_dataset(panel, "correlation", as_ofs, sectors, horizon)
    preds = M.ridge_walk_forward(data, rebalance_folds(as_ofs, horizon, step, 10, 20), [*FE.BASE_FEATURES, "nbr_ret"], "y_vol")
    naive = panel.select("pos", "asset", FE.trailing_vol(20).alias("v")).select("pos", "asset", F.when(F.col("v") > 0, F.ln(F.col("v") * F.sqrt(F.lit(252.0)))).alias("naive"))
    both = materialize(preds.join(naive, ["pos", "asset"]).where("pred IS NOT NULL AND naive IS NOT NULL AND target IS NOT NULL"), "predictions")
    mean_ic = lambda c: X.rank_ic(both, c, "target", "pos").agg(F.avg("ic").alias(f"ic_{c}"), F.count("*").alias(f"n_{c}"))
    variance = both.select(*[F.exp(2 * F.col(c)).alias(c) for c in ("pred", "naive", "target")])
    q = lambda c: I.qlike(variance, "target", c).select(F.col("qlike").alias(f"qlike_{c}"), F.col("n").alias(f"obs_{c}"))
    row = mean_ic("pred").join(mean_ic("naive")).join(q("pred")).join(q("naive"))
    return row.select(F.col("ic_pred").alias("ic_model"), "ic_naive", F.col("qlike_pred").alias("qlike_model"), "qlike_naive", F.col("obs_pred").alias("n_obs"), F.col("n_pred").alias("n_dates"))


def book_periods(panel: DataFrame, window: int, period: str = "month") -> list[tuple[int, int]]:
    """(start, stop) positions of the books of a calendar: from the last date of each period that has `window` dates before it to that of the next. A few hundred numbers at any scale."""
    last = [r["pos"] for r in FE.last_date_of(P.calendar(panel), period).orderBy("pos").collect()]
    return [(a, b) for a, b in zip(last, last[1:]) if a >= window]


def estimator_rows(panel: DataFrame, periods: list[tuple[int, int]], window: int) -> DataFrame:
    """rebalance, phase, pos, asset, ret: rows [start - window, start) to estimate and [start, stop) to hold, complete cases."""
    spread = [(k, "estimate" if p < a else "hold", p) for k, (a, b) in enumerate(periods) for p in range(a - window, b)]
    rows = panel.join(F.broadcast(panel.sparkSession.createDataFrame(spread, "rebalance int, phase string, pos int")), "pos").select("rebalance", "phase", "pos", "asset", "ret")
    return R.complete_case(rows, "rebalance")


REWIRES = (0, 1, 2)
#: (estimator of the study, kernel, graph).
STUDY_BOOKS = (
    ("sample", "sample", None), ("diagonal", "diagonal", None), ("ledoit_wolf", "ledoit_wolf", None), ("masked_correlation", "masked", "correlation"),
    ("masked_coholding", "masked", "coholding"), ("glasso_coholding", "glasso", "coholding"), *((f"rewire{s}", "masked", f"rewire{s}") for s in REWIRES),
)


def estimator_books(panel: DataFrame, coholding: DataFrame, window: int = 104, corr_window: int = 60, k: int = 5) -> DataFrame:
    """The books of every estimator at every month of the calendar past the window; `coholding`: d, src, dst of the links that are public at d."""
    spark, periods = panel.sparkSession, book_periods(panel, window)
    at = spark.createDataFrame([(i, a, a - 1) for i, (a, _) in enumerate(periods)], "as_of int, start int, as_of_pos int")
    knn = G.correlation_knn(panel, at.select("as_of", "as_of_pos"), corr_window, k).select("as_of", "src", "dst", "weight")
    days = P.calendar(panel).join(F.broadcast(at.select("as_of", F.col("start").alias("pos"))), "pos").select("as_of", "d")
    held = G.symmetrize(coholding.join(F.broadcast(days), "d").select("as_of", "src", "dst", "weight"))
    graphs = {"correlation": knn, "coholding": held} | {f"rewire{s}": G.degree_preserving_rewire(held, s) for s in REWIRES}
    edges = None
    for name, graph in graphs.items():
        one = G.dense_adjacency(graph).select(F.col("as_of").alias("rebalance"), F.lit(name).alias("graph"), "i", "j")
        edges = one if edges is None else edges.unionByName(one)
    return materialize(R.rolling_gmvp(estimator_rows(panel, periods, window), edges, STUDY_BOOKS), "books")


def evaluate_estimators(books: DataFrame) -> DataFrame:
    """estimator, realized_vol, qlike, vol_vs_lw_ratio, paired_t_vs_lw, ci_lo, ci_hi, mde of `estimator_books`; the rewired graphs are one null row."""
    real = books.where("NOT startswith(estimator, 'rewire')")
    vol = R.realized_vol(books, "estimator")
    per = real.groupBy("estimator", "rebalance").agg(F.avg(F.col("r") * F.col("r")).alias("realized"), F.max("fvar").alias("fvar"))
    lw = books.where("estimator = 'ledoit_wolf'").select("rebalance", "pos", F.col("r").alias("b"))
    diff = materialize(R.paired_squared_difference(real.withColumnRenamed("r", "a").join(lw, ["rebalance", "pos"]), "a", "b", "estimator").select("estimator", "pos", "x"), "differences")
    t = I.newey_west(diff, "pos", "estimator").select("estimator", F.col("n").alias("n_diff"), F.col("t").alias("paired_t_vs_lw"))
    t = t.join(diff.groupBy("estimator").agg(F.stddev_samp("x").alias("sd")), "estimator").join(I.ar1_phi(diff, "pos", "estimator"), "estimator")
    t = RS.with_detectable(t, "n_diff", "sd", "phi", "mde", n_sims=300, least_sd=1e-12, scale_cap=True)
    ci = RS.bootstrap_ci(diff, "pos", "estimator", block=3).select("estimator", F.col("lo").alias("ci_lo"), F.col("hi").alias("ci_hi"))
    base = vol.where("estimator = 'ledoit_wolf'").select(F.col("realized_vol").alias("base"))
    out = vol.where("NOT startswith(estimator, 'rewire')").join(I.qlike(per, "realized", "fvar", "estimator").select("estimator", "qlike"), "estimator").join(t, "estimator").join(ci, "estimator")
    none = F.lit(None).cast("double")
    null = vol.where("startswith(estimator, 'rewire')").agg(F.lit("rewire_coholding").alias("estimator"), F.avg("realized_vol").alias("realized_vol"))
    null = null.select("estimator", "realized_vol", *[none.alias(c) for c in ("qlike", "paired_t_vs_lw", "ci_lo", "ci_hi", "mde")])
    both = out.select("estimator", "realized_vol", "qlike", "paired_t_vs_lw", "ci_lo", "ci_hi", "mde").unionByName(null).join(F.broadcast(base))
    return both.select("estimator", "realized_vol", "qlike", (F.col("realized_vol") / F.col("base")).alias("vol_vs_lw_ratio"), "paired_t_vs_lw", "ci_lo", "ci_hi", "mde")


def estimator_regimes(books: DataFrame, graph: str = "glasso_coholding", bench: str = "ledoit_wolf") -> DataFrame:
    """log_high, log_low, spread, n_high, n_low: log variance of the graph's books over the benchmark's where the pair correlation before a rebalance is at least its median, and elsewhere."""
    corr = books.groupBy("rebalance").agg(F.max("avg_corr").alias("corr"))
    high = corr.join(F.broadcast(corr.agg(F.median("corr").alias("cut")))).select("rebalance", (F.col("corr") >= F.col("cut")).alias("high"))
    a = books.where(F.col("estimator") == bench).select("rebalance", "pos", F.col("r").alias("a"))
    b = books.where(F.col("estimator") == graph).select("rebalance", "pos", F.col("r").alias("b"))
    both = materialize(a.join(b, ["rebalance", "pos"]).join(F.broadcast(high), "rebalance"), "regimes")
    return R.regime_spread(both, "a", "b", "high").join(F.broadcast(both.agg(F.count_if("high").alias("n_high"), F.count_if(~F.col("high")).alias("n_low"))))


def recurrent_scores(panel: DataFrame, edges: DataFrame, lookbacks: tuple[int, ...] = (5, 20, 60), horizon: int = 5, step: int = 5, share: float = 0.65, seed: int = 0) -> DataFrame:
    """graph, d, asset, pred, target out of sample of a graph recurrent network with the graph and without.

    A network over time is one sequence, so each of the two is one task; features, graphs and scores are plans. The
    assets of a date without a value stand in it with zeros and no target. `edges` has an as_of for each date to use.
    """
    names = [f"ret_{n}" for n in lookbacks]
    rows = FE.feature_frame(panel, lookbacks).join(panel.select("d", "asset", FE.forward_return(horizon).alias("y")), ["d", "asset"])
    rows = rows.join(F.broadcast(edges.select(F.col("as_of").alias("d")).distinct()), "d", "left_semi")
    both = rows.crossJoin(F.broadcast(panel.sparkSession.createDataFrame([("none",), ("graph",)], "graph string")))
    links = edges.select(F.lit("graph").alias("graph"), "as_of", "src", "dst")
    gap = S.purge_steps(horizon, step)

    def trained(key, rows, links):
        assets = sorted(rows["asset"].unique())
        of, none, table = dict(tuple(links.groupby("as_of"))), links.iloc[:0], []
        for d, day in rows.groupby("d", sort=True):
            day = day.set_index("asset").reindex(assets)
            table.append((d, day[names].fillna(0.0).to_numpy(float), M.aggregation_of(assets, of.get(d, none)), day["y"].to_numpy(float)))
        cut = int(len(table) * share)
        net = M.GraphRecurrentNetwork(len(names), seed=seed).fit([(x, a, y) for _, x, a, y in table[: max(1, cut - gap)]], gap=gap)
        scores, out = net.unroll([(x, a) for _, x, a, _ in table])[0], []
        for (d, _, _, y), s in list(zip(table, scores, strict=True))[cut:]:
            out += [(key[0], d, n, float(p), None if t != t else float(t)) for n, p, t in zip(assets, s, y, strict=True)]
        return pd.DataFrame(out, columns=["graph", "d", "asset", "pred", "target"])

    kind = rows.schema["asset"].dataType.simpleString()
    out = both.groupBy("graph").cogroup(links.groupBy("graph")).applyInPandas(trained, f"graph string, d date, asset {kind}, pred double, target double")
    return out.withColumn("target", F.nanvl("target", F.lit(None).cast("double")))


def primary_endpoint(ics: DataFrame) -> DataFrame:
    """graph, target, ic_gnn, ic_mlp, delta_ic, hac_t, p, ci_lo, ci_hi, mde_80, n_dates: the network with messages less the one without, date by date, over `ics` (graph, model, target, d, x)."""
    by = ["graph", "target"]
    a, b = ics.where("model = 'gnn'").select(*by, "d", F.col("x").alias("g")), ics.where("model = 'mlp'").select(*by, "d", F.col("x").alias("m"))
    pair = materialize(a.join(b, [*by, "d"]).where("g IS NOT NULL AND m IS NOT NULL"), "pairs")
    s = scored(pair.select(*by, "d", (F.col("g") - F.col("m")).alias("x")), *by, intervals=True).withColumnRenamed("mean_ic", "delta_ic")
    means = pair.groupBy(*by).agg(F.avg("g").alias("ic_gnn"), F.avg("m").alias("ic_mlp"))
    return means.join(s, by).select(*by, "ic_gnn", "ic_mlp", "delta_ic", "hac_t", "p", "ci_lo", "ci_hi", "mde_80", "n_dates")
