import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.operators import features as FE
from crossgrain.operators import models as M
from crossgrain.operators import risk as R
from crossgrain.operators import synthetic as Y
from crossgrain.plans import experiments as E
from crossgrain.sources import panels as P


def test_gmvp_weights():
    assert R.gmvp_weights(np.diag([0.04, 0.01])) == pytest.approx([0.2, 0.8])
    assert R.gmvp_weights(np.ones((2, 2))).sum() == pytest.approx(1)


def test_shrinkage_kernel_equals_plan(spark):
    x = np.random.default_rng(0).normal(0, 0.01, (40, 6)) + np.random.default_rng(1).normal(0, 0.01, 40)[:, None]
    rows = spark.createDataFrame([(1, t, j, float(x[t, j])) for t in range(40) for j in range(6)], "g int, pos int, asset int, ret double")
    pairs = R.pair_moments(rows, "g")
    cov, delta = R.lw_constant_correlation(x)
    assert R.ledoit_wolf_shrinkage(pairs, "g").first()["delta"] == pytest.approx(delta)
    for r in R.ledoit_wolf_cov(pairs, "g").collect():
        assert r["cov"] == pytest.approx(cov[r["i"], r["j"]])


def test_complete_case_drops_dates(spark):
    rows = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "b", None), (1, 1, "a", 1.0), (1, 1, "b", 2.0)], "g int, pos int, asset string, ret double")
    assert {r["pos"] for r in R.complete_case(rows, "g").collect()} == {1}
    with pytest.raises(ValueError):
        R.sample_cov(np.array([[1.0, np.nan], [1.0, 2.0]]))


def test_masked_and_glasso_are_positive():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.01, (120, 30)) + 0.02 * rng.normal(size=120)[:, None]
    ring = np.zeros((30, 30), bool)
    for i in range(30):
        ring[i, (i + 1) % 30] = ring[(i + 1) % 30, i] = True
    for cov in (R.graph_masked_cov(x, ring), R.graph_glasso(x, ring), R.graph_glasso(x, ring, max_steps=1)):
        assert np.linalg.eigvalsh(cov).min() > 0 and cov == pytest.approx(cov.T)


def test_identity_shrinkage_of_noise():
    x = np.random.default_rng(3).normal(0, 1, (60, 20))
    cov = R.lw_identity(x)
    off = cov - np.diag(np.diag(cov))
    assert np.abs(off).max() < 0.2 and np.trace(cov) == pytest.approx(np.trace(np.cov(x.T, bias=True)))


def test_ridge_equals_direct_solution(spark):
    rng = np.random.default_rng(4)
    x, e = rng.normal(size=(200, 3)), rng.normal(size=200)
    y = x @ [1.0, -2.0, 0.5] + 3 + e
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    beta, c = M.ridge_solution(M.ridge_gram(df, ["a", "b", "c"], "y").first().asDict(), 3, 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    assert beta == pytest.approx(np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc)) and c == pytest.approx(y.mean() - x.mean(0) @ beta)


def test_network_gradients_are_right():
    rng = np.random.default_rng(5)
    net, x, a, t = M.SageNetwork(3, 5, 0), rng.normal(size=(6, 3)), M.mean_aggregation(np.array([[0, 1, 2], [1, 2, 3]]), 6), rng.normal(size=6)
    loss = lambda: ((net.forward(x, a)[0] - t) ** 2).sum()
    y, kept = net.forward(x, a)
    for p, g in zip(net.params, net.gradients(kept, 2 * (y - t)), strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        down = loss()
        p[at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-5)


def test_soft_spearman_gradient_and_limits():
    rng = np.random.default_rng(6)
    p, t = rng.normal(size=7), rng.normal(size=7)
    g, i = M.soft_spearman_gradient(p, t, 0.5), 3
    up, down = p.copy(), p.copy()
    up[i] += 1e-6
    down[i] -= 1e-6
    assert (M.soft_spearman(up, t, 0.5) - M.soft_spearman(down, t, 0.5)) / 2e-6 == pytest.approx(g[i], rel=1e-3, abs=1e-6)
    assert M.soft_spearman(t, t) == pytest.approx(0, abs=1e-9) and M.soft_spearman(p[:2], t[:2]) == 0
    with pytest.raises(ValueError):
        M.build_model("nope")


def planted(spark, returns, links, start=60, step=6):
    panel = P.with_returns(Y.to_panel(spark, returns)).cache()
    days = [r["as_of"] for r in E.rebalances(panel, start, step).collect()]
    return panel, Y.edges_of(spark, links, days)


def test_planted_leadlag_is_found_and_the_null_is_not(spark):
    links = Y.block_edges(24, 4)
    panel, edges = planted(spark, Y.leadlag_market(links, 500, beta=0.4), links)
    got = {(r["edges"], r["signal"]): r for r in E.leadlag(panel, edges).collect()}
    for signal in ("leadlag", "leadlag_resid"):
        assert got["real", signal]["hac_t"] > 3 and got["real", signal]["fdr_sig"] and got["real", signal]["mean_ic"] > got["real", signal]["mde_80"]
        assert abs(got["rewire", signal]["mean_ic"]) < got["real", signal]["mean_ic"] / 2 and got["rewire", signal]["q"] is None
    assert got["rewire", "leadlag"]["seed_std"] > 0 and got["none", "own_mom"]["q"] is None and not got["none", "own_mom"]["fdr_sig"]


def test_spillover_control_and_confound(spark):
    """Planted spillover stays after own volatilities are taken out of the label; on a market with levels alone the innovation shows nothing."""
    links = Y.block_edges(24, 4)
    panel, edges = planted(spark, Y.spatial_arch(links, 700), links, start=70)
    got = {(r["edges"], r["signal"]): r for r in E.volatility_spillover(panel, edges).collect()}
    assert got["none", "own_vol"]["mean_ic"] > 0 and got["real", "spill_resid"]["n_dates"] > 80 and set(got) == {(e, s) for e in ("real", "rewire") for s in ("spill_raw", "spill_resid")} | {("none", "own_vol")}
    panel, edges = planted(spark, Y.spatial_arch(links, 700, 0.05, 0.5, 0.0, spread=1.0, blocks=4), links, start=70)
    probe = E.confound_probe(panel, edges).first()
    assert probe["naive_ic"] > 0.1 and abs(probe["innov_ic"]) < probe["naive_ic"] / 2


def test_recurrent_gradients_are_right():
    rng = np.random.default_rng(7)
    net = M.GraphRecurrentNetwork(3, 4, 1)
    days = [(rng.normal(size=(5, 3)), M.mean_aggregation(np.array([[0, 1, 2], [1, 2, 3]]), 5)) for _ in range(4)]
    targets = [rng.normal(size=5) for _ in days]
    loss = lambda: sum(((y - t) ** 2).sum() for y, t in zip(net.unroll(days)[0], targets, strict=True))
    scores, kept = net.unroll(days)
    for p, g in zip(net.params, net.gradients(kept, [2 * (y - t) for y, t in zip(scores, targets, strict=True)]), strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-6
        up = loss()
        p[at] = old - 1e-6
        down = loss()
        p[at] = old
        assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-5)


@pytest.mark.parametrize("name", sorted(M.MODELS))
def test_models_learn_ranks(name):
    rng = np.random.default_rng(8)
    make = lambda n: [(x, np.eye(20), x[:, 0] - 0.5 * x[:, 1] + rng.normal(0, 0.3, 20)) for x in rng.normal(size=(n, 20, 3))]
    model = M.build_model(name).fit(make(40), 1)
    assert np.mean([np.corrcoef(model.predict(x, a), t)[0, 1] for x, a, t in make(10)]) > 0.7


def test_sparse_precision_is_optimal():
    """The optimality conditions: on zeros the gradient is within the penalty, elsewhere it is the penalty; without one, the inverse."""
    rng = np.random.default_rng(9)
    s = np.corrcoef(rng.normal(size=(200, 8)) + rng.normal(size=(200, 1)), rowvar=False)
    p = R.sparse_precision(s, np.full((8, 8), 0.1), 5000, 1e-7)
    ridge = s + 1e-3 * np.trace(s) / 8 * np.eye(8)
    off = ~np.eye(8, dtype=bool)
    g = ridge - np.linalg.inv(p)
    assert np.abs(np.diag(g)).max() < 1e-3 and (np.abs(g[off]) <= 0.1 + 1e-3).all()
    assert np.abs(g[off & (p != 0)] + 0.1 * np.sign(p[off & (p != 0)])).max() < 1e-3
    assert R.sparse_precision(s, np.zeros((8, 8)), 5000, 1e-7) == pytest.approx(np.linalg.inv(ridge), rel=1e-2, abs=1e-2)


def test_true_blocks_are_the_better_mask():
    """Of a covariance of blocks, the estimate masked by the blocks is nearer to the truth than one masked by other pairs."""
    same = Y.block_edges(20, 4) > 0
    truth = 1e-4 * (0.7 * (same | np.eye(20, dtype=bool)) + 0.3 * np.eye(20))
    other = np.random.default_rng(1).permutation(20)
    wrong = same[np.ix_(other, other)]
    error = lambda x, a: np.linalg.norm(R.graph_masked_cov(x, a, 0.5) - truth)
    assert all(error(x, same) < error(x, wrong) for x in (Y.block_market(60, 4, 5, seed=k) for k in range(5)))


def test_estimator_study_on_blocks(spark):
    panel = P.with_returns(Y.to_panel(spark, Y.block_market(400, 4, 5))).cache()
    days = [r["d"] for r in P.calendar(panel).collect()]
    same = Y.block_edges(20, 4)
    books = E.estimator_books(panel, Y.edges_of(spark, same, days).withColumnRenamed("as_of", "d"), window=60)
    got = {r["estimator"]: r for r in E.evaluate_estimators(books).collect()}
    assert set(got) == {"sample", "diagonal", "ledoit_wolf", "masked_correlation", "masked_coholding", "glasso_coholding", "rewire_coholding"}
    assert got["glasso_coholding"]["vol_vs_lw_ratio"] < 1.05 and got["rewire_coholding"]["qlike"] is None and got["sample"]["mde"] > 0
    row = E.estimator_regimes(books).first()
    assert row["n_high"] > 0 and row["n_low"] > 0 and row["spread"] == pytest.approx(row["log_high"] - row["log_low"])


def test_membership_limits_the_cross_section(spark):
    panel = P.with_returns(Y.to_panel(spark, Y.factor_market(160, 12, 3))).cache()
    members = panel.select("d", "asset", ((F.col("pos") >= 100) | (F.col("asset") < "A008")).alias("member"))
    at = E.rebalances(panel, 80, 40)
    sectors = Y.sector_table(spark, 12, 3)
    got = {r["pos"]: r["n"] for r in E.build_dataset(panel, "sector", at, sectors, k=3, membership=members).groupBy("pos").agg(F.count("*").alias("n")).collect()}
    assert got == {80: 8, 120: 12}
    with pytest.raises(ValueError):
        E.build_dataset(panel, "frozen", at, sectors, membership=members)


def test_planted_reversal_and_random_walk(spark):
    spec = (("reversal_1d", 1, 1, -1, 0),)
    on, off = (E.positive_controls(P.with_returns(Y.to_panel(spark, Y.reverting_market(250, 30, phi))), spec).first() for phi in (-0.3, 0.0))
    assert on["hac_t"] > 3 and on["fdr_sig"] and abs(off["hac_t"]) < 3


def test_future_injection_is_caught(spark):
    from crossgrain.functions import cross_section as X

    p = P.with_returns(Y.to_panel(spark, Y.factor_market(60, 12, 3))).select("d", FE.forward_return(1).alias("y"))
    ic = X.rank_ic(p.withColumn("leak", F.col("y") * 2 + 1), "leak", "y", "d").where("ic IS NOT NULL")
    assert ic.agg(F.min("ic")).first()[0] > 0.999


def test_spatial_arch_needs_stationarity():
    with pytest.raises(ValueError):
        Y.spatial_arch(Y.block_edges(8, 2), 10, 0.5, 0.5, 0.5)
    assert Y.business_days(3, "2024-01-05") == [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]
