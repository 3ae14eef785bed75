"""Registered queries that are seeded kernels: no SQL says the same, so tests hold them to their properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from crossgrain.functions import inference as I
from crossgrain.operators import graphs as G
from crossgrain.operators import resampling as RS
from crossgrain.operators import synthetic as Y
from crossgrain.plans import experiments as E
from crossgrain.plans.catalog import register
from crossgrain.plans.graph_queries import knn
from crossgrain.plans.panel_queries import ic_frame, weeks
from crossgrain.sources.scratch import materialize


@register("rewire_null")
def rewire_null(spark, sf_dir):
    return G.degree_preserving_rewire(knn(spark, sf_dir), 0)


@register("block_bootstrap_ci")
def block_bootstrap_ci(spark, sf_dir):
    return RS.bootstrap_ci(ic_frame(spark, sf_dir), "d", "key", block=6)


@register("iid_bootstrap_ci")
def iid_bootstrap_ci(spark, sf_dir):
    return RS.bootstrap_ci(ic_frame(spark, sf_dir), "d", "key")


@register("power_mde")
def power_mde(spark, sf_dir):
    """For series like the reversal's: effects and how often they are found, and the least effect found in 80 % of simulations."""
    s = ic_frame(spark, sf_dir)
    r = s.where("x IS NOT NULL").agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sd")).join(I.ar1_phi(s, "d", "key")).first()
    curve = RS.PowerCurve(r["n"], r["sd"], r["phi"])
    mde = curve.detectable()
    return spark.createDataFrame([(float(e), curve.power(e), mde) for e in (0.0, 0.02, 0.05, 0.1, mde)], "effect double, power double, mde double")


@register("gmvp_rolling")
def gmvp_rolling(spark, sf_dir):
    """Minimum-variance books of five estimators at every month past the window, graph-masked and graphical-lasso covariances among them."""
    panel = materialize(weeks(spark, sf_dir), "panel")
    periods = E.book_periods(panel, 104)
    at = spark.createDataFrame([(k, a - 1) for k, (a, _) in enumerate(periods)], "as_of int, as_of_pos int")
    edges = G.dense_adjacency(G.correlation_knn(panel, at, 60, 5)).select(F.col("as_of").alias("rebalance"), F.lit("correlation").alias("graph"), "i", "j")
    return E.R.rolling_gmvp(E.estimator_rows(panel, periods, 104), edges)


@register("synth_factor_market")
def synth_factor_market(spark, sf_dir):
    return Y.to_panel(spark, Y.factor_market(300, 24, 4))


@register("synth_spatial_arch")
def synth_spatial_arch(spark, sf_dir):
    return Y.to_panel(spark, Y.spatial_arch(Y.block_edges(24, 4), 300))


@register("synth_leadlag")
def synth_leadlag(spark, sf_dir):
    return Y.to_panel(spark, Y.leadlag_market(Y.block_edges(24, 4), 300))


@register("synth_block_market")
def synth_block_market(spark, sf_dir):
    return Y.to_panel(spark, Y.block_market())


@register("synth_noise_market")
def synth_noise_market(spark, sf_dir):
    return Y.to_panel(spark, Y.noise_market())
