import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.functions import cross_section as X
from crossgrain.functions import inference as I
from crossgrain.operators import portfolio as PF
from crossgrain.operators import resampling as RS


def test_average_rank_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "d int, x double").withColumn("r", X.average_rank("x", "d"))
    assert sorted((r["x"], r["r"]) for r in df.where("x IS NOT NULL").collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5)]
    assert df.where("x IS NULL").first()["r"] is None


def test_rank_ic_degenerate_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (2, 1.0, 2.0), (2, 1.0, 3.0), (3, 1.0, 3.0), (3, 2.0, 2.0), (3, 3.0, 1.0)], "d int, p double, t double")
    got = {r["d"]: r["ic"] for r in X.rank_ic(df, "p", "t", "d").collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(-1.0)


def test_normalisation_is_shift_and_scale_invariant(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(x)) for x in rng.normal(size=20)]
    df = spark.createDataFrame(rows, "d int, a double").withColumns({"b": F.col("a") * 3 + 7, "c": F.lit(None).cast("double"), "k": F.lit(2.0)})
    for z in X.zscored(df, ["a", "b", "c", "k"], "d").collect():
        assert z["a"] == pytest.approx(z["b"]) and z["c"] == 0 and z["k"] == 0


def test_hac_equals_kernel_and_controls_size(spark):
    rng = np.random.default_rng(1)
    x = np.empty(400)
    x[0] = 0
    for t in range(1, 400):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    x += 0.05
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "key string, d int, x double")
    row = I.newey_west(df, "d", "key").first()
    assert row["se"] == pytest.approx(RS.hac_se(x[None, :])[0])
    naive = x.mean() / (x.std(ddof=1) / math.sqrt(400))
    assert abs(row["t"]) < abs(naive)


def test_short_series(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 1.0), ("b", 1, 1.0), ("b", 2, 1.0)], "key string, d int, x double")
    got = {r["key"]: (r["mean"], r["se"], r["t"]) for r in I.newey_west(df, "d", "key").collect()}
    assert got["a"] == (None, None, None) and got["b"] == (1.0, 0.0, None)
    assert {r["key"]: r["phi"] for r in I.ar1_phi(df, "d", "key").collect()} == {"a": 0.3, "b": 0.3}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p, 0) for i, p in enumerate([0.001, 0.009, 0.04, 0.2, 0.7, None])], "id int, p double, f int")
    got = {r["id"]: (r["q"], r["fdr_sig"]) for r in I.benjamini_hochberg(df, "p", 0.05, "f").collect()}
    assert [got[i][1] for i in range(6)] == [True, True, False, False, False, False]
    assert got[0][0] == pytest.approx(0.006) and got[5][0] == 1.0


def test_two_sided_p():
    assert I.two_sided_p(1.959964) == pytest.approx(0.05, abs=1e-6) and I.two_sided_p(None) is None


def test_bootstrap_covers_and_repeats(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(0.3, 1, 300))], "key string, d int, x double")
    a, b = RS.bootstrap_ci(df, "d", "key", block=5).first(), RS.bootstrap_ci(df, "d", "key", block=5).first()
    assert a == b and a["lo"] < 0.3 < a["hi"]


def test_power_is_size_at_no_effect_and_grows():
    curve = RS.PowerCurve(100, 0.1, 0.0)
    assert curve.power(0.0) < 0.1 and curve.power(0.06) > 0.9 and RS.PowerCurve(100, 0.1, 0.5).power(0.03) < curve.power(0.03)
    mde = curve.detectable()
    assert curve.power(mde) >= 0.8 > curve.power(mde - 1e-3) and mde == pytest.approx(2.8 * 0.1 / 10, rel=0.1)
    with pytest.warns(UserWarning):
        assert RS.PowerCurve(10, 1.0, 0.0).detectable() == 0.2


def test_detectable_effects_of_series(spark):
    df = spark.createDataFrame([("a", 100, 0.1, 0.0), ("b", 100, 1e-4, 0.0), ("c", 2, 0.1, 0.0), ("d", None, None, None)], "key string, n long, sd double, phi double")
    got = {r["key"]: r["mde_80"] for r in RS.with_detectable(df, "n", "sd", "phi").collect()}
    assert got["a"] == pytest.approx(0.028, rel=0.15) and got["b"] < 1e-4 and got["c"] is None and got["d"] is None
    assert RS.with_detectable(df.limit(1), "n", "sd", "phi", "mde", scale_cap=True).first()["mde"] == pytest.approx(got["a"], rel=1e-3)


def test_significance_of_a_correlated_series(spark):
    rng, x = np.random.default_rng(4), np.zeros(300)
    for t in range(1, 300):
        x[t] = 0.6 * x[t - 1] + rng.normal()
    rows = [("noise", i, float(v)) for i, v in enumerate(rng.normal(0.2, 1, 300))] + [("slow", i, float(v) + 0.3) for i, v in enumerate(x)]
    got = {r["key"]: r for r in PF.series_significance(spark.createDataFrame(rows, "key string, d int, x double"), "d", "key").collect()}
    assert got["noise"]["ic_psr"] > 0.95 and got["slow"]["t_eff"] < 150 < got["noise"]["t_eff"]


def test_sharpe_statistics():
    assert PF.probabilistic_sharpe(0.1, 5, 0, 3) is None
    assert PF.probabilistic_sharpe(0.0, 100, 0, 3) == pytest.approx(0.5)
    assert PF.deflated_sharpe(0.1, 400, 0, 3, 9, 0.001) < PF.probabilistic_sharpe(0.1, 400, 0, 3)
    with pytest.raises(ValueError):
        PF.expected_max_sharpe(1, 0.1)


def test_cscv_noise_and_skill(spark):
    def run(lift):
        r = np.random.default_rng(5).normal(0, 0.01, (160, 4))
        r[:, 0] += lift
        m = spark.createDataFrame([(c, t, float(r[t, c])) for c in range(4) for t in range(160)], "config int, t int, r double")
        return PF.pbo(PF.cscv(m, 160, 4, 8, 2), 4).first()

    assert run(0.01)["pbo"] < 0.05 and run(0.0)["n_splits"] == 70
    with pytest.raises(ValueError):
        PF.cscv(spark.createDataFrame([], "config int, t int, r double"), 20, 4, 8)
