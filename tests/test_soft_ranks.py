"""Soft ranks by cells against all pairs."""

import numpy as np
import pandas as pd
import pytest

from crossgrain.operators import soft_ranks as SR


def all_pairs(x, among, reg):
    with np.errstate(invalid="ignore", over="ignore"):
        z = (np.asarray(x)[:, None] - np.asarray(among)[None, :]) / reg
    return (1 / (1 + np.exp(-np.clip(np.where(np.isnan(z), 700, z), -700, 700)))).sum(axis=1)


def test_ranks_equal_all_pairs(spark, monkeypatch):
    """Dates of ties, one row, wide gaps, cells at the ends of blocks, huge values and no numbers at all."""
    monkeypatch.setattr(SR, "BLOCK", 64)
    rng = np.random.default_rng(4)
    dates = [
        rng.normal(size=300), np.repeat(0.123, 5), np.array([7.0]), rng.normal(scale=1e-3, size=200), np.round(rng.normal(size=200), 2), np.arange(-400, 400) * 0.005,
        np.concatenate((rng.normal(size=50) * 1e4, [1e17, 1e17, -1e17, 1e15 + 0.5, 0.0, -0.0])), np.concatenate((rng.normal(size=20), [np.nan, np.nan, np.inf, -np.inf, -np.inf])), rng.standard_cauchy(500),
    ]
    rows = [(d, k, float(v), float(-2 * v)) for d, x in enumerate(dates) for k, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, 0, 1.0, 1.0), (0, 999, None, 1.0)], "d int, k int, x double, y double").repartition(3)
    got = SR.soft_ranks(df, ["x", "y"], 0.01).collect()
    assert len(got) == len(rows)
    ranks = {(r["d"], r["k"]): (r["rank_0"], r["rank_1"]) for r in got}
    for d, x in enumerate(dates):
        for kind, values in enumerate((x, -2 * x)):
            assert [ranks[d, k][kind] for k in range(len(x))] == pytest.approx(all_pairs(values, values, 0.01).tolist(), rel=1e-11, abs=1e-11)


def test_losses_of_few_rows_and_ties(spark):
    rows = [(1, 0.1, 0.2), (1, 0.3, 0.1), (2, 0.5, 0.1), (2, 0.5, 0.2), (2, 0.5, 0.3), (3, 0.1, 1.0), (3, 0.2, 2.0), (3, 0.3, 3.0)]
    got = {r["d"]: (r["loss"], r["n"]) for r in SR.soft_rank_losses(spark.createDataFrame(rows, "d int, p double, y double"), "p", "y").collect()}
    assert got[1] == (0.0, 2) and got[2] == (None, 3) and got[3] == (pytest.approx(0, abs=1e-4), 3)


def test_a_large_date_is_not_joined_with_itself(spark):
    """300,000 rows of one date, 9e10 pairs: some ranks against numpy."""
    x = np.random.default_rng(5).normal(scale=0.2, size=300_000)
    df = spark.createDataFrame(pd.DataFrame({"d": 1, "k": range(len(x)), "x": x}))
    got = {r["k"]: r["rank_0"] for r in SR.soft_ranks(df, ["x"], 0.01).where("k % 10000 = 0").collect()}
    at = sorted(got)
    assert len(at) == 30 and [got[k] for k in at] == pytest.approx(all_pairs(x[at], x, 0.01).tolist(), rel=1e-11)
