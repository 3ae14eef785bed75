"""Bootstraps and power by simulation: seeded numpy kernels over Arrow, a series a group or row."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def bootstrap_ci(series: DataFrame, order: str, by: str, block: int | None = None, alpha: float = 0.05, n_boot: int = 10_000, seed: int = 0) -> DataFrame:
    """by, lo, hi: quantiles of resampled means of x; moving blocks of `block` values, or single values where None. One series is one group."""

    def resampled(pdf):
        x = pdf.sort_values(order)["x"].dropna().to_numpy()
        n, size = len(x), block or 1
        if n == 0:
            return pd.DataFrame({by: [pdf[by].iloc[0]], "lo": [None], "hi": [None]})
        rng, size = np.random.default_rng(seed), min(size, n)
        means = np.empty(n_boot)
        for k in range(0, n_boot, 256):
            starts = rng.integers(0, n - size + 1, size=(min(256, n_boot - k), -(-n // size)))
            rows = (starts[:, :, None] + np.arange(size)).reshape(len(starts), -1)[:, :n]
            means[k : k + 256] = x[rows].mean(axis=1)
        lo, hi = np.quantile(means, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "lo": [lo], "hi": [hi]})

    kind = series.schema[by].dataType.simpleString()
    return series.select(by, order, "x").groupBy(by).applyInPandas(resampled, f"{by} {kind}, lo double, hi double")


def hac_se(x: np.ndarray) -> np.ndarray:
    """The Newey-West standard error of each row's mean, as `inference.newey_west` has it."""
    n = x.shape[1]
    lag = max(min(int(4 * (n / 100) ** (2 / 9)), n - 1), 0)
    e = x - x.mean(axis=1, keepdims=True)
    s = (e * e).sum(axis=1)
    for k in range(1, lag + 1):
        s = s + 2 * (1 - k / (lag + 1)) * (e[:, k:] * e[:, :-k]).sum(axis=1)
    return np.sqrt(np.maximum(s, 0)) / n


def autoregressions(n_sims: int, n_dates: int, sd: float, phi: float, seed: int) -> np.ndarray:
    """Stationary AR(1) series around 0, one a row."""
    rng = np.random.default_rng(seed)
    x = np.empty((n_sims, n_dates))
    x[:, 0] = rng.normal(0, sd, n_sims)
    for t in range(1, n_dates):
        x[:, t] = phi * x[:, t - 1] + rng.normal(0, sd * math.sqrt(1 - phi * phi), n_sims)
    return x


class PowerCurve:
    """How often the HAC test rejects, by effect. An effect moves every value alike, so one set of series serves all effects."""

    def __init__(self, n_dates: int, sd: float, phi: float, n_sims: int = 2000, seed: int = 0):
        x = autoregressions(n_sims, n_dates, sd, phi, seed)
        self.mean, self.se = x.mean(axis=1), hac_se(x)

    def power(self, effect: float, critical: float = 1.96) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(self.se > 0, np.abs(self.mean + effect) / self.se, 0.0)
        return float((t > critical).mean())

    def detectable(self, power: float = 0.8, cap: float = 0.2, steps: int = 24) -> float:
        """The least effect up to `cap` that is found with `power`; the cap, with a warning, where even that is not."""
        if self.power(cap) < power:
            warnings.warn(f"no effect up to {cap} is found with power {power}", stacklevel=2)
            return cap
        lo, hi = 0.0, cap
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if self.power(mid) >= power else (mid, hi)
        return hi


def with_detectable(results: DataFrame, n: str, sd: str, phi: str, name: str = "mde_80", n_sims: int = 400, least_sd: float = 1e-6, scale_cap: bool = False) -> DataFrame:
    """`results`, a row a series, and the least effect that a series like it shows; NULL under 3 dates. With `scale_cap` effects go up to three deviations, for series that are no correlations."""

    def found(batches):
        for pdf in batches:
            out = []
            for n_, sd_, phi_ in zip(pdf[n], pdf[sd], pdf[phi], strict=True):
                if n_ != n_ or n_ < 3 or sd_ != sd_:
                    out.append(None)
                    continue
                sd_ = max(float(sd_), least_sd)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    out.append(PowerCurve(int(n_), sd_, float(phi_), n_sims).detectable(cap=3 * sd_ if scale_cap else 0.2))
            yield pdf.assign(**{name: pd.Series(out, index=pdf.index, dtype="float64")})

    from pyspark.sql.types import DoubleType, StructType

    return results.mapInPandas(found, StructType([*results.schema.fields]).add(name, DoubleType()))
