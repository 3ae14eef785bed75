"""Purged walk-forward splits and other divisions of a calendar."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def purged_walk_forward(dates: DataFrame, label_horizon: int, n_test: int, embargo: int = 0, min_train: int = 1, step: int | None = None, expanding: bool = True) -> DataFrame:
    """fold_id, test_start, role, pos, d: test positions [start, start + n_test), train positions p with p + horizon < start - embargo.

    `dates`: d, pos. Rolling folds train on the last `min_train` positions before the test. A fold without
    training rows is left out. Folds and dates are small: the range join is a broadcast one.
    """
    if label_horizon < 0 or n_test < 1 or embargo < 0 or min_train < 1 or (step is not None and step < 1):
        raise ValueError("split parameters are out of range")
    step = step or n_test
    stats = dates.agg(F.count("*").alias("n"))
    starts = stats.where(F.col("n") - n_test >= min_train).select(F.explode(F.expr(f"sequence({min_train}, n - {n_test}, {step})")).alias("test_start"))
    starts = starts.withColumn("fold_id", ((F.col("test_start") - min_train) / step).cast("int"))
    train = (F.col("pos") + label_horizon < F.col("test_start") - embargo)
    if not expanding:
        train = train & (F.col("pos") >= F.col("test_start") - min_train)
    test = (F.col("pos") >= F.col("test_start")) & (F.col("pos") < F.col("test_start") + n_test)
    joined = dates.join(F.broadcast(starts), train | test).withColumn("role", F.when(test, "test").otherwise("train"))
    filled = F.max(F.when(F.col("role") == "train", 1).otherwise(0)).over(W.partitionBy("fold_id"))
    return joined.withColumn("filled", filled).where("filled = 1").select("fold_id", "test_start", "role", "pos", "d")


def require_increasing(positions: list) -> None:
    """Raises unless dates strictly increase."""
    if any(b <= a for a, b in zip(positions, positions[1:])):
        raise ValueError("dates must strictly increase")


def rebalance_step(rebalances: DataFrame) -> DataFrame:
    """One row, step: the median distance in calendar rows of consecutive `rebalances` (pos), cut to an integer."""
    gaps = rebalances.select((F.col("pos") - F.lag("pos").over(W.orderBy("pos"))).alias("gap"))
    return gaps.agg(F.median("gap").cast("int").alias("step"))


def purge_steps(horizon: int, step: int, knob: int = 0) -> int:
    """Rebalances between the end of training and the test: enough for the label's horizon."""
    return max(knob, math.ceil(horizon / max(step, 1)))


def train_validation(df: DataFrame, n: int, share: float = 0.8, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (pos from 0 to n - 1) before the cut, less `gap`, and those from it on."""
    cut = int(n * share)
    return df.where(F.col("pos") < cut - gap), df.where(F.col("pos") >= cut)
