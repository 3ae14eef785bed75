"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def formatted(df: DataFrame, significant: tuple[str, ...] = ()) -> DataFrame:
    """`df` with doubles as text: four decimals, or scientific with three for the columns named, whose values may lie near 1e-7; NULL is `-`."""
    show = lambda c: F.coalesce(F.format_string("%.3e" if c in significant else "%.4f", F.col(c)), F.lit("-"))
    return df.select(*[F.when(F.col(c).isNull(), "-").otherwise(show(c)).alias(c) if t == "double" else c for c, t in df.dtypes])
