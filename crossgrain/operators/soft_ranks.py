"""The rank loss on smooth ranks, without pairs of rows.

The soft rank of x among the values of its date is the sum of 1 / (1 + exp(-(x - y) / reg)) over all y. That function
of the distance is analytic, so a cell of values `reg` wide is told by sums of `TERMS` Chebyshev polynomials of the places
in it, and the ranks of all places of a cell by as many coefficients. The matrix from the one to the other depends on
how far two cells are from each other only; beyond `REACH` cells a value counts 0 or 1, which it is to 1e-17. Both expansions
end where their terms are below 1e-15: ranks are those of all pairs up to rounding, for work that grows with rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crossgrain.sources.scratch import materialize

#: Polynomials of a cell; the nearest pole is pi cells away, so that each has a share of the last of 1 / 12.6.
TERMS = 14
#: Cells up to this distance are met one by one, e**-39 being nothing to 1.
REACH = 40
#: Cells that a task has at a time, less those it has to look at beside them.
BLOCK = 4096


@cache
def transfer() -> np.ndarray:
    """For each distance from -REACH to REACH of a target cell above a source: the matrix from the source's sums of polynomials to the target's coefficients."""
    angles = (np.arange(TERMS) + 0.5) * np.pi / TERMS
    values = np.cos(np.outer(angles, np.arange(TERMS))) * np.where(np.arange(TERMS), 2, 1) / TERMS  # node, polynomial
    nodes = np.cos(angles)
    z = np.arange(-REACH, REACH + 1)[:, None, None] + (nodes[:, None] - nodes[None, :]) / 2
    return values.T @ (1 / (1 + np.exp(-z))) @ values


def cell_ranks(cell: np.ndarray, sums: np.ndarray, upto: np.ndarray, total: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Coefficients of the ranks in the `own` of cells: `sums` of polynomials, rows `upto` the end of each cell and of its date; all cells within REACH of the own are there."""
    order = np.argsort(cell, kind="stable")
    cell, sums, upto, total, own = cell[order], sums[order], upto[order], total[order], own[order]
    out = np.zeros_like(sums)
    out[:, 0] = np.where(np.isnan(cell), total, upto)  # of cells that are no finite numbers
    at = np.flatnonzero(own & np.isfinite(cell))
    out[at, 0] = (upto - sums[:, 0])[np.searchsorted(cell, cell[at] - REACH)]
    for k, matrix in zip(range(-REACH, REACH + 1), transfer(), strict=True):
        source = np.minimum(np.searchsorted(cell, cell[at] - k), len(cell) - 1)
        met = cell[at] - cell[source] == k
        out[at[met]] += sums[source[met]] @ matrix.T
    back = np.empty_like(out)
    back[order] = out
    return back


def _place(x: Column) -> Column:
    """The angle whose cosine is the place of `x`, in cells, between the ends of its cell; any for what is no finite number."""
    return F.acos(F.coalesce(F.nanvl(2 * (x - F.rint(x)), F.lit(0.0)), F.lit(0.0)))


def _polynomials(angle: str) -> list[Column]:
    return [F.lit(1.0), *[F.cos(m * F.col(angle)) for m in range(1, TERMS)]]


def _coefficients(cells: DataFrame) -> DataFrame:
    """d, kind, cell and c, the coefficients of its ranks, of `cells` (d, kind, cell, sums)."""

    def ranked(group):
        import pyarrow as pa

        cell, upto, total, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "upto", "total", "own"))
        sums = np.array(group.column("sums").combine_chunks().flatten()).reshape(-1, TERMS)
        found = cell_ranks(cell, sums, upto, total, own)[own]
        kept = group.select(["d", "kind", "cell"]).filter(pa.array(own))
        return kept.append_column("c", pa.ListArray.from_arrays(pa.array(range(0, found.size + 1, TERMS), pa.int32()), pa.array(found.reshape(-1))))

    of_date = W.partitionBy("d", "kind")
    n, block = F.col("sums")[0], lambda c: F.rint(c / BLOCK) + 0.0  # -0.0 is another element to array_distinct
    # what is no number counts 1 for all others, as 1 / (1 + exp(-700)) does
    counted = cells.withColumn("upto", F.sum(n).over(of_date.orderBy(~F.isnan("cell"), "cell"))).withColumn("total", F.sum(n).over(of_date))
    near = F.array_distinct(F.array(*[block(F.col("cell") + k) for k in (-REACH, 0, REACH)]))
    dealt = counted.withColumn("block", F.explode(near)).withColumn("own", F.col("block") == block(F.col("cell")))
    kinds = dict(cells.dtypes)
    return dealt.groupBy("d", "kind", "block").applyInArrow(ranked, f"d {kinds['d']}, kind int, cell double, c array<double>")


def soft_ranks(rows: DataFrame, values: list[str], reg: float = 1e-2) -> DataFrame:
    """`rows` (d and others) and, as rank_0, rank_1, ..., the soft rank of each of `values` among all rows of its d; rows without a d or a value go."""
    found = rows.select("*", *[(F.col(v) / reg).alias(f"in_cells_{k}") for k, v in enumerate(values)])
    found = materialize(found.where(" AND ".join(["d IS NOT NULL", *[f"in_cells_{k} IS NOT NULL" for k in range(len(values))]])), "soft-rank-rows")
    each = found.select("d", F.posexplode(F.array(*[f"in_cells_{k}" for k in range(len(values))])).alias("kind", "x"))
    placed = each.select("d", "kind", F.rint("x").alias("cell"), _place(F.col("x")).alias("angle"))
    cells = placed.groupBy("d", "kind", "cell").agg(F.array(*[F.sum(p) for p in _polynomials("angle")]).alias("sums"))
    coefficients = materialize(_coefficients(cells), "soft-rank-cells")
    for k in range(len(values)):
        x = F.col(f"in_cells_{k}")
        of_cell = coefficients.where(F.col("kind") == k).select("d", F.col("cell").alias(f"cell_{k}"), F.col("c").alias(f"c_{k}"))
        found = found.select("*", F.rint(x).alias(f"cell_{k}"), _place(x).alias(f"angle_{k}")).join(of_cell, ["d", f"cell_{k}"])
        rank = sum(F.col(f"c_{k}")[m] * p for m, p in enumerate(_polynomials(f"angle_{k}")))
        found = found.withColumn(f"rank_{k}", rank).drop(f"cell_{k}", f"angle_{k}", f"c_{k}", f"in_cells_{k}")
    return found


def soft_rank_losses(rows: DataFrame, pred: str, target: str, reg: float = 1e-2) -> DataFrame:
    """d, loss, n: 1 less the correlation of the soft ranks of `pred` and `target` at each date of `rows`, which has a row for each asset; 0 under 3 rows."""
    ranks = soft_ranks(rows.select("d", pred, target), [pred, target], reg)
    corr = F.try_divide(F.covar_pop("rank_0", "rank_1"), F.stddev_pop("rank_0") * F.stddev_pop("rank_1"))
    return ranks.groupBy("d").agg(F.when(F.count("*") < 3, F.lit(0.0)).otherwise(1 - corr).alias("loss"), F.count("*").alias("n"))
