"""Soft F-beta: partial credit for cells, rows paired by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import rows as R
from ledgerlens.operators.exact import with_defaults
from ledgerlens.operators.rows import PAIR

COUNTS = ("hit", "p_only", "g_only")


def soft_row_counts(p: Column, g: Column) -> Column:
    """struct<hit, p_only, g_only, surplus, missing, width> of one row pair, in whole cells and rows.

    Membership is tested cell by cell, so a value repeated in the prediction counts each time. A
    row without a partner has no cells here; it counts the expected width, which ``soft_totals`` fills in.
    """
    found = F.size(F.filter(p, lambda x: F.array_contains(g, x)))
    lost = F.size(F.filter(g, lambda x: ~F.array_contains(p, x)))

    def counts(*values: Column | int) -> Column:
        names = (*COUNTS, "surplus", "missing", "width")
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("bigint").alias(n) for n, v in zip(names, values)])

    return (
        F.when(g.isNull(), counts(0, 0, 0, 1, 0, 0))
        .when(p.isNull(), counts(0, 0, 0, 0, 1, F.size(g)))
        .when(F.size(g) == 0, F.when(F.size(p) == 0, counts(1, 0, 0, 0, 0, 0)).otherwise(counts(0, 1, 0, 0, 0, 0)))
        .otherwise(counts(found, F.size(p) - found, lost, 0, 0, F.size(g)))
    )


def soft_totals(counts: str) -> list[Column]:
    """Aggregates hit, p_only, g_only and width over a column of ``soft_row_counts``.

    The sums are whole numbers and do not depend on the order in which partitions meet.
    """
    width = F.greatest(F.max(f"{counts}.width"), F.lit(1).cast("bigint"))
    return [
        F.sum(f"{counts}.hit").alias("hit"),
        (F.sum(f"{counts}.p_only") + F.sum(f"{counts}.surplus") * width).alias("p_only"),
        (F.sum(f"{counts}.g_only") + F.sum(f"{counts}.missing") * width).alias("g_only"),
        width.alias("width"),
    ]


def soft_row_match(p: Column, g: Column) -> Column:
    """struct<hit, p_only, g_only> as shares of the expected row's width.

    A missing prediction row is one g_only, a surplus one is one p_only.
    """
    counts = soft_row_counts(p, g)
    width = F.greatest(counts["width"], F.lit(1).cast("bigint")).cast("double")
    return F.struct(
        (counts["hit"] / width).alias("hit"),
        (counts["p_only"] / width + counts["surplus"]).alias("p_only"),
        (counts["g_only"] / width + counts["missing"]).alias("g_only"),
    )


def fbeta(hit: Column, p_only: Column, g_only: Column, beta: float) -> Column:
    """F-beta of summed hits and misses by one division; 0 where nothing was hit."""
    square = float(beta * beta)
    whole = square * (hit + g_only) + (hit + p_only)
    return F.coalesce(F.try_divide((1.0 + square) * hit, whole), F.lit(0.0))


def soft_sums(aligned: DataFrame) -> DataFrame:
    """hit, p_only and g_only of each pair in cells, and the width of its expected rows."""
    return (
        aligned.select(*PAIR, soft_row_counts(F.col("p"), F.col("g")).alias("s")).groupBy(*PAIR).agg(*soft_totals("s"))
    )


def soft_fbeta(
    results: DataFrame,
    pairs: DataFrame | None = None,
    beta: float = 1.0,
    ordered: bool = True,
    dedup: bool = True,
) -> DataFrame:
    if not ordered:
        raise ValueError("soft F-beta pairs rows by position; there is no unordered form")
    pairs = R.pair_list(results) if pairs is None else pairs
    rows = R.dedup_rows(results, "ordered") if dedup else results
    sums = soft_sums(R.by_position(R.pair_sides(rows, pairs)))
    scores = sums.select(*PAIR, fbeta(F.col("hit"), F.col("p_only"), F.col("g_only"), beta).alias("score"))
    return with_defaults(scores, pairs)
