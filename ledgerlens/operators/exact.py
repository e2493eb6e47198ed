"""Exact match of two result tables: 1 or 0 per (query, variant)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.operators import rows as R
from ledgerlens.operators.rows import PAIR


def with_defaults(scores: DataFrame, pairs: DataFrame, both_empty: float = 1.0) -> DataFrame:
    """Give pairs without any row their score: two empty tables agree."""
    merged = R.merge_pairs(pairs.select(*PAIR), scores)
    return merged.select(*PAIR, F.coalesce("score", F.lit(both_empty)).alias("score"))


def ex_ordered(results: DataFrame, pairs: DataFrame | None = None, dedup: bool = True) -> DataFrame:
    """1 if the row lists are equal by position and column order."""
    pairs = R.pair_list(results) if pairs is None else pairs
    rows = R.dedup_rows(results, "ordered") if dedup else results
    aligned = R.by_position(R.pair_sides(rows, pairs))
    scores = aligned.groupBy(*PAIR).agg(F.bool_and(F.col("p").eqNullSafe(F.col("g"))).cast("double").alias("score"))
    return with_defaults(scores, pairs)


def row_counts(sided: DataFrame, *keys: Column) -> DataFrame:
    """Copies of each distinct row on either side."""
    is_pred = F.col("side") == "p"
    return (
        sided.select(*PAIR, *R.SIZES, "side", *keys)
        .groupBy(*PAIR, *R.SIZES, *[f"k{i}" for i in range(len(keys))])
        .agg(F.count_if(is_pred).alias("cp"), F.count_if(~is_pred).alias("cg"))
    )


def _all_rows(results: DataFrame, pairs: DataFrame | None, same: Column) -> DataFrame:
    pairs = R.pair_list(results) if pairs is None else pairs
    counts = row_counts(R.pair_sides(results, pairs), C.encoded_keys(F.col("cells")).alias("k0"))
    scores = counts.groupBy(*PAIR).agg(F.bool_and(same).cast("double").alias("score"))
    return with_defaults(scores, pairs)


def ex_multiset(results: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """1 if each row occurs equally often on both sides; row and column order are free."""
    return _all_rows(results, pairs, F.col("cp") == F.col("cg"))


def ex_set(results: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """1 if both sides hold the same distinct rows; row and column order are free."""
    return _all_rows(results, pairs, (F.col("cp") > 0) == (F.col("cg") > 0))


def ex_match(
    results: DataFrame,
    pairs: DataFrame | None = None,
    ordered: bool = False,
    fixed: bool = True,
    dedup: bool = True,
) -> DataFrame:
    """Choose the exact match by its options; ``fixed=False`` compares sets even with copies kept."""
    if ordered:
        return ex_ordered(results, pairs, dedup)
    return ex_multiset(results, pairs) if fixed and not dedup else ex_set(results, pairs)
