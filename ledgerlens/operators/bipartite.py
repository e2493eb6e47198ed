"""Bipartite F-beta: rows are aligned so that they share as many cells as possible.

All rows of a result table have one width, so the F-beta of a row pair with c shared cells is
(1 + b*b) * c / (b*b*g_width + p_width): a constant times c. The alignments below therefore work on
the whole number c and serve every beta.

Spark does the bulk: equal rows are matched by counting (unordered) or cut off at both ends
(ordered), and only what is left of a pair goes to Arrow tasks, many small pairs per batch. A long ordered pair is
cut into blocks that are solved along the anti-diagonals, and a long weight matrix into blocks of prediction rows.
What is left of an unordered pair is solved in one task while its weights fit in ``SPREAD`` entries, and else by the
matching that is spread over tasks (``operators/matching.py``). Both are exact, and every pair is aligned whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import ledgerlens
from ledgerlens.functions import cells as C
from ledgerlens.functions.alignment import best_matching, block_in_order, overlap_lines, overlaps
from ledgerlens.operators import rows as R
from ledgerlens.operators.exact import row_counts
from ledgerlens.operators.matching import heaviest_matching
from ledgerlens.operators.rows import PAIR
from ledgerlens.session import stage

BLOCK = 1024  # rows of a block in the ordered alignment
SPREAD = 1 << 22  # row pairs that one task solves; above it the matching is spread
_EMIT = 1 << 22  # weights per outgoing batch; incoming batches are bounded in bytes by Spark

# The kernels travel inside the task: workers need numpy and pyarrow, not this package.
cloudpickle.register_pickle_by_value(ledgerlens)


def row_fbeta(p: Column, g: Column, beta: float = 2.0) -> Column:
    """F-beta of two rows as multisets of cell keys."""
    shared = F.size(F.array_intersect(C.counted_keys(p), C.counted_keys(g)))
    return (
        F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0)
        .when((F.size(p) == 0) | (F.size(g) == 0), 0.0)
        .otherwise(pair_weight(shared, F.size(p), F.size(g), beta))
    )


def pair_weight(shared: Column, p_width: Column, g_width: Column, beta: float) -> Column:
    square = float(beta * beta)
    return F.coalesce(F.try_divide((1.0 + square) * shared, square * g_width + p_width), F.lit(0.0))


def _marks(cells: Column) -> Column:
    """Cell keys with their occurrence number, as text."""
    counted = C.counted_keys(cells.getField("key"))
    return F.transform(counted, lambda c: F.concat(c["key"], F.lit("\u0001"), c["ord"].cast("string")))


def _tables(rows: DataFrame, *extra: Column, place: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """One line per pair (and ``keys``): the marks of its rows on both sides, in row order. ``place`` adds the row numbers."""

    def gather(side: str) -> list[Column]:
        one = F.when(F.col("side") == side, F.struct("row_idx", "marks"))
        ordered = F.sort_array(F.collect_list(one))
        return [ordered.getField("marks").alias(side), ordered.getField("row_idx").alias(f"{side}_at")]

    columns = [c for side in ("p", "g") for c in gather(side)]
    return rows.groupBy(*PAIR, *keys).agg(*(columns if place else columns[::2]), *extra)


def _lists(batch: pa.RecordBatch) -> tuple[pa.ListArray, pa.ListArray]:
    return batch.column("p"), batch.column("g")


def _answer(batch: pa.RecordBatch, shared: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAIR), shared], names=[*PAIR, "shared"])


# -- weights ---------------------------------------------------------------------------------


def pair_weights(results: DataFrame, pairs: DataFrame | None = None, beta: float = 2.0) -> DataFrame:
    """The weight matrix, one line per prediction row: ``weights[j]`` for expected row j.

    Prediction rows go in blocks of at most _EMIT weights, each with all expected rows: what a line of the result holds.
    """
    pairs = R.pair_list(results) if pairs is None else pairs
    sided = R.pair_sides(results, pairs)
    lines = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(_EMIT) / F.greatest(F.col("m"), F.lit(1))))).cast("bigint")
    mine = F.floor(F.col("row_idx") / lines).cast("bigint")
    every = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / lines).cast("bigint"))
    block = F.explode(F.when(F.col("side") == "p", F.array(mine)).otherwise(every)).alias("block")
    keys = C.ordered_keys(F.col("cells")).alias("marks")
    rows = sided.select(*PAIR, "side", "row_idx", "p_width", "g_width", keys, block)
    square = float(beta * beta)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.prod([np.diff(batch.column(c).offsets.to_numpy()) for c in ("p", "g")], axis=0, dtype=np.int64)
            part = np.cumsum(sizes) // _EMIT
            for first in np.flatnonzero(np.diff(part, prepend=-1)):
                some = batch.slice(first, int(np.searchsorted(part, part[first], "right")) - first)
                shared, lines = overlap_lines(*_lists(some))
                at = pa.compute.list_parent_indices(some.column("p")).to_numpy()
                widths = [some.column(c).to_numpy(zero_copy_only=False)[at] for c in ("g_width", "p_width")]
                whole = np.repeat(square * widths[0] + widths[1], np.diff(lines))
                weights = np.divide((1.0 + square) * shared, whole, out=np.zeros(shared.size), where=whole != 0)
                kept = [*(some.column(c).take(pa.array(at)) for c in PAIR), some.column("p_at").flatten()]
                listed = pa.ListArray.from_arrays(pa.array(lines, pa.int32()), pa.array(weights))
                yield pa.RecordBatch.from_arrays([*kept, listed], names=[*PAIR, "row_idx", "weights"])

    tables = _tables(rows, F.max("p_width").alias("p_width"), F.max("g_width").alias("g_width"), place=True, keys=("block",))
    return tables.mapInArrow(matrices, "query_id string, variant int, row_idx bigint, weights array<double>")


# -- ordered ---------------------------------------------------------------------------------


def mismatch() -> Column:
    """The position of a row whose two sides differ as multisets, else null."""
    return F.when(~F.array_sort("p").eqNullSafe(F.array_sort("g")), F.col("row_idx"))


def mismatch_span(aligned: DataFrame) -> DataFrame:
    """First and last position at which the two rows differ, for pairs that differ at all."""
    spans = aligned.select(*PAIR, mismatch().alias("place")).where("place IS NOT NULL")
    return spans.groupBy(*PAIR).agg(F.min("place").alias("lo"), F.max("place").alias("hi"))


def align_ordered(sided: DataFrame, spans: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Most shared cells over all matchings without crossings: (query_id, variant, shared).

    Leading equal rows belong to a best matching, and so do trailing ones if both tables are
    equally long. Spark counts those; the span between goes through the recurrence in blocks of
    ``block`` x ``block`` rows. The blocks of an anti-diagonal depend only on the two before it, so each
    anti-diagonal is one job over all pairs. Pairs that are equal all along, or have no row, are not listed: see ``equal_shared``.
    """
    spans = mismatch_span(R.by_position(sided)) if spans is None else spans
    open_rows = (
        sided.join(spans, PAIR)
        .withColumn("hi", F.when(F.col("n") == F.col("m"), F.col("hi")).otherwise(F.greatest("n", "m")))
        .withColumn(
            "cut",
            F.when(F.col("n") == F.col("m"), F.col("lo") + F.col("n") - 1 - F.col("hi")).otherwise(F.col("lo")) * F.col("p_width"),
        )
        .where(F.col("row_idx").between(F.col("lo"), F.col("hi")))
        .select(*PAIR, "side", "row_idx", "lo", "cut", _marks(F.col("cells")).alias("marks"))
    )
    place = F.floor((F.col("row_idx") - F.col("lo")) / block).cast("int").alias("at")
    line = F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "marks"))), lambda r: r["marks"])
    blocks = stage(
        open_rows.groupBy(*PAIR, "side", place).agg(line.alias("rows"), F.max("cut").cast("bigint").alias("cut")), "blocks"
    )
    p = blocks.where("side = 'p'").select(*PAIR, F.col("at").alias("i"), F.col("rows").alias("p"))
    g = blocks.where("side = 'g'").select(*PAIR, F.col("at").alias("j"), F.col("rows").alias("g"))
    is_pred = F.col("side") == "p"
    last = blocks.groupBy(*PAIR).agg(
        F.max(F.when(is_pred, F.col("at"))).alias("last_i"), F.max(F.when(~is_pred, F.col("at"))).alias("last_j"), F.max("cut").alias("cut")
    )
    waves = last.agg(F.max(F.coalesce("last_i", F.lit(0)) + F.coalesce("last_j", F.lit(0)))).first()[0]
    # a side without rows in the span leaves the cut alone
    ends = [last.where("last_i IS NULL OR last_j IS NULL").select(*PAIR, F.col("cut").alias("shared"))]
    rims = None

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bottoms, rights = [], []
            for shared, top, left in zip(overlaps(*_lists(batch)), batch.column("top"), batch.column("left")):
                lines = (np.array(x.as_py()) if x.is_valid else None for x in (top, left))
                bottom, right = block_in_order(shared, *lines)
                bottoms.append(bottom)
                rights.append(right)
            kept = [batch.column(c) for c in (*PAIR, "i", "j")]
            solved = [pa.array(x, pa.list_(pa.int64())) for x in (bottoms, rights)]
            yield pa.RecordBatch.from_arrays([*kept, *solved], names=[*PAIR, "i", "j", "bottom", "right"])

    for wave in range(0 if waves is None else waves + 1):
        here = p.withColumn("j", F.lit(wave) - F.col("i")).join(g, [*PAIR, "j"])
        if rims is None:
            none = F.lit(None).cast("array<bigint>")
            here = here.select(*PAIR, "i", "j", "p", "g", none.alias("top"), none.alias("left"))
        else:
            here = here.join(rims, [*PAIR, "i", "j"], "left").select(*PAIR, "i", "j", "p", "g", "top", "left")
        solved = stage(here.mapInArrow(recur, "query_id string, variant int, i int, j int, bottom array<bigint>, right array<bigint>"), "wave")
        end = (F.col("i") == F.col("last_i")) & (F.col("j") == F.col("last_j"))
        ends.append(solved.join(last, PAIR).where(end).select(*PAIR, (F.col("cut") + F.element_at("bottom", -1)).alias("shared")))
        none = F.lit(None).cast("array<bigint>")
        below = solved.select(*PAIR, (F.col("i") + 1).alias("i"), "j", F.col("bottom").alias("top"), none.alias("left"))
        beside = solved.select(*PAIR, "i", (F.col("j") + 1).alias("j"), none.alias("top"), F.col("right").alias("left"))
        rims = below.unionByName(beside).groupBy(*PAIR, "i", "j").agg(F.max("top").alias("top"), F.max("left").alias("left"))
    whole = ends[0]
    for part in ends[1:]:
        whole = whole.unionByName(part)
    return whole


def equal_shared() -> Column:
    """Shared cells of a pair whose rows are equal one by one."""
    return F.when(F.col("n") == F.col("m"), F.col("n") * F.col("p_width")).otherwise(0)


# -- unordered -------------------------------------------------------------------------------


def _by_size(left: DataFrame, n: Column, m: Column, spread: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the pairs that one task solves, and of those that are spread, None where there are none."""
    large = stage(left.groupBy(*PAIR).agg(n.alias("n"), m.alias("m")).where(F.col("n") * F.col("m") > spread).select(*PAIR), "large")
    if large.isEmpty():
        return left, None
    return left.join(large, PAIR, "left_anti"), left.join(large, PAIR, "left_semi")


def align_unordered(sided: DataFrame, counts: DataFrame | None = None, spread: int = SPREAD) -> DataFrame:
    """Most shared cells over all matchings: (query_id, variant, shared).

    Equal rows are matched with each other by counting copies, which is exact for tables of one
    width. The rest is solved on distinct rows repeated by their left-over copies: a pair of more than ``spread`` row pairs over many tasks, any other in one.
    """
    if counts is None:
        counts = row_counts(sided, _marks(F.col("cells")).alias("k0"))
    both = F.least("cp", "cg")
    peeled = stage(
        counts.select(
            *PAIR,
            F.col("k0").alias("marks"),
            both.alias("both"),
            (F.col("cp") - both).cast("int").alias("cp"),
            (F.col("cg") - both).cast("int").alias("cg"),
        ),
        "peeled",
    )
    equal = peeled.groupBy(*PAIR).agg(F.sum(F.col("both") * F.size("marks")).alias("equal"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for shared in overlaps(*_lists(batch)):
                held = best_matching(shared)
                best.append(int(shared[np.flatnonzero(held >= 0), held[held >= 0]].sum()))
            yield _answer(batch, pa.array(best, pa.int64()))

    left = peeled.where("cp + cg > 0")
    near, far = _by_size(left, F.sum("cp"), F.sum("cg"), spread)
    rest = near.groupBy(*PAIR).agg(
        *[F.flatten(F.collect_list(F.array_repeat("marks", F.col(c)))).alias(side) for c, side in (("cp", "p"), ("cg", "g"))]
    )
    open_pairs = rest.where((F.size("p") > 0) & (F.size("g") > 0))
    inner = open_pairs.mapInArrow(solve, "query_id string, variant int, shared bigint").withColumnRenamed("shared", "inner")
    if far is not None:
        copies = F.explode(F.array_repeat(F.when(F.col("cp") > 0, "p").otherwise("g"), F.greatest("cp", "cg"))).alias("side")
        numbered = stage(far.select(*PAIR, "marks", copies).withColumn("id", F.monotonically_increasing_id()), "copies")
        inner = inner.unionByName(heaviest_matching(numbered).groupBy(*PAIR).agg(F.sum("shared").alias("inner")))
    zero = F.lit(0).cast("bigint")
    return R.merge_pairs(equal, inner).select(
        *PAIR, (F.coalesce("equal", zero) + F.coalesce("inner", zero)).alias("shared")
    )


def match_assignment(sided: DataFrame, spread: int = SPREAD) -> DataFrame:
    """For each prediction row the expected row it is matched with, -1 where there is none."""
    rows = sided.select(*PAIR, "side", "row_idx", _marks(F.col("cells")).alias("marks"))
    copies = Window.partitionBy(*PAIR, "marks", "side").orderBy("row_idx")
    numbered = rows.withColumn("copy", F.row_number().over(copies))
    is_pred = F.col("side") == "p"
    met = stage(
        numbered.groupBy(*PAIR, "marks", "copy").agg(
            F.max(F.when(is_pred, F.col("row_idx"))).alias("p"), F.max(F.when(~is_pred, F.col("row_idx"))).alias("g")
        ),
        "met",
    )
    equal = met.where("p IS NOT NULL AND g IS NOT NULL").select(*PAIR, F.col("p").alias("row_idx"), F.col("g").alias("partner"))
    left = met.where("p IS NULL OR g IS NULL")
    near, far = _by_size(left, F.count("p"), F.count("g"), spread)
    rest = near.select(
        *PAIR, F.when(F.col("g").isNull(), "p").otherwise("g").alias("side"), F.coalesce("p", "g").alias("row_idx"), "marks"
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            partners = []
            for shared, at in zip(overlaps(*_lists(batch)), batch.column("g_at")):
                places = np.array(at.as_py() + [-1], dtype=np.int64)
                partners.append(places[best_matching(shared)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*PAIR, "p_at")), pa.array(partners, pa.list_(pa.int64()))], names=[*PAIR, "p_at", "partners"]
            )

    schema = "query_id string, variant int, p_at array<bigint>, partners array<bigint>"
    solved = _tables(rest, place=True).mapInArrow(solve, schema).select(*PAIR, F.explode(F.arrays_zip("p_at", "partners")).alias("line"))
    found = equal.unionByName(solved.select(*PAIR, F.col("line.p_at").alias("row_idx"), F.col("line.partners").alias("partner")))
    if far is None:
        return found
    rows = far.select(*PAIR, F.when(F.col("g").isNull(), "p").otherwise("g").alias("side"), F.coalesce("p", "g").alias("id"), "marks")
    pairs = heaviest_matching(rows).select(*PAIR, F.col("p").alias("id"), F.col("g").alias("partner"))
    spread_out = rows.where("side = 'p'").join(pairs, [*PAIR, "id"], "left")
    return found.unionByName(spread_out.select(*PAIR, F.col("id").alias("row_idx"), F.coalesce("partner", F.lit(-1)).alias("partner")))


# -- score -----------------------------------------------------------------------------------


def overlap_score(shared: Column, beta: float, ordered: bool, legacy_empty: bool = False) -> Column:
    """The score from the shared cells of a pair; needs n, m, p_width and g_width."""
    n, m = F.col("n"), F.col("m")
    empty = F.when(m > 0, 1.0 / m).otherwise(1.0) if legacy_empty and ordered else F.lit(0.0)
    weight = pair_weight(shared, F.col("p_width"), F.col("g_width"), beta)
    return (
        F.when((n == 0) & (m == 0), 1.0)
        .when(n == 0, empty)
        .when(m == 0, 0.0)
        .otherwise(weight / F.greatest(n, m))
    )


def bf_score(
    results: DataFrame,
    pairs: DataFrame | None = None,
    beta: float = 2.0,
    ordered: bool = False,
    dedup: bool = True,
    legacy_empty: bool = False,
) -> DataFrame:
    """Bipartite F-beta per (query, variant).

    ``legacy_empty`` gives an empty prediction 1/m in the ordered form instead of 0.
    """
    pairs = R.pair_list(results) if pairs is None else pairs
    if dedup:
        results = R.dedup_rows(results, "bag")
        gold = pairs.select(*PAIR, F.lit("g").alias("side"))
        pred = pairs.select("query_id", F.lit(0).alias("variant"), F.lit("p").alias("side")).distinct()
        pairs = R.pair_list(results, gold.unionByName(pred))
    sided = R.pair_sides(results, pairs)
    best = align_ordered(sided) if ordered else align_unordered(sided)
    shared = F.coalesce(F.col("shared"), equal_shared()) if ordered else F.coalesce("shared", F.lit(0))
    return R.merge_pairs(pairs, best).select(*PAIR, overlap_score(shared, beta, ordered, legacy_empty).alias("score"))
