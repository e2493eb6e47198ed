"""The weight matrix of a pair of result tables as sparse edges.

Two rows share a cell when they hold the same mark (cell key and occurrence number). An inverted index, marks to rows,
gives the edges: rows of both sides meet on (pair, mark), and the meetings of a row pair are counted. A mark that both sides hold
very often, such as NULL or 0 in a column, would make a meeting of everything with everything. Such heavy marks stay out of the index.
A row carries its heavy marks as a list, its signature; what two rows share in them follows from their signatures, of which
there are few, so it is counted by classes of rows with equal signatures and never row by row.

Pairs of common size look up their rows in an index of their own, many pairs in one Arrow task; the shuffled index is for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.functions.alignment import row_overlaps
from ledgerlens.operators.bipartite import _marks, pair_weight
from ledgerlens.operators.rows import PAIR
from ledgerlens.session import stage

#: Meetings of one mark from which on it is heavy.
HEAVY = 4096
#: Rows and row pairs up to which a pair is worked out in one task.
ROWS, NEAR = 1 << 15, 1 << 20


def marked_rows(sided: DataFrame) -> DataFrame:
    """(pair, side, row_idx, p_width, g_width, mark): one row per cell."""
    return sided.select(*PAIR, "side", "row_idx", "p_width", "g_width", F.explode(_marks(F.col("cells"))).alias("mark"))


def _side(rows: DataFrame, side: str, *columns: Column) -> DataFrame:
    return rows.where(F.col("side") == side).select(*PAIR, *columns)


def sparse_weights(sided: DataFrame, heavy: int = HEAVY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, classes, rows).

    ``edges(pair, p_row, g_row, light, p_heavy, g_heavy)``: row pairs that share a light mark, how many, and both signatures.
    ``classes(pair, p_heavy, g_heavy, shared, g_rows)``: pairs of signatures that share heavy marks, how many, and the expected rows with that signature.
    ``rows(pair, side, row_idx, p_width, g_width, heavy)``: every row with its signature. Any other row pair shares nothing.
    """
    marks = stage(marked_rows(sided), "marks")
    of = lambda side: F.count_if(F.col("side") == side)
    counts = marks.where("mark IS NOT NULL").groupBy(*PAIR, "mark").agg(of("p").alias("cp"), of("g").alias("cg")).where("cp > 0 AND cg > 0")
    met = stage(marks.join(counts.select(*PAIR, "mark", (F.col("cp") * F.col("cg") >= heavy).alias("is_heavy")), [*PAIR, "mark"]), "met")
    own = met.where("is_heavy").groupBy(*PAIR, "side", "row_idx").agg(F.array_sort(F.collect_list("mark")).alias("heavy"))
    none = F.array().cast("array<string>")
    rows = sided.select(*PAIR, "side", "row_idx", "p_width", "g_width").join(own, [*PAIR, "side", "row_idx"], "left")
    rows = stage(rows.withColumn("heavy", F.coalesce("heavy", none)), "signatures")

    light = met.where("NOT is_heavy")
    p = _side(light, "p", F.col("mark"), F.col("row_idx").alias("p_row"))
    g = _side(light, "g", F.col("mark"), F.col("row_idx").alias("g_row"))
    counted = p.join(g, [*PAIR, "mark"]).groupBy(*PAIR, "p_row", "g_row").agg(F.count("*").alias("light"))
    edges = counted.join(_side(rows, "p", F.col("row_idx").alias("p_row"), F.col("heavy").alias("p_heavy")), [*PAIR, "p_row"]).join(
        _side(rows, "g", F.col("row_idx").alias("g_row"), F.col("heavy").alias("g_heavy")), [*PAIR, "g_row"]
    )

    kinds = rows.where(F.size("heavy") > 0).groupBy(*PAIR, "side", "heavy").agg(F.count("*").alias("n"))
    kinds = stage(kinds.select("*", F.explode("heavy").alias("mark")), "classes")
    p = _side(kinds, "p", F.col("mark"), F.col("heavy").alias("p_heavy"))
    g = _side(kinds, "g", F.col("mark"), F.col("heavy").alias("g_heavy"), F.col("n").alias("g_rows"))
    classes = p.join(g, [*PAIR, "mark"]).groupBy(*PAIR, "p_heavy", "g_heavy").agg(F.count("*").alias("shared"), F.max("g_rows").alias("g_rows"))
    return edges, classes, rows


def _near_weights(sided: DataFrame) -> DataFrame:
    """(pair, row_idx, p_width, g_width, partners, top, sum) of pairs that fit in a task, many of them per batch."""

    def rows(side: str) -> list[Column]:
        held = lambda c: F.collect_list(F.when(F.col("side") == side, c))
        return [held(F.struct("row_idx", C.ordered_keys(F.col("cells")).alias("keys"))).alias(side)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, g = (pa.ListArray.from_arrays(x.offsets, x.values.field("keys")) for x in (batch.column("p"), batch.column("g")))
            at = pa.compute.list_parent_indices(batch.column("p"))
            kept = [batch.column(c).take(at) for c in (*PAIR, "p_width", "g_width")]
            figures = [pa.array(x, pa.int64()) for x in row_overlaps(p, g)]
            row_idx = batch.column("p").flatten().field("row_idx")
            yield pa.RecordBatch.from_arrays([*kept, row_idx, *figures], names=[*PAIR, "p_width", "g_width", "row_idx", "partners", "top", "sum"])

    tables = sided.groupBy(*PAIR).agg(F.max("p_width").alias("p_width"), F.max("g_width").alias("g_width"), *rows("p"), *rows("g"))
    schema = "query_id string, variant int, p_width int, g_width int, row_idx bigint, partners bigint, top bigint, sum bigint"
    return tables.select(*PAIR, "p_width", "g_width", "p", "g").mapInArrow(count, schema)


def _far_weights(sided: DataFrame, heavy: int) -> DataFrame:
    """The same of pairs of any size, from edges and classes: row pairs that share heavy marks only are counted, not listed."""
    edges, classes, rows = sparse_weights(sided, heavy)
    both = F.size(F.array_intersect("p_heavy", "g_heavy"))
    listed = edges.withColumn("both", both).groupBy(*PAIR, F.col("p_row").alias("row_idx")).agg(
        F.count_if(F.col("both") == 0).alias("new"), F.max(F.col("light") + F.col("both")).alias("top"), F.sum("light").alias("sum")
    )
    held = classes.groupBy(*PAIR, F.col("p_heavy").alias("heavy")).agg(
        F.sum("g_rows").alias("h_new"), F.max("shared").alias("h_top"), F.sum(F.col("shared") * F.col("g_rows")).alias("h_sum")
    )
    zero = F.lit(0).cast("bigint")
    value = lambda a, b, join: join(F.coalesce(a, zero), F.coalesce(b, zero)).cast("bigint")
    plus = lambda a, b: a + b
    figures = [value("new", "h_new", plus).alias("partners"), value("top", "h_top", F.greatest).alias("top"), value("sum", "h_sum", plus).alias("sum")]
    whole = rows.where("side = 'p'").join(listed, [*PAIR, "row_idx"], "left").join(held, [*PAIR, "heavy"], "left")
    return whole.select(*PAIR, "p_width", "g_width", "row_idx", *figures)


def row_weights(sided: DataFrame, beta: float = 2.0, heavy: int = HEAVY, pairs: DataFrame | None = None, near: int = NEAR) -> DataFrame:
    """For each prediction row: partners (expected rows that share a cell), the best weight and the sum of all weights.

    Pairs of at most ``near`` row pairs are worked out in one task each, larger ones from edges that meet by shuffles. Pairs without expected rows give zeros.
    """
    small = (F.col("n") * F.col("m") <= near) & (F.col("n") + F.col("m") <= ROWS)
    found = _near_weights(sided.where(small))
    if not (sided if pairs is None else pairs).where(~small).isEmpty():
        found = found.unionByName(_far_weights(sided.where(~small), heavy))
    weight = lambda shared: pair_weight(F.col(shared), F.col("p_width"), F.col("g_width"), beta)
    return found.select(*PAIR, "row_idx", "partners", weight("top").alias("best"), weight("sum").alias("total"))
