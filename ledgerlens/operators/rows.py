"""Row numbering, de-duplication and pairing of result tables.

Result tables live in one long frame

    results(query_id string, side string, variant int, row_idx bigint, cells array<struct<tag,key>>)

with side 'p' for the prediction (variant 0) and 'g' for the expected tables, of which a query may
have several variants. Nothing here gathers one query into one task: rows are spread by
(query, variant, position) or by content, so a single huge result is as good as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.session import stage

RESULTS = f"query_id string, side string, variant int, row_idx bigint, cells array<{C.CELL}>"
CHUNK_BITS = 16


def hot_keys(df: DataFrame, keys: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """The keys of more than a chunk of rows: at most one per 65,536 rows of the frame."""
    return df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > (1 << bits)).select(*keys)


def by_heat(df: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """The rows of the hot keys (``left_semi``) or all others (``left_anti``)."""
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in hot.columns]
    return df.alias("d").join(F.broadcast(hot.alias("h")), same, how)


def with_chunks(df: DataFrame, order: Column, hot: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``_chunk``: rows of a hot key are cut into chunks by their order, those of any other key lie in chunk 0."""
    known = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in hot.columns], F.lit(True).alias("_hot"))
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in hot.columns]
    chunk = F.when(F.col("_hot"), F.shiftright(order.cast("bigint"), bits)).otherwise(F.lit(0).cast("bigint"))
    return df.join(F.broadcast(known), same, "left").select(*[F.col(c) for c in df.columns], chunk.alias("_chunk"))


def dense_index(
    df: DataFrame,
    keys: list[str],
    order: Column,
    ties: list[Column] | None = None,
    out: str = "row_idx",
    bits: int = CHUNK_BITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … by an integer order; rows without an order take the first numbers and are left out.

    Most keys are numbered whole. The order of a hot key (``hot_keys``) is cut into chunks; rows are numbered inside
    their chunk and moved up by the sizes of the chunks before it. A key of any size is so spread over many tasks; only
    the chunk sizes of one key meet in one place. ``hot`` names the hot keys, by some of the key columns, where the caller
    knows them cheaper. A frame that has a column ``_chunk`` already is taken as cut: chunks of a key do not overlap in the order.
    """
    cut = df.withColumn("_order", order.cast("bigint"))
    if "_chunk" not in df.columns:
        hot = hot_keys(df, keys, bits) if hot is None else hot
        cut = with_chunks(cut, F.col("_order"), hot, bits)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_order", *(ties or []))
    numbered = cut.withColumn("_place", F.row_number().over(inside) - 1)
    # only hot keys have sizes to add
    spread = cut if hot is None else by_heat(cut, hot, "left_semi")
    sizes = spread.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"), F.min("_order").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_chunk", F.sum("_size").over(before).alias("_before"))
    matched = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    matched.append(F.col("n._chunk") == F.col("o._chunk"))
    joined = numbered.alias("n").join(offsets.alias("o"), matched, "left")
    kept = [F.col(f"n.{c}") for c in df.columns if c not in (out, "_chunk")]
    place = F.coalesce(F.col("o._before"), F.lit(0)) + F.col("n._place")
    return joined.where("_order IS NOT NULL").select(*kept, place.cast("bigint").alias(out))


def rank_index(df: DataFrame, order: list[Column], out: str = "row_idx") -> DataFrame:
    """Number all rows 0, 1, 2, … by any order, without a window over all of them.

    Rows are dealt to ranges of the order and sorted there; each knows its place in its range. Only the sizes of the ranges,
    one number per partition, meet on the driver. The dealt rows are staged, so that a retried task numbers them alike.
    """
    names = [f"_order{i}" for i in range(len(order))]
    ordered = df.select("*", *[c.alias(n) for c, n in zip(order, names)]).repartitionByRange(*names).sortWithinPartitions(*names)
    dealt = stage(ordered.drop(*names).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("_id", 33)
    before, offsets = 0, []
    for row in sorted(dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        offsets.append((row["part"], before))
        before += row["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    placed = dealt.join(F.broadcast(starts), part == F.col("_part"))
    kept = [F.col(c) for c in df.columns if c != out]
    return placed.select(*kept, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).alias(out))


def norm_cells(df: DataFrame, columns: list[str], ndigits: int = 3) -> DataFrame:
    """Turn value columns into cells. The frame must carry query_id, side, variant and row_idx."""
    identity = F.concat_ws(":", "query_id", "side", "variant", "row_idx")
    return C.with_cells(df, columns, identity, ndigits).select(
        F.col("query_id").cast("string").alias("query_id"),
        "side",
        F.col("variant").cast("int").alias("variant"),
        F.col("row_idx").cast("bigint").alias("row_idx"),
        F.array(*[F.col(f"`{c}`") for c in columns]).alias("cells"),
    )


def dedup_rows(results: DataFrame, how: str = "ordered") -> DataFrame:
    """Drop later copies of a row and close the gaps in the numbering.

    ``ordered`` compares rows as tuples, ``bag`` without regard to column order. A table of common size is shuffled once and
    sorted twice where it lies; rows of a hot table meet by content and are numbered by chunks.
    """
    if how not in ("ordered", "bag"):
        raise ValueError("how must be 'ordered' or 'bag'")
    table = ["query_id", "side", "variant"]
    key = C.ordered_keys(F.col("cells")) if how == "ordered" else C.encoded_keys(F.col("cells"))
    placed = results.select(*table, "row_idx", "cells")
    hot = hot_keys(results, table)

    copies = Window.partitionBy(*table, "_hash", "_key").orderBy(F.asc_nulls_last("row_idx"))
    whole = by_heat(placed, hot, "left_anti").repartition(*table).withColumn("_key", key).withColumn("_hash", F.xxhash64("_key"))
    first = whole.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1")
    place = F.row_number().over(Window.partitionBy(*table).orderBy("row_idx")) - 1
    numbered = first.withColumn("_place", place.cast("bigint")).where("row_idx IS NOT NULL")
    few = numbered.select(*table, F.col("_place").alias("row_idx"), "cells")

    spread = by_heat(placed, hot, "left_semi").withColumn("_key", key).groupBy(*table, "_key")
    many = spread.agg(F.min_by("cells", "row_idx").alias("cells"), F.min("row_idx").alias("row_idx")).drop("_key")
    return few.unionByName(dense_index(many, table, F.col("row_idx"), hot=hot))


def table_sizes(results: DataFrame) -> DataFrame:
    """Rows and width of every result table that has rows."""
    return results.groupBy("query_id", "side", "variant").agg(
        F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("width")
    )


def pair_list(results: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per (query, expected variant): the sizes n (prediction) and m (expected).

    An empty table has no rows in ``results``. ``runs(query_id, side, variant)`` lists the tables
    that exist; without it, the tables with rows are taken.
    """
    sizes = table_sizes(results).withColumn("listed", F.lit(runs is None))
    if runs is not None:
        empty = runs.select("query_id", "side", "variant", F.lit(0).cast("bigint").alias("n_rows"), F.lit(0).alias("width"))
        sizes = (
            sizes.unionByName(empty.withColumn("listed", F.lit(True)))
            .groupBy("query_id", "side", "variant")
            .agg(F.max("n_rows").alias("n_rows"), F.max("width").alias("width"), F.bool_or("listed").alias("listed"))
        )
    is_pred = F.col("side") == "p"
    gold = F.struct("variant", F.col("n_rows").alias("m"), F.col("width").alias("g_width"))
    queries = (
        sizes.where("listed")
        .groupBy("query_id")
        .agg(
            F.max(F.when(is_pred, F.col("n_rows"))).alias("n"),
            F.max(F.when(is_pred, F.col("width"))).alias("p_width"),
            F.collect_list(F.when(~is_pred, gold)).alias("gold"),
        )
    )
    if runs is not None:
        queries = queries.where("n IS NOT NULL")
    zero = F.lit(0)
    return queries.select("query_id", "n", "p_width", F.explode("gold").alias("g")).select(
        "query_id",
        "g.variant",
        F.coalesce("n", zero.cast("bigint")).alias("n"),
        "g.m",
        F.coalesce("p_width", zero).alias("p_width"),
        "g.g_width",
    )


PAIR = ["query_id", "variant"]
SIZES = ["n", "m", "p_width", "g_width"]


def pair_sides(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both sides keyed by (query, expected variant), each with the sizes of its pair.

    The prediction is repeated once per variant. Rows meet the pair list chunk by chunk, so the
    join key of a huge result is split as finely as its rows.
    """
    last = F.shiftright(F.greatest(F.col("n"), F.col("m"), F.lit(1)) - 1, CHUNK_BITS)
    chunks = pairs.select(*PAIR, *SIZES, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk"))
    cut = results.withColumn("_chunk", F.shiftright("row_idx", CHUNK_BITS)).alias("r")
    same = (
        (F.col("r.query_id") == F.col("c.query_id"))
        & (F.col("r._chunk") == F.col("c._chunk"))
        & ((F.col("r.side") == "p") | (F.col("r.variant") == F.col("c.variant")))
    )
    return cut.join(chunks.alias("c"), same).select("c.query_id", "c.variant", "r.side", "r.row_idx", "r.cells", *[f"c.{x}" for x in SIZES])


def by_position(sided: DataFrame) -> DataFrame:
    """Line up row i of the prediction with row i of the expected table."""

    def side(name: str, out: str) -> DataFrame:
        return sided.where(F.col("side") == name).select(
            *PAIR, "row_idx", C.ordered_keys(F.col("cells")).alias(out)
        )

    return side("p", "p").join(side("g", "g"), [*PAIR, "row_idx"], "full")


def merge_pairs(*parts: DataFrame) -> DataFrame:
    """Bring figures per pair together in one aggregation instead of a chain of joins."""
    names = [name for part in parts for name in part.columns if name not in PAIR]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole.groupBy(*PAIR).agg(*[F.max(name).alias(name) for name in dict.fromkeys(names)])
