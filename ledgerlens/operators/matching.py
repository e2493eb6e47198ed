"""Heaviest matchings of large pairs of result tables, spread over tasks.

The weight of a row pair is a whole number from 0 to the row width, so prices need few levels. All prediction rows start
at the greatest weight of their pair, all expected rows at 0. A pair is *tight* when its weight is the sum of both prices. A
phase grows trees of tight pairs from all unmatched prediction rows at once, one job per step, each expected row joining
one tree. Trees that reach an unmatched expected row flip the pairs on the way to it; trees are disjoint, so all flips of
a phase hold together. If no tree of a pair of tables does, its trees' prediction rows get cheaper by 1 and their expected rows dearer by 1.
Unmatched prediction rows are then all at one level, which falls once per such phase: at 0 the matching is heaviest, as every
weight is at most the sum of its prices and unmatched rows are worth 0.

Weights stay in blocks of ``block`` x ``block`` rows, one or two bytes each, written once; what moves per step is a number or
two per row. All large pairs go through the phases together, and no task sees more than a block and what of the state lies along it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import ledgerlens
from ledgerlens.functions.alignment import overlaps
from ledgerlens.operators.rows import PAIR, dense_index
from ledgerlens.session import stage

BLOCK = 2048
_TURN = 7919  # a prime: how far apart two neighbouring rows begin

cloudpickle.register_pickle_by_value(ledgerlens)


def _weights(nodes: DataFrame, block: int) -> DataFrame:
    """The shared cells of all row pairs in blocks: (query_id, variant, i, j, wide, most, w)."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("at", "marks"))), lambda r: r["marks"])
    lists = nodes.groupBy(*PAIR, "side", F.floor(F.col("at") / block).cast("int").alias("k")).agg(line.alias("rows"))
    p = lists.where("side = 'p'").select(*PAIR, F.col("k").alias("i"), F.col("rows").alias("p"))
    g = lists.where("side = 'g'").select(*PAIR, F.col("k").alias("j"), F.col("rows").alias("g"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shared in enumerate(overlaps(batch.column("p"), batch.column("g"))):
                most = int(shared.max(initial=0))
                kept = [batch.column(c).slice(k, 1) for c in (*PAIR, "i", "j")]
                packed = shared.astype(np.uint8 if most < 256 else np.uint16).tobytes()
                new = [pa.array([shared.shape[1]], pa.int32()), pa.array([most], pa.int32()), pa.array([packed], pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=[*PAIR, "i", "j", "wide", "most", "w"])

    return p.join(g, PAIR).mapInArrow(weigh, "query_id string, variant int, i int, j int, wide int, most int, w binary")


def _tight(weights: DataFrame, frontier: DataFrame, unseen: DataFrame, block: int) -> DataFrame:
    """(query_id, variant, g, p): for each unseen expected row one prediction row of the frontier that is tight with it.

    Each expected row begins its choice elsewhere, so that rows that are tight with the same ones join many trees, not one.
    """

    def along(rows: DataFrame, place: str, out: str) -> DataFrame:
        one = F.struct((F.col("at") % block).cast("int").alias("o"), F.col("price").cast("int").alias("price"))
        kept = F.array_sort(F.collect_list(one))
        at = F.floor(F.col("at") / block).cast("int").alias(place)
        return rows.groupBy(*PAIR, at).agg(kept["o"].alias(f"{out}_o"), kept["price"].alias(f"{out}_price"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k] for c in batch.schema.names}
                p, p_price, g, g_price = (one[c].values.to_numpy(zero_copy_only=False) for c in ("p_o", "p_price", "g_o", "g_price"))
                raw, wide = one["w"].as_buffer(), one["wide"].as_py()
                w = np.frombuffer(raw, np.uint8 if one["most"].as_py() < 256 else np.uint16).reshape(-1, wide)
                fits = w[np.ix_(p, g)].astype(np.int32) == p_price[:, None] + g_price[None, :]
                met = np.flatnonzero(fits.any(axis=0))
                if met.size:
                    turn = (np.arange(p.size)[:, None] + g[met].astype(np.int64) * _TURN) % p.size
                    whose = p[np.where(fits[:, met], turn, p.size).argmin(axis=0)].astype(np.int64) + one["i"].as_py() * block
                    keys = [pa.repeat(one[c], met.size) for c in PAIR]
                    places = [pa.array(g[met].astype(np.int64) + one["j"].as_py() * block), pa.array(whose)]
                    yield pa.RecordBatch.from_arrays([*keys, *places], names=[*PAIR, "g", "p"])

    lined = weights.join(along(frontier, "i", "p"), [*PAIR, "i"]).join(along(unseen, "j", "g"), [*PAIR, "j"])
    found = lined.mapInArrow(meet, "query_id string, variant int, g bigint, p bigint")
    return found.groupBy(*PAIR, "g").agg(F.min_by("p", F.xxhash64("p", "g")).alias("p"))


def _phase(weights: DataFrame, state: DataFrame, levels: DataFrame, block: int) -> DataFrame | None:
    """What one phase changes: (query_id, variant, side, at, mate, step), mate null where only the price moves."""
    mine = state.where("side = 'p'").select(*PAIR, "at", "price", "mate")
    theirs = state.where("side = 'g'").select(*PAIR, "at", "price", "mate")
    path = F.array().cast("array<struct<p:bigint,g:bigint>>").alias("path")
    roots = mine.where("mate IS NULL").join(levels.select(*PAIR), PAIR, "left_semi")
    frontier = stage(roots.select(*PAIR, "at", "price", F.col("at").alias("root"), path), "frontier")
    unseen = theirs.join(levels.select(*PAIR), PAIR, "left_semi")
    trees, ends = frontier.select(*PAIR, F.lit("p").alias("side"), "at"), None
    while not frontier.isEmpty():
        met = _tight(weights, frontier, unseen, block)
        grown = F.concat("path", F.array(F.struct("p", "g"))).alias("path")
        reached = stage(
            met.join(frontier.select(*PAIR, F.col("at").alias("p"), "root", "path"), [*PAIR, "p"])
            .join(theirs.select(*PAIR, F.col("at").alias("g"), "mate"), [*PAIR, "g"])
            .select(*PAIR, "g", "root", "mate", grown),
            "reached",
        )
        done = reached.where("mate IS NULL").groupBy(*PAIR, "root").agg(F.min_by("path", "g").alias("path"))
        ends = done if ends is None else ends.unionByName(done)
        onward = reached.where("mate IS NOT NULL").join(done.select(*PAIR, "root"), [*PAIR, "root"], "left_anti")
        frontier = stage(
            onward.select(*PAIR, F.col("mate").alias("at"), "root", "path").join(mine.select(*PAIR, "at", "price"), [*PAIR, "at"]).select(*PAIR, "at", "price", "root", "path"),
            "frontier",
        )
        seen = reached.select(*PAIR, F.col("g").alias("at"))
        trees = trees.unionByName(seen.select(*PAIR, F.lit("g").alias("side"), "at")).unionByName(frontier.select(*PAIR, F.lit("p").alias("side"), "at"))
        unseen = unseen.join(seen, [*PAIR, "at"], "left_anti")
    if ends is None:
        return None
    flips = ends.select(*PAIR, F.inline("path"))
    none = F.lit(None).cast("bigint").alias("mate")
    step = F.when(F.col("side") == "p", -1).otherwise(1).alias("step")
    moved = trees.join(ends.select(*PAIR).distinct(), PAIR, "left_anti").select(*PAIR, "side", "at", none, step)
    matched = [
        flips.select(*PAIR, F.lit(side).alias("side"), F.col(side).alias("at"), F.col(other).alias("mate"), F.lit(0).alias("step"))
        for side, other in (("p", "g"), ("g", "p"))
    ]
    return moved.unionByName(matched[0]).unionByName(matched[1])


def heaviest_matching(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A heaviest matching of each pair: (query_id, variant, p, g, shared), ids of the matched rows and their shared cells.

    ``rows(query_id, variant, side, id, marks)`` with ids that are whole numbers, unique per pair and side, and marks that are
    distinct within a row. Rows without a shared cell in the matching are not listed; of several heaviest matchings one is given.
    """
    nodes = stage(dense_index(rows.select(*PAIR, "side", "id", "marks"), [*PAIR, "side"], F.col("id"), out="at"), "nodes")
    weights = stage(_weights(nodes, block), "weights")
    levels = stage(weights.groupBy(*PAIR).agg(F.max("most").alias("level")).where("level > 0"), "levels")
    price = F.when(F.col("side") == "p", F.col("level")).otherwise(0).alias("price")
    state = stage(nodes.join(levels, PAIR).select(*PAIR, "side", "at", price, F.lit(None).cast("bigint").alias("mate")), "state")
    while not levels.isEmpty():
        changes = _phase(weights, state, levels, block)
        if changes is None:
            break
        what = changes.groupBy(*PAIR, "side", "at").agg(F.max("mate").alias("new"), F.sum("step").alias("step"))
        state = stage(
            state.join(what, [*PAIR, "side", "at"], "left").select(
                *PAIR, "side", "at", (F.col("price") + F.coalesce("step", F.lit(0))).cast("int").alias("price"), F.coalesce("new", "mate").alias("mate")
            ),
            "state",
        )
        free = state.where("side = 'p' AND mate IS NULL").groupBy(*PAIR).agg(F.min("price").alias("level"))
        levels = stage(free.where("level > 0"), "levels")
    pairs = state.where("side = 'p' AND mate IS NOT NULL").select(*PAIR, F.col("at").alias("p_at"), F.col("mate").alias("g_at"))
    sides = [nodes.where(F.col("side") == s).select(*PAIR, F.col("at").alias(f"{s}_at"), F.col("id").alias(s), F.col("marks").alias(f"{s}_marks")) for s in ("p", "g")]
    met = pairs.join(sides[0], [*PAIR, "p_at"]).join(sides[1], [*PAIR, "g_at"])
    return met.select(*PAIR, "p", "g", F.size(F.array_intersect("p_marks", "g_marks")).alias("shared"))
