"""Comparing rows inside the cells of an index, whatever the size of a cell.

An index gives every row one home cell and some further cells to look into. A cell with many rows is
cut into a grid of (home chunk, query chunk); the chunks of all cells are then packed into groups of
about equal size, so that one crowded cell is many tasks and many small cells are one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stage

#: Rows of a group that one task call handles.
GROUP_ROWS = 16_384


def compare_in_cells(rows: DataFrame, row_id: str, kernel: Callable, schema: str, chunk: int, total: int) -> DataFrame:
    """``rows`` has ``cell bigint``, ``at_home boolean`` and the payload. ``kernel`` takes a pandas frame of whole (cell, chunk)
    groups, with the number of the group in ``part``, and returns a frame of ``schema``. ``total`` sizes the groups."""
    # written first, so that the planner knows its size: few crowded cells are broadcast, many are joined by shuffle
    crowded = stage(
        rows.groupBy("cell")
        .agg(F.count_if("at_home").alias("n_home"), F.count_if(~F.col("at_home")).alias("n_query"))
        .where((F.col("n_home") > chunk) | (F.col("n_query") > chunk))
        .where("n_home > 0")
        .select("cell", F.ceil(F.col("n_home") / chunk).cast("int").alias("h"), F.ceil(F.greatest("n_query", F.lit(1)) / chunk).cast("int").alias("q")),
        "crowded",
    )
    one = F.lit(1)
    spread = F.xxhash64(row_id)
    cut = rows.join(crowded, "cell", "left").withColumns({"h": F.coalesce("h", one), "q": F.coalesce("q", one)})
    own = F.pmod(spread, F.when(F.col("at_home"), F.col("h")).otherwise(F.col("q")))
    others = F.sequence(F.lit(0), F.when(F.col("at_home"), F.col("q")).otherwise(F.col("h")) - 1)
    placed = cut.select("*", own.alias("own"), F.explode(others).alias("other")).select(
        *rows.columns,
        F.xxhash64(
            "cell", F.when(F.col("at_home"), F.col("own")).otherwise(F.col("other")), F.when(F.col("at_home"), F.col("other")).otherwise(F.col("own"))
        ).alias("part"),
    )
    groups = max(1, -(-total // GROUP_ROWS))
    return placed.groupBy(F.pmod("part", F.lit(groups)).alias("bucket")).applyInPandas(kernel, schema)


def candidate_blocks(part: np.ndarray, cell: np.ndarray, at_home: np.ndarray, most: int = 2_000_000):
    """Pairs (query index, home index) of rows that share part and cell, in blocks of about ``most`` pairs."""
    order = np.lexsort((~at_home, cell, part))
    p, c, h = part[order], cell[order], at_home[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    homes = np.bincount(group[h], minlength=len(start))
    asks = order[~h]
    first, count = start[group[~h]], homes[group[~h]]
    asks, first, count = asks[count > 0], first[count > 0], count[count > 0]
    done = 0
    while done < len(asks):
        sums = np.cumsum(count[done:])
        step = max(1, int(np.searchsorted(sums, most, side="right")))
        n = count[done : done + step]
        query = np.repeat(asks[done : done + step], n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield query, order[np.repeat(first[done : done + step], n) + inside]
        done += step


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node number that each node can reach over the links a-b."""
    root = np.arange(nodes)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        low, high = np.minimum(ra[open_], rb[open_]), np.maximum(ra[open_], rb[open_])
        np.minimum.at(root, high, low)
        while True:
            nearer = root[root]
            if (nearer == root).all():
                break
            root = nearer
    return root
