"""Links between near vectors through an inverted multi-index.

The halves of the normalised vectors have a codebook each (k-means on a bounded sample); the product of both is the
grid of cells. A vector lives in the cell of its nearest codewords and asks further cells in the order of
multi-sequence traversal: cell (i, j) costs a(i) + b(j), where a and b are the squared distances to the
walls between the own and the other codeword of each half. The traversal ends at the cost below which
``RECALL`` of pairs at the very threshold lie, measured on the sample with vectors turned by the threshold's
angle in random directions; nearer pairs are found more often. Of two cells the one with the smaller number asks the other, so a pair
meets once. Every row is indexed. What is found is verified by cosine in double precision on the whole vectors.

Codewords grow with the root of the rows of the largest label, so that its cells keep between ``CELL_ROWS`` / 2 and 2 * ``CELL_ROWS`` rows on average: the rows that one
row meets grow far slower than the table. The sample allows ``FINEST`` codewords (some 500 million rows of a label); beyond that
cells grow, and are cut into chunks.

Equal vectors of one label are one class from the start (an aggregate), so copies never meet pairwise. Links are counted
and joined to a forest inside the tasks; no list of pairs leaves them.

Cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components link with nothing.
Vectors of different dimension do not link. Rows with equal ids are separate vectors, and the smallest id counts. A row without an id gets
the component of its class, null if no linked row has an id, and ``kept`` is false. Each row counts every other row that it links with.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.cells import compare_in_cells, forest
from ledgerlens.llm.components import components
from ledgerlens.session import stage

THRESHOLD = 0.93
RECALL = 0.999
#: Vectors that the codebooks are fitted on.
SAMPLE = 8_192
#: Rows of a cell that the grid aims at. A finer grid trades comparisons for visits; every grid meets the target recall.
CELL_ROWS = 1_000
#: Least and most codewords per half; the most leaves 16 rows of the sample to a codeword.
COARSEST, FINEST = 4, SAMPLE // 16
#: Home or query rows of one cell that meet in one group.
CHUNK = 1_024
#: Rows of a frame that leave a task at once.
FRAME = 1 << 16
ROUNDS = 12


def _squares(p: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum(0, (p**2).sum(1)[:, None] - 2 * p @ codes.T + (codes**2).sum(1))


def codebook(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means; fewer codewords where there are fewer points."""
    points = np.unique(points, axis=0)
    k = min(k, len(points))
    codes = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(points, codes).argmin(1)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=k)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def walls(p: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and the squared distance to the wall between it and every other."""
    squares = _squares(p, codes)
    own = squares.argmin(1)
    gap = np.sqrt(_squares(codes, codes))[own]
    over = squares - squares[np.arange(len(p)), own][:, None]
    return own, np.where(gap > 0, over / (2 * np.where(gap > 0, gap, 1)), 0.0) ** 2


@dataclass(frozen=True)
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    reach: float

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own cell of each row, and the cells within reach in the order of the traversal."""
        half, width = self.first.shape[1], len(self.second)
        own_a, a = walls(x[:, :half], self.first)
        own_b, b = walls(x[:, half:], self.second)
        own = own_a * width + own_b
        seen = []
        for i in range(len(x)):
            # both sequences ascend, so what is within reach is a staircase of the sorted product
            ia = np.flatnonzero(a[i] <= self.reach)
            ib = np.flatnonzero(b[i] <= self.reach)
            cost = np.add.outer(a[i][ia], b[i][ib])
            row, column = np.nonzero(cost <= self.reach)
            cells = ia[row] * width + ib[column]
            seen.append(cells[np.argsort(cost[row, column], kind="stable")])
        return own, seen


def fit_index(sample: np.ndarray, k: int, threshold: float, recall: float) -> MultiIndex:
    """``sample`` holds normalised rows."""
    half = sample.shape[1] // 2
    first, second = codebook(sample[:, :half], k, 1), codebook(sample[:, half:], k, 2)
    turn = np.random.default_rng(3).standard_normal(sample.shape)
    turn -= (turn * sample).sum(1)[:, None] * sample
    length = np.linalg.norm(turn, axis=1)
    turned = threshold * sample + np.sqrt(1 - threshold**2) * turn / np.where(length > 0, length, 1)[:, None]
    _, a = walls(sample[:, :half], first)
    _, b = walls(sample[:, half:], second)
    there_a, _ = walls(turned[:, :half], first)
    there_b, _ = walls(turned[:, half:], second)
    row = np.arange(len(sample))
    return MultiIndex(first, second, float(np.quantile(a[row, there_a] + b[row, there_b], recall)))


def _unit(vectors: list[bytes], width: int) -> np.ndarray:
    """Rows of double precision, normalised; shorter vectors are filled with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v)
        row = row / np.abs(row).max()  # keeps the squares of very large and very small numbers in range
        out[i, : len(row)] = row / np.sqrt(row @ row)
    return out


def _packed():
    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        """Doubles as bytes; null for a vector that links with nothing."""

        def one(v):
            if v is None or not len(v):
                return None
            x = np.asarray(v, dtype=np.float64)
            return x.tobytes() if np.isfinite(x).all() and x.any() else None

        return vectors.map(one)

    return packed


def _placed(index: MultiIndex, width: int):
    def run(frames):
        for frame in frames:
            for start in range(0, len(frame), 2_048):
                part = frame.iloc[start : start + 2_048]
                if not len(part):
                    continue
                own, seen = index.visits(_unit(part["v"].tolist(), width))
                # one row at home, one for each cell to ask: its own and those of higher number, the others ask it
                asked = [cells[cells >= o] for o, cells in zip(own, seen)]
                times = np.array([1 + len(cells) for cells in asked])
                row = np.repeat(np.arange(len(part)), times)
                grid = np.concatenate([np.concatenate(([o], cells)) for o, cells in zip(own, asked)])
                home = np.zeros(len(row), dtype=bool)
                home[np.cumsum(times) - times] = True
                for cut in range(0, len(row), FRAME):
                    here = row[cut : cut + FRAME]
                    yield pd.DataFrame(
                        {
                            "space": part["space"].to_numpy()[here],
                            "grid": grid[cut : cut + FRAME].astype(np.int32),
                            "at_home": home[cut : cut + FRAME],
                            "lives": own[here].astype(np.int32),
                            "cid": part["cid"].to_numpy()[here],
                            "n": part["n"].to_numpy()[here],
                            "v": part["v"].to_numpy()[here],
                        }
                    )

    return run


_PLACED = "space bigint, grid int, at_home boolean, lives int, cid bigint, n bigint, v binary"
_FOUND = "a bigint, b bigint, links bigint"


def _verify(threshold: float, width: int):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        cid = rows["cid"].to_numpy(np.int64)
        ids, where, node = np.unique(cid, return_index=True, return_inverse=True)
        unit = _unit(rows["v"].iloc[where].tolist(), width)
        own = rows["lives"].to_numpy(np.int64)[where]
        n = rows["n"].to_numpy(np.int64)[where]
        links = np.zeros(len(ids), dtype=np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        home = rows["at_home"].to_numpy(bool)
        space, grid, part = (rows[c].to_numpy(np.int64) for c in ("space", "grid", "part"))
        order = np.lexsort((~home, grid, space, part))
        keys = np.stack([part, space, grid])[:, order]
        starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)])
        for start, stop in zip(starts, np.r_[starts[1:], len(order)]):
            group = order[start:stop]
            at_home = home[group]
            homes, asks = node[group[at_home]], node[group[~at_home]]
            if not len(homes) or not len(asks):
                continue
            q, h = np.nonzero(unit[asks] @ unit[homes].T >= threshold)
            x, y = asks[q], homes[h]
            x, y = x[x != y], y[x != y]
            np.add.at(links, x, n[y])
            # inside a cell y asks as well and counts x itself; another cell is asked from one side only
            back = own[x] != grid[group[0]]
            np.add.at(links, y[back], n[x[back]])
            a.append(x)
            b.append(y)
        root = forest(len(ids), np.concatenate(a), np.concatenate(b))
        told = np.flatnonzero(links)
        return pd.DataFrame({"a": ids[told], "b": ids[root[told]], "links": links[told]})

    return kernel


def _grid_for(rows: int) -> int:
    """Codewords per half for a label of so many vectors."""
    k = COARSEST
    while k < FINEST and 2 * CELL_ROWS * k * k < rows:
        k *= 2
    return k


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, codewords: int | None = None, chunk: int = CHUNK, sample: int = SAMPLE
) -> DataFrame:
    """``rows(vec_id, embedding, label)`` to vec_id, n_links, component_id, kept. ``recall`` is the target for pairs at the threshold."""
    vectors = stage(rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", _packed()(F.col("embedding").cast("array<double>")).alias("v")), "vectors")
    linkable = F.col("v").isNotNull() & F.col("label").isNotNull()
    classes = stage(
        vectors.where(linkable)
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id())  # written once below, so the numbers stay
        .withColumn("space", F.xxhash64("label", F.length("v"))),
        "vector_classes",
    )
    spaces = classes.groupBy("space").agg(F.count("*").alias("rows"), F.max(F.length("v")).alias("longest"))
    count, largest, longest = spaces.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.max("rows"), F.max("longest")).first()
    alone = vectors.where(~linkable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not count:
        return _finished(alone)
    width = max(2, longest // 8)
    chosen = classes.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    index = fit_index(_unit([bytes(r["v"]) for r in chosen], width), codewords or _grid_for(largest), threshold, recall)
    placed = stage(classes.select("space", "cid", "n", "v").mapInPandas(_placed(index, width), _PLACED), "vector_cells")
    cells = placed.withColumn("cell", F.xxhash64("space", "grid"))
    found = stage(compare_in_cells(cells, "cid", _verify(threshold, width), _FOUND, chunk, placed.count()), "vector_links")
    degrees = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.select("a", "b"))
    joined = stage(
        classes.select("cid", "label", "v", "rep", "n")
        .join(degrees, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .select("label", "v", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")),
        "vector_roots",
    )
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = joined.join(least, "root").select("label", "v", "n_links", "component_id")
    linked = vectors.where(linkable).join(groups, ["label", "v"]).select("vec_id", "n_links", "component_id")
    return _finished(linked.unionByName(alone))


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
