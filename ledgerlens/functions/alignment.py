"""Small array kernels that run inside Arrow tasks.

A task sees a batch of pairs of result tables. The matrix of shared cells takes four bytes per entry; what
is derived from it is worked out a block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 4096
_DIRECT = 1 << 20
_ENTRIES = 1 << 22  # matrix entries that are worked on at a time


def _place(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the rows of each pair, and of the cells of each row."""
    outer = rows.offsets.to_numpy()
    inner = rows.values.offsets.to_numpy()
    return outer, inner


def _cell_marks(p: pa.ListArray, g: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per side the row of every cell and its mark: a whole number for (pair, key, occurrence in the row). Rows are lists of cell keys."""
    sides = [_place(x) for x in (p, g)]
    keys = [x.values.values[inner[outer[0]] : inner[outer[-1]]] for x, (outer, inner) in zip((p, g), sides)]
    codes = pa.concat_arrays(keys).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds = int(codes.max(initial=0)) + 1
    out = []
    for own, (outer, inner) in zip((codes[: len(keys[0])], codes[len(keys[0]) :]), sides):
        widths = np.diff(inner[outer[0] : outer[-1] + 1])
        row = np.repeat(np.arange(widths.size), widths)
        pair = np.repeat(np.arange(len(outer) - 1), np.diff(outer))
        held = row * kinds + own
        order = np.argsort(held, kind="stable")
        first = np.flatnonzero(np.diff(held[order], prepend=-1))
        seen = np.empty(row.size, np.int64)
        seen[order] = np.arange(row.size) - np.repeat(first, np.diff(first, append=row.size))
        out.append((row, pair[row] * kinds + own, seen))
    most = max(int(seen.max(initial=0)) for *_, seen in out) + 1
    return [(row, mark * most + seen) for row, mark, seen in out]


def meetings(p: pa.ListArray, g: pa.ListArray, most: int = _ENTRIES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Meetings of rows in a shared cell, about ``most`` at a time: from and to which prediction row, the prediction row and the expected row of each.

    Rows are numbered through the batch. The marks of the expected rows are an index that the prediction rows look up, so no pair of rows without a shared cell is touched.
    """
    (row_p, mark_p), (row_g, mark_g) = _cell_marks(p, g)
    order = np.argsort(mark_g, kind="stable")
    index = mark_g[order]
    low = np.searchsorted(index, mark_p, "left")
    met = np.searchsorted(index, mark_p, "right") - low
    rows = int(np.diff(p.offsets.to_numpy()[[0, -1]])[0])
    edge = np.searchsorted(row_p, np.arange(rows + 1))
    before = np.concatenate([[0], np.cumsum(met)])[edge]
    start = 0
    while start < rows:
        end = max(start + 1, int(np.searchsorted(before, before[start] + most, "right")) - 1)
        here = slice(edge[start], edge[end])
        count = met[here]
        place = np.repeat(low[here] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        yield start, end, np.repeat(row_p[here], count), row_g[order[place]]
        start = end


def row_overlaps(p: pa.ListArray, g: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each prediction row of the batch: expected rows that share a cell, the most shared cells and the sum of shared cells."""
    parts = [(np.zeros(0, np.int64),) * 3]
    rows_g = len(g.values)
    for start, end, at, other in meetings(p, g):
        edge, shared = np.unique((at - start) * rows_g + other, return_counts=True)
        place = edge // max(rows_g, 1)
        partners = np.bincount(place, minlength=end - start)
        most = np.zeros(end - start, np.int64)
        np.maximum.at(most, place, shared)
        parts.append((partners, most, np.bincount(at - start, minlength=end - start)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def overlap_lines(p: pa.ListArray, g: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of a batch line by line in one array, and where each line begins and the last one ends."""
    (rows_p, _), (rows_g, _) = _place(p), _place(g)
    n, m = np.diff(rows_p), np.diff(rows_g)
    lines = np.concatenate([[0], np.cumsum(np.repeat(m, n))])
    first = np.repeat(rows_g[:-1] - rows_g[0], n)
    out = np.zeros(lines[-1], np.int32)
    for start, end, at, other in meetings(p, g):
        low, high = lines[start], lines[end]
        out[low:high] = np.bincount(lines[at] - low + other - first[at], minlength=high - low)
    return out, lines


def overlaps(p: pa.ListArray, g: pa.ListArray) -> Iterator[np.ndarray]:
    """Shared cells of every row pair, one matrix per pair of tables.

    Rows are lists of occurrence-numbered cell keys, each distinct within its row. The keys of a
    whole batch are coded once.
    """
    (rows_p, cells_p), (rows_g, cells_g) = _place(p), _place(g)
    keys_p, keys_g = p.values.values, g.values.values
    codes = pa.concat_arrays([keys_p, keys_g]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    codes_p, codes_g = codes[: len(keys_p)], codes[len(keys_p) :]
    for k in range(len(p)):
        edge_p, edge_g = cells_p[rows_p[k] : rows_p[k + 1] + 1], cells_g[rows_g[k] : rows_g[k + 1] + 1]
        a, b = codes_p[edge_p[0] : edge_p[-1]], codes_g[edge_g[0] : edge_g[-1]]
        yield _overlap(a, edge_p - edge_p[0], b, edge_g - edge_g[0])


def _overlap(a: np.ndarray, edge_a: np.ndarray, b: np.ndarray, edge_b: np.ndarray) -> np.ndarray:
    n, m = len(edge_a) - 1, len(edge_b) - 1
    if a.size == 0 or b.size == 0:
        return np.zeros((n, m), dtype=np.int64)
    at_a, at_b = np.repeat(np.arange(n), np.diff(edge_a)), np.repeat(np.arange(m), np.diff(edge_b))
    if a.size * b.size <= _DIRECT:
        i, j = np.nonzero(a[:, None] == b[None, :])
        return np.bincount(at_a[i] * m + at_b[j], minlength=n * m).reshape(n, m)
    shared = np.intersect1d(a, b)
    out = np.zeros((n, m), dtype=np.int32)
    lines = max(1, min(_BLOCK, _ENTRIES // max(1, min(shared.size, _BLOCK))))
    for start in range(0, shared.size, _BLOCK):
        some = shared[start : start + _BLOCK]

        def marked(codes: np.ndarray, edge: np.ndarray, low: int) -> np.ndarray:
            high = min(low + lines, len(edge) - 1)
            part = codes[edge[low] : edge[high]]
            at = np.repeat(np.arange(high - low), np.diff(edge[low : high + 1]))
            place = np.minimum(np.searchsorted(some, part), some.size - 1)
            here = some[place] == part
            matrix = np.zeros((high - low, some.size), np.float32)
            matrix[at[here], place[here]] = 1.0
            return matrix

        for low in range(0, m, lines):
            right = marked(b, edge_b, low)
            for top in range(0, n, lines):
                left = marked(a, edge_a, top)
                out[top : top + lines, low : low + lines] += np.rint(left @ right.T).astype(np.int32)
    return out


def best_in_order(overlap: np.ndarray) -> int:
    """Heaviest matching without crossings."""
    return int(block_in_order(overlap)[0][-1])


def block_in_order(overlap: np.ndarray, top: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence over one block of a matrix: its last line and its last column, corners included.

    ``top`` and ``left`` are the last line of the block above and the last column of the block before; zeros at the rim.
    """
    n, m = overlap.shape
    best = np.zeros(m + 1, dtype=np.int64) if top is None else np.array(top, dtype=np.int64)
    right = np.empty(n + 1, dtype=np.int64)
    right[0] = best[-1]
    for i, row in enumerate(overlap, 1):
        best[1:] = np.maximum(best[1:], best[:-1] + row)
        best[0] = 0 if left is None else left[i]
        best = np.maximum.accumulate(best)
        right[i] = best[-1]
    return best, right


def best_matching(overlap: np.ndarray) -> np.ndarray:
    """Heaviest bipartite matching: the column of each row, -1 where unmatched.

    An auction on whole numbers. The smaller side bids; of n bidders each needs only its n best
    columns. Weights are scaled by the matrix size and the increment falls to 1, which makes the
    result exact. Bidders look for the best column from their own starting point, so that equal
    bidders do not all fight for the same one.
    """
    if overlap.shape[0] > overlap.shape[1]:
        partner = best_matching(overlap.T)
        out = np.full(overlap.shape[0], -1)
        out[partner[partner >= 0]] = np.flatnonzero(partner >= 0)
        return out
    out = np.full(overlap.shape[0], -1)
    bidders = np.flatnonzero(overlap.any(axis=1))
    if bidders.size == 0:
        return out
    small = overlap[bidders]
    wish = small.argmax(axis=1)
    if np.unique(wish).size == wish.size:
        out[bidders] = wish
        return out
    columns = np.arange(small.shape[1])
    if bidders.size < columns.size:
        lines = max(1, _ENTRIES // columns.size)
        parts = (np.argpartition(-small[k : k + lines], bidders.size - 1, axis=1)[:, : bidders.size] for k in range(0, bidders.size, lines))
        wanted = np.zeros(columns.size, dtype=bool)
        for part in parts:
            wanted[part] = True
        columns = np.flatnonzero(wanted)
    held = _auction(small[:, columns])
    partner = np.where(held < columns.size, columns[np.minimum(held, columns.size - 1)], -1)
    out[bidders] = np.where((partner >= 0) & (small[np.arange(bidders.size), partner] > 0), partner, -1)
    return out


def _auction(overlap: np.ndarray) -> np.ndarray:
    n, m = overlap.shape
    size = max(n, m)
    price = np.zeros(size, dtype=np.int64)
    step = max(int(overlap.max()) * (size + 1) // 4, 1)
    lines = max(1, _ENTRIES // size)

    def wishes(bidders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        line = np.arange(bidders.size)
        profit = np.repeat(-price[None, :], bidders.size, axis=0)
        real = bidders < n
        profit[real, :m] += overlap[bidders[real]].astype(np.int64) * (size + 1)
        start = (np.arange(size)[None, :] - bidders[:, None]) % size
        choice = (profit * size + start).argmax(axis=1)
        top = profit[line, choice]
        profit[line, choice] = np.iinfo(np.int64).min
        return choice, top, profit.max(axis=1) if size > 1 else top

    while True:
        held, owner, free = np.full(size, -1), np.full(size, -1), np.arange(size)
        while free.size:
            parts = [wishes(free[k : k + lines]) for k in range(0, free.size, lines)]
            choice, top, second = (np.concatenate(x) for x in zip(*parts))
            bid = price[choice] + top - second + step
            rank = np.lexsort((free, -bid, choice))
            winner = rank[np.r_[True, choice[rank][1:] != choice[rank][:-1]]]
            won = choice[winner]
            losers = owner[won]
            price[won], owner[won] = bid[winner], free[winner]
            held[losers[losers >= 0]] = -1
            held[free[winner]] = won
            free = np.r_[np.delete(free, winner), losers[losers >= 0]]
        if step == 1:
            return held[:n]
        step = max(step // 5, 1)
