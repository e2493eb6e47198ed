"""Periodic runs of words: stretches that repeat themselves, found through suffix trees.

Every run has a Lyndon root under one of the two orders of the words (the given one and its reverse), and that root is the longest
Lyndon word starting there. So the candidates of a sequence are, for each place and each order, the longest Lyndon word that
starts at the place (it ends where the next smaller suffix starts). A candidate is extended to the right by the longest common extension (LCE)
of two suffixes and to the left by that of two suffixes of the reversal. An LCE is the depth of the lowest common
ancestor of two leaves of a suffix tree; it is a range minimum over the Euler tour of the tree, answered in constant
time from block minima. The trees of the sequence and its reversal are built by Ukkonen's algorithm.

Trees are built for the stretches of a document that can hold a run. A run of period q and length L >= max(24, 3q) has
L >= 2q + 8, so each of its windows of 9 words occurs a second time in the document, q words away. Stretches without such windows hold no run, and
a run never leaves a stretch, so nothing is lost; hashes of windows decide, and equal hashes of unequal windows only lengthen a stretch.

Cases: a null text has no words; documents without words have no runs and the digest of the empty text; equal rows give equal
results; a document without an id is never changed by ``plant``; texts of any length are searched whole (a stretch of n repeating words takes
about 700 bytes a word, as measured on 200,000 words); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import map_rows

# Least length of a run in words and in periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of a window; with the fixed values above every window of a run occurs twice.
WINDOW = 9
#: Entries of the Euler tour in a block of the range minimum.
BLOCK = 32
#: Queries answered at a time.
QUERIES = 1 << 16


class SuffixTree:
    """Ukkonen's tree of a sequence of whole numbers (at least 0), closed by an end mark that equals nothing else.

    Node 0 is the root. ``start`` and ``end`` bound the label of the edge into a node; a leaf's end is the end of the sequence.
    Children are kept in one dictionary under node * width + symbol.
    """

    def __init__(self, symbols: list[int]) -> None:
        self.n = len(symbols)
        mark = max(symbols, default=-1) + 1
        self.width = width = mark + 1
        text = [*symbols, mark]
        size = len(text)
        start, end, link = [-1], [-1], [0]
        child: dict[int, int] = {}
        node, at, length, waiting = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            last = 0  # the inner node made last in this step
            waiting += 1
            while waiting:
                if not length:
                    at = i
                key = node * width + text[at]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(size)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    edge = min(end[below], i + 1) - start[below]
                    if length >= edge:
                        at += edge
                        length -= edge
                        node = below
                        continue
                    if text[start[below] + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += (start[below], i)
                    end += (start[below] + length, size)
                    link += (0, 0)
                    child[key] = split
                    child[split * width + symbol] = split + 1
                    start[below] += length
                    child[split * width + text[start[below]]] = below
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1
        edges = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        self.nodes = np.fromiter(child.values(), dtype=np.int64, count=len(child))
        self.parents, self.firsts = np.divmod(edges, width)
        self.start = np.array(start, dtype=np.int64)
        self.end = np.array(end, dtype=np.int64)
        self.mark = mark

    def _children(self, reverse: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes in order of their first symbols (the end mark first), and where those of a node begin."""
        first = np.where(self.firsts == self.mark, -1, self.mark - self.firsts if reverse else self.firsts)
        order = np.lexsort((first, self.parents))
        count = np.bincount(self.parents, minlength=len(self.start))
        return self.nodes[order].tolist(), np.concatenate([[0], np.cumsum(count)]).tolist()

    def suffix_order(self, reverse: bool) -> np.ndarray:
        """Starts of the suffixes in order (words in the reverse order if asked; a prefix is smaller either way)."""
        children, begin = self._children(reverse)
        length = (self.end - self.start).tolist()
        size, out = self.n + 1, []
        stack, depths = [0], [0]
        while stack:
            node, depth = stack.pop(), depths.pop()
            low, high = begin[node], begin[node + 1]
            if low == high:
                out.append(size - depth)
                continue
            for below in reversed(children[low:high]):
                stack.append(below)
                depths.append(depth + length[below])
        order = np.array(out, dtype=np.int64)
        return order[order < self.n]  # without the suffix that is the end mark alone

    def common_extensions(self) -> "CommonExtensions":
        children, begin = self._children(False)
        length = (self.end - self.start).tolist()
        size = self.n + 1
        tour, seen = [], [0] * size
        # a node is entered once for each child and once more: its depth stands between its children
        stack = [(0, 0, begin[0])]
        while stack:
            node, depth, nxt = stack.pop()
            low, high = begin[node], begin[node + 1]
            if low == high:
                seen[size - depth] = len(tour)
                tour.append(depth)
                continue
            tour.append(depth)
            if nxt < high:
                stack.append((node, depth, nxt + 1))
                below = children[nxt]
                stack.append((below, depth + length[below], begin[below]))
        return CommonExtensions(np.array(tour, dtype=np.int32), np.array(seen, dtype=np.int64))


class CommonExtensions:
    """Longest common prefixes of suffixes: the least depth on the Euler tour between their leaves."""

    def __init__(self, tour: np.ndarray, leaf: np.ndarray) -> None:
        self.leaf = leaf
        blocks = -(-len(tour) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        padded[: len(tour)] = tour
        table = padded.reshape(blocks, BLOCK)
        self.flat = padded
        self.from_left = np.minimum.accumulate(table, axis=1).ravel()
        self.from_right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [table.min(axis=1)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            step = 1 << len(self.levels) - 1
            above = self.levels[-1]
            self.levels.append(np.minimum(above[:-step], above[step:]))

    def minima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least tour entries from ``low`` to ``high``, both included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.from_right[low], self.from_left[high])
        between = b - a - 1
        wide = np.flatnonzero(between > 0)
        level = np.frexp(between[wide].astype(np.float64))[1] - 1
        for k in np.unique(level):
            rows = wide[level == k]
            whole = self.levels[k]
            out[rows] = np.minimum(out[rows], np.minimum(whole[a[rows] + 1], whole[b[rows] - (1 << int(k))]))
        same = np.flatnonzero(a == b)
        if len(same):
            columns = np.arange(BLOCK)
            at = low[same, None] + columns[None, :]
            inside = np.where(at <= high[same, None], self.flat[np.minimum(at, len(self.flat) - 1)], np.iinfo(np.int32).max)
            out[same] = inside.min(axis=1)
        return out

    def lengths(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """LCE of the suffixes that start at ``one`` and ``two`` (different ones)."""
        out = np.zeros(len(one), dtype=np.int64)
        for begin in range(0, len(one), QUERIES):
            part = slice(begin, begin + QUERIES)
            a, b = self.leaf[one[part]], self.leaf[two[part]]
            out[part] = self.minima(np.minimum(a, b), np.maximum(a, b))
        return out


def longest_lyndon(order: np.ndarray) -> np.ndarray:
    """Lengths of the longest Lyndon words by start, from the order of the suffixes: up to the next smaller suffix."""
    n = len(order)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    rank = rank.tolist()
    out, open_ = [0] * n, []
    for i in range(n - 1, -1, -1):
        while open_ and rank[open_[-1]] > rank[i]:
            open_.pop()
        out[i] = (open_[-1] if open_ else n) - i
        open_.append(i)
    return np.array(out, dtype=np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` words and ``periods`` (at least 2) periods, by start, then period."""
    n = len(symbols)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < max(2, least):
        return none
    dense = np.unique(symbols, return_inverse=True)[1]
    tree = SuffixTree(dense.tolist())
    starts, root = [], []
    for reverse in (False, True):
        word = longest_lyndon(tree.suffix_order(reverse))
        starts.append(np.arange(n))
        root.append(word)
    start, period = np.concatenate(starts), np.concatenate(root)
    fits = periods * period <= n
    start, period = np.unique(np.stack([start[fits], period[fits]]), axis=1)
    forward = tree.common_extensions()
    del tree
    right = np.zeros(len(start), dtype=np.int64)
    inner = np.flatnonzero(start + period < n)
    right[inner] = forward.lengths(start[inner], start[inner] + period[inner])
    del forward
    backward = SuffixTree(dense[::-1].tolist()).common_extensions()
    left = np.zeros(len(start), dtype=np.int64)
    inner = np.flatnonzero(start > 0)
    # the prefix that ends before place i is the suffix of the reversal that starts at n - i
    left[inner] = backward.lengths(n - start[inner], n - start[inner] - period[inner])
    length = left + period + right
    kept = (length >= periods * period) & (length >= least)
    found = np.unique(np.stack([start[kept] - left[kept], period[kept], length[kept]], axis=1), axis=0)
    return found[:, [0, 2, 1]] if len(found) else none


def stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Maximal stretches [begin, end) whose windows all occur at least twice; only they can hold runs."""
    n = len(symbols) - WINDOW + 1
    if n < 2:
        return []
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h = (h ^ symbols[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
    return [(int(a), int(b) + WINDOW - 1) for a, b in zip(edge[::2], edge[1::2]) if b - a + WINDOW - 1 >= LEAST_WORDS]


def document_runs(symbols: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of a whole document, by start, then period."""
    parts = [runs_of(symbols[a:b]) + np.array([[a, 0, 0]]) for a, b in stretches(symbols)]
    found = np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, and those of each run's first period that no other run drops."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def strongest(found: np.ndarray) -> tuple[int, int, int, int] | None:
    """(start, length, period, exponent in thousandths) of the run with the greatest length over period; ties: smallest start, then period."""
    best = None
    for start, length, period in found.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best and (*best, 1000 * best[1] // best[2])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()  # of bytes: blanks, tabs, line ends, vertical tabs and form feeds only


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def plant(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each of n places: one document in ten is made periodic from a drawn place on."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + (at[a:] - a) % p
    return at


def find_runs(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length, period), strongest (the same and exponent_milli; null without runs), collapsed (text) for every row.

    ``planted`` examines the documents as ``plant`` changes them.
    """
    run = "struct<start: bigint, length: bigint, period: bigint"
    schema = f"doc_id bigint, n_words bigint, runs array<{run}>>, strongest {run}, exponent_milli: bigint>, collapsed binary"
    names = ("start", "length", "period", "exponent_milli")

    def kernel(row: tuple) -> tuple:
        words = words_of(row[1])
        symbols = numbered(words)
        if planted:
            place = plant(row[0], len(words))
            symbols, words = symbols[place], [words[i] for i in place.tolist()]
        found = document_runs(symbols)
        best = strongest(found)
        kept = words
        if len(found):
            kept = [w for w, stays in zip(words, collapsed(len(words), found).tolist()) if stays]
        return row[0], len(words), [dict(zip(names, r)) for r in found.tolist()], best and dict(zip(names, best)), b" ".join(kept)

    raw = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return map_rows(raw, ["doc_id", "text"], schema, kernel).withColumn("collapsed", F.col("collapsed").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """The number of runs, the strongest one, and digests of all runs and of the collapsed text, of documents as ``plant`` changes them."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return find_runs(docs, planted=True).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.*",
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
