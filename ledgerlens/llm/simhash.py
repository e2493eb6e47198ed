"""SimHash fingerprints and exact near-duplicate links through vantage-point trees.

A fingerprint of 64 bits is two halves of 32. Fingerprints that differ in at most ``radius`` bits
differ in at most ``radius // 2`` bits on one of the halves, so one tree over each half finds them all.
A tree has one level per block of bits of its half. Its vantage points are taken from the data; a level
parts fingerprints by their Hamming distance to its vantage point within the block. Distances within a
block obey the triangle inequality, and over disjoint blocks they add up, so two fingerprints whose
distances to the vantage points differ by more than the radius in sum cannot be near: a query visits its own
shard and those shards that are at most one step away on one level, nothing else. Found candidates are
compared on all 64 bits. The result is exact for every choice of vantage points and depth.

Equal fingerprints are one class from the start (an aggregate), so copies never meet pairwise. Inside a group of shards
links are joined to a forest at once, so a dense group gives no more links than it has classes.

Cases: a null or empty text, or one without words, has fingerprint zero and links like any other. Fewer
than three words make one shingle. Rows with equal ids count once in a class; rows with a null id get
the class of their fingerprint if an identified row shares it, else a null one. An empty table gives an
empty result; further columns are not read. Texts of any length are taken in blocks of shingles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.cells import candidate_blocks, compare_in_cells, forest
from ledgerlens.llm.components import components
from ledgerlens.llm.frames import map_rows
from ledgerlens.session import stage

SEED = 42
WORDS = 3
RADIUS = 3
BITS = 64
HALF = 32
BLOCK_SHINGLES = 65_536
#: Fingerprints that the vantage points are chosen from. Any choice gives the same links.
SAMPLE = 4_096
#: Home or query rows of one shard that meet in one group.
CHUNK = 1_024
#: Levels per half and the share of random pairs that meet in a shard or its neighbours. A level costs a shuffled row per
#: fingerprint and tree, about as much as a thousand comparisons, so the least depth is taken that keeps the comparisons
#: of a fingerprint under PARTNERS. Every depth gives the same links.
DEPTHS = ((4, 2e-2), (8, 4.3e-4), (16, 3.4e-6), (32, 8e-9))
PARTNERS = 8_192


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = None
    n = 1 if hashes else len(words) - WORDS + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, BLOCK_SHINGLES):
        if hashes is None:
            part = words[start : start + BLOCK_SHINGLES + WORDS - 1]
            block = [digest(b" ".join(s), SEED) for s in zip(part, part[1:], part[2:])]
        else:
            block = hashes
        bits = np.unpackbits(np.frombuffer(b"".join(block), dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n)
    return int.from_bytes(packed.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    return map_rows(docs, [id_column, text_column], "doc_id bigint, fp bigint", lambda r: (r[0], fingerprint(r[1])))


@dataclass(frozen=True)
class Tree:
    """A vantage-point tree over one half: masks and vantage points of its levels (all as signed 64-bit numbers)."""

    half: int
    masks: tuple[int, ...]
    points: tuple[int, ...]

    def steps(self) -> list[int]:
        """The weight of each level in the number of a shard."""
        out, weight = [], 1
        for mask in self.masks:
            out.append(weight)
            weight *= bin(mask & (2**64 - 1)).count("1") + 1
        return out

    def distances(self, fp: Column) -> list[Column]:
        return [F.bit_count((fp.bitwiseXOR(F.lit(p))).bitwiseAND(F.lit(m))).cast("bigint") for m, p in zip(self.masks, self.points)]

    def cell(self, fp: Column) -> Column:
        number = F.lit(0).cast("bigint")
        for distance, step in zip(self.distances(fp), self.steps()):
            number = number + distance * F.lit(step)
        return number * 2 + self.half


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def plant(sample: np.ndarray, levels: int) -> list[Tree]:
    """One tree per half. Of the sampled fingerprints, each level takes the one that parts the sample most evenly."""
    sample = sample if len(sample) else np.zeros(1, dtype=np.int64)
    candidates = sample[:16]
    width = HALF // levels
    trees = []
    for half in range(2):
        masks, points = [], []
        for level in range(levels):
            mask = ((1 << width) - 1) << (half * HALF + level * width)
            part = np.int64(_signed(mask))
            spread = []
            for point in candidates:
                sizes = np.bincount(np.bitwise_count(((sample ^ point) & part).view(np.uint64)), minlength=width + 1)
                spread.append(int((sizes.astype(np.int64) ** 2).sum()))
            masks.append(_signed(mask))
            points.append(int(candidates[int(np.argmin(spread))]))
        trees.append(Tree(half, tuple(masks), tuple(points)))
    return trees


def depth_for(classes: int) -> int:
    return next((levels for levels, share in DEPTHS if classes * share <= PARTNERS), DEPTHS[-1][0])


def placed(classes: DataFrame, trees: list[Tree]) -> DataFrame:
    """Each class at home in one shard per tree and as a query in its own shard and, of each neighbouring pair of shards, in the
    one with the greater number, so that every pair of shards meets once."""
    places = []
    for tree in trees:
        cell = tree.cell(F.col("fp"))
        width = [bin(m & (2**64 - 1)).count("1") for m in tree.masks]
        up = [
            F.when(distance < F.lit(w), cell + F.lit(2 * step))
            for distance, w, step in zip(tree.distances(F.col("fp")), width, tree.steps())
        ]
        places.append(F.struct(cell.alias("cell"), F.lit(True).alias("at_home")))
        places += [F.struct(c.alias("cell"), F.lit(False).alias("at_home")) for c in [cell, *up]]
    rows = classes.select("fp", "rep", F.explode(F.array(*places)).alias("p"))
    return rows.where("p.cell IS NOT NULL").select("p.cell", "p.at_home", "fp", "rep")


def _links(radius: int):
    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)  # bits are counted on unsigned numbers
        rep = rows["rep"].to_numpy(np.int64)
        ids, node = np.unique(rep, return_inverse=True)
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for query, home in candidate_blocks(rows["part"].to_numpy(np.int64), rows["cell"].to_numpy(np.int64), rows["at_home"].to_numpy(bool)):
            near = np.bitwise_count(fp[query] ^ fp[home]) <= radius
            x, y = node[query[near]], node[home[near]]
            a.append(x[x != y])
            b.append(y[x != y])
        root = forest(len(ids), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]})

    return kernel


def near_links(classes: DataFrame, radius: int = RADIUS, levels: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Links between classes ``(fp, rep)``, reduced to a forest within each group of shards. ``radius`` is at most 3."""
    if not 0 <= radius <= 3:
        raise ValueError("the trees look one step around, which covers a radius of 0 to 3")
    count = classes.count()
    levels = levels or depth_for(count)
    sample = classes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).collect()
    trees = plant(np.array([r[0] for r in sample], dtype=np.int64), levels)
    return compare_in_cells(placed(classes, trees), "fp", _links(radius), "a bigint, b bigint", chunk, count * 2 * (2 + levels))


def grouped(prints: DataFrame, radius: int, levels: int | None, chunk: int) -> DataFrame:
    """(fp, n_copies, component_id) of every fingerprint in ``prints(doc_id, fp)``."""
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "classes")
    known = classes.where("rep IS NOT NULL").select("fp", "rep")
    roots = components(near_links(known, radius, levels, chunk))
    return classes.join(roots, classes["rep"] == roots["node"], "left").select("fp", "n_copies", F.coalesce("root", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, levels: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), n_copies (rows with that fingerprint)."""
    prints = stage(fingerprints(docs), "fingerprints")
    return prints.join(grouped(prints, radius, levels, chunk), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, levels: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One document of each group, with all its columns: the one whose id is the component's, of several the smallest row.

    Only ids are needed to know which documents stay; texts move once, for those that do.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    groups = stage(grouped(prints, radius, levels, chunk), "groups")
    # ids that stay are ids of the components; rows without an id stay if nothing in their class has one
    staying = groups.where("component_id IS NOT NULL").select(F.col("component_id").alias("__id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = _order(docs)
    named = docs.join(staying, docs["doc_id"] == staying["__id"], "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("__row"))
    orphans = groups.where("component_id IS NULL").select("fp")
    loose = docs.where("doc_id IS NULL").select(row.alias("__row"), order.alias("__order"), _fingerprint_column()(F.col("text")).alias("fp"))
    loose = loose.join(orphans, "fp", "left_semi").groupBy("fp").agg(F.min_by("__row", "__order").alias("__row"))
    return named.select("__row").unionByName(loose.select("__row")).select(*[F.col(f"__row.`{c}`") for c in docs.columns])


def _order(docs: DataFrame) -> Column:
    """What rows are compared by: all columns that have an order, then the others (maps) as JSON."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search(r"\b(map<|variant\b|interval\b)", f.dataType.simpleString())]
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields if re.search(r"\b(map<|variant\b|interval\b)", f.dataType.simpleString())]
    return F.struct(*plain, *[c.alias(f"json{i}") for i, c in enumerate(others)])


def _fingerprint_column():
    @F.pandas_udf("bigint")
    def column(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint).astype("int64")

    return column
