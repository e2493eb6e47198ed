"""Labelled rows to fit a classifier on: ids are chosen first, texts stay where they lie.

Of each class the ids with the smallest hashes are taken, at most a given number, so that the same rows are learned from in
every run. Only ids travel; the chosen ones, bounded by that number, are broadcast to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stage


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def share_of(doc_id: Column) -> Column:
    """A number from 0 to 1 (not included) that the id alone decides."""
    return F.shiftrightunsigned(F.xxhash64(doc_id), 11) / float(1 << 53)


def labelled_ids(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``known(doc_id, kind)``, one row per id, without ids that no document has; and how many ids each kind has."""
    present = stage(known.select("doc_id", "kind").join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    return present, {r["kind"]: r["n"] for r in present.groupBy("kind").agg(F.count("*").alias("n")).collect()}


def smallest_hashes(present: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """(doc_id, kind): of each kind at most ``most`` ids."""
    share = share_of(F.col("doc_id"))
    parts = []
    for kind, size in sorted(sizes.items()):
        # ids that cannot be among the smallest are left out before they are sorted; the bound is far above what chance needs
        near = present.where((F.col("kind") == kind) & (share < min(1.0, (1.2 * most + 200) / size)))
        parts.append(near.orderBy(share, "doc_id").limit(most))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, kind) of the documents with chosen ids. ``chosen`` is bounded by its number."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an id the smallest by the other columns."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select("least.*")
