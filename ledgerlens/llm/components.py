"""Connected components of a graph given by links, as rounds of joins.

Each round is one large-star and one small-star step: every node links its larger neighbours, then
its smaller ones, to the smallest node it knows. Rounds go on until nothing changes (their number
grows with the logarithm of the graph). A node's links are never gathered in one row: the smallest
neighbour is an aggregate, and the links meet it in a join that adaptive execution can split. Each
round is written to the shared folder, so that a lost executor costs that round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step. Links are (child, parent) with parent < child."""
    turned = links.select(F.col("parent").alias("node"), F.col("child").alias("other"))
    straight = links.select(F.col("child").alias("node"), F.col("parent").alias("other"))
    both = straight.unionByName(turned)
    least = (both if large else straight).groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    kept = (both.where("other > node") if large else straight).join(least, "node")
    moved = kept.select(F.col("other").alias("child"), F.col("least").alias("parent"))
    if not large:  # the node itself also hangs below its smallest neighbour
        moved = moved.unionByName(least.select(F.col("node").alias("child"), F.col("least").alias("parent")))
    return moved.where("child <> parent").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a bigint, b bigint)`` to ``(node, root)``: each linked node with the smallest node it can reach.

    Nodes without a link to another node do not appear. Repeated links, links of a node with itself and
    links with a null end change nothing.
    """
    current = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct(), "links"
    )
    before = _mark(current)
    while before[0]:
        current = stage(_star(_star(current, True), False), "links")
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
    return current.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(roots)
