"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are tokens of operator 8's byte-level encoding (``pack_tokens``), in which the permitted lengths are meant; pieces
are cut at token positions. ``pack`` counts white-space words instead, for whoever asks for words.

Documents longer than the greatest length are cut into pieces of that length and a rest. Pieces are packed
best-fit in order of falling length: a piece goes into the open bin with the least room that holds it. If none does, a
bin is opened in the size that costs least for pieces of this length (``cost`` of the bin, shared among as
many such pieces as it takes). At the end every bin is downsized to the smallest permitted length that
holds its contents.

Pieces of equal length are alike, so the packing is worked out on the histogram of lengths, which has as many
entries as the greatest length whatever the number of documents. Bins of equal room are handled as one
interval of bin numbers; each interval that takes pieces at least halves its room, so the plan
stays small. The plan says, for each length, which ranks of pieces go to which bins; ranks are
given in small buckets of each length, so that a length shared by a third of all documents is many tasks, and
pieces find their bins in a join with the plan.

Cases: a null or empty text (counting words, also one of white space) has length 0 and a row without a bin (null). Rows with equal ids are
packed separately; null ids are packed as well. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.bpe import token_counts
from ledgerlens.session import stage

CAPACITIES = (1024, 2048, 4096, 8192)
#: Pieces of one length that are ranked in one window.
BUCKET = 512

PLAN = "length int, first bigint, last bigint, bin bigint, each int, at int, capacity int"


def attention_cost(capacity: int) -> float:
    """A linear and a quadratic part, which are equal at 8,192 tokens, and a fixed one."""
    return 64 + capacity + capacity * capacity / 8192


def plan_bins(
    histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = attention_cost
) -> list[tuple[int, int, int, int, int, int, int]]:
    """Where the pieces of each length go, by rank: (length, first, last, bin, each, at, capacity).

    Ranks first to last (excluded) go to the bins from ``bin`` on, ``each`` per bin, the first one ``at`` tokens into the bin.
    Equal to packing piece by piece.
    """
    sizes = sorted(set(capacities))
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> intervals (first bin, last bin, opened capacity)
    rooms: list[int] = []
    moves: list[tuple[int, int, int, int, int, int, int]] = []  # length, first, last, bin, each, used before, bins
    closed: list[tuple[int, int, int]] = []  # first bin, last bin, used
    bins = 0

    def add(room: int, interval: tuple[int, int, int]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        heapq.heappush(open_[room], interval)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        if not 0 < length <= sizes[-1]:
            raise ValueError("lengths are between 1 and the greatest capacity")
        while left:
            place = bisect.bisect_left(rooms, length)
            if place < len(rooms):
                room = rooms[place]
                begin, end, capacity = heapq.heappop(open_[room])  # of equal rooms the bin opened first
                if not open_[room]:
                    del open_[room]
                    rooms.pop(place)
            else:
                capacity = min((c for c in sizes if c >= length), key=lambda c: (cost(c) / (c // length), c))
                room = capacity
                begin, end = bins, bins + -(-left // (capacity // length))
                bins = end
            each = room // length
            full = min(end - begin, left // each)
            if full:
                moves.append((length, rank, rank + full * each, begin, each, capacity - room, full))
                add(room - each * length, (begin, begin + full, capacity))
                rank, left = rank + full * each, left - full * each
            rest = begin + full
            if rest < end and left and left < each:
                moves.append((length, rank, rank + left, rest, left, capacity - room, 1))
                add(room - left * length, (rest, rest + 1, capacity))
                rank, left, rest = rank + left, 0, rest + 1
            if rest < end:
                add(room, (rest, end, capacity))
    for room, intervals in open_.items():
        closed += [(begin, end, next(c for c in sizes if c >= max(1, capacity - room))) for begin, end, capacity in intervals]
    closed.sort()
    starts = [begin for begin, _, _ in closed]
    plan = []
    for length, first, last, begin, each, used, count in moves:
        at, end = begin, begin + count
        while at < end:  # bins that parted later may end in different sizes
            _, stop, size = closed[bisect.bisect_right(starts, at) - 1]
            stop = min(stop, end)
            low = first + (at - begin) * each
            plan.append((length, low, min(last, low + (stop - at) * each), at, each, used, size))
            at = stop
    return plan


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, start, length): words of each document in pieces of at most ``longest``; one empty piece for no words."""
    # words are counted as ends of runs of anything but white space; nothing is split
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return cut_pieces(docs.select("doc_id", words.alias("n")), longest)


def cut_pieces(counted: DataFrame, longest: int) -> DataFrame:
    """(doc_id, n) to (doc_id, piece, start, length)."""
    cut = F.sequence(F.lit(0).cast("bigint"), F.greatest((F.col("n") - 1).cast("bigint"), F.lit(0).cast("bigint")), F.lit(longest).cast("bigint"))
    return counted.select("doc_id", "n", F.posexplode(cut).alias("piece", "start")).select(
        "doc_id", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(longest).cast("bigint")).cast("int").alias("length")
    )


def pack_tokens(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bucket: int = BUCKET, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length (in tokens), bin, capacity, bin_offset."""
    return _packed(cut_pieces(token_counts(docs, path), max(capacities)), capacities, bucket)


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bucket: int = BUCKET) -> DataFrame:
    """The same with lengths in white-space words."""
    return _packed(pieces(docs, max(capacities)), capacities, bucket)


def _packed(cut: DataFrame, capacities: tuple[int, ...], bucket: int) -> DataFrame:
    spark = cut.sparkSession
    cut = stage(cut, "pieces")
    counts = {r["length"]: r["n"] for r in cut.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most the greatest
    plan = spark.createDataFrame(plan_bins(counts, capacities), PLAN)
    shares = spark.createDataFrame([(length, -(-n // bucket)) for length, n in counts.items()], "length int, buckets bigint")
    # buckets of a length by hash; ranks inside a bucket, moved up by the sizes of the buckets before it
    spread = (
        cut.where("length > 0")
        .join(F.broadcast(shares), "length")
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")))
    )
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = (
        spread.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "bucket"])
        .select("doc_id", "piece", "start", "length", (F.col("before") + F.col("place")).alias("rank"))
    )
    # the plan is bounded by the greatest length, not by the documents
    held = (F.col("p.length") == F.col("r.length")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.last"))
    step = F.col("r.rank") - F.col("p.first")
    packed = ranked.alias("r").join(F.broadcast(plan).alias("p"), held).select(
        *[f"r.{c}" for c in ("doc_id", "piece", "start", "length")],
        (F.col("p.bin") + F.floor(step / F.col("p.each"))).cast("bigint").alias("bin"),
        F.col("p.capacity"),
        (F.col("p.at") + F.pmod(step, F.col("p.each").cast("bigint")) * F.col("r.length")).cast("int").alias("bin_offset"),
    )
    empty = cut.where("length = 0").select(
        "doc_id", "piece", "start", "length", F.lit(None).cast("bigint").alias("bin"), F.lit(None).cast("int").alias("capacity"), F.lit(None).cast("int").alias("bin_offset")
    )
    return packed.unionByName(empty)
