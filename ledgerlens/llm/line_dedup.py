"""Lines that many documents share, kept in one document only.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys of at least ``LEAST`` code points that occur in two documents or more
stay in the document with the smallest id and lose their lines in all others.

1. Documents are cut where they lie. A block of documents gives its distinct keys as 128-bit hashes, each with its documents, packed by shard
   (the hash decides) and written once to the shared folder.
2. For each shard the distinct hashes get a minimal perfect hash (``perfect_hash``) and, under its numbers, three arrays: fingerprint (the other half
   of the hash), number of documents (up to 255, more count as 255) and smallest document. A block sends a key once, however many of its
   documents hold it, so a key of all documents makes its shard larger by one entry per block.
3. The packed hashes of the blocks probe the arrays of their shard: no line is joined with a line. A shard that gets more than
   its share of probes is dealt to several tasks, each with a copy of its arrays. What comes back is, for each document, the hashes it has to drop.
4. Documents meet their list by id and lose those lines.

A shard grows with the number of distinct lines over the number of shards; that number follows ``spark.sql.shuffle.partitions``, which is sized
to the data, and can be given. Two keys are taken as equal when all 128 bits of their hashes are.

Cases: a null or empty text is one empty line; rows with one id are one document, so are all rows without an id, which counts as greater than any
id; repeated lines of the keeping document all stay; keys under ``LEAST`` code points stay everywhere; texts and lines of any length are
taken whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import text_rows
from ledgerlens.llm.perfect_hash import PerfectHash
from ledgerlens.session import stage

#: Code points of the shortest key that is compared.
LEAST = 10
#: Pairs of a block that are packed together.
BLOCK_PAIRS = 400_000
#: Least number of shards.
SHARDS = 256
#: A document without an id.
NO_ID = np.iinfo(np.int64).max

_KEY = np.dtype([("place", "<u8"), ("print", "<u8"), ("first", "<i8"), ("count", "<u4")])
#: Keys of a shard whose places agree with another one's, kept beside its perfect hash.
_TWIN = np.dtype([("place", "<u8"), ("print", "<u8"), ("first", "<i8")])


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: the six ASCII blanks, A-Z only


def long_enough(key: bytes, least: int = LEAST) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8")) >= least


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def shard_of(place: np.ndarray, shards: int) -> np.ndarray:
    return ((place >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns has a new value; the first place counts."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for values in columns:
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _packed_keys(shards: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[bytes] = []
        owners: list[tuple[int, int]] = []
        block = TaskContext.get().partitionId() << 32

        def emit() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 2)
            docs = np.repeat(np.array([d for d, _ in owners], dtype=np.int64), [n for _, n in owners])
            order = np.lexsort((docs, halves[:, 1], halves[:, 0]))
            place, mark, docs = halves[order, 0], halves[order, 1], docs[order]
            pairs = _changes(place, mark, docs)
            place, mark, docs = place[pairs], mark[pairs], docs[pairs]
            fresh = _changes(place, mark)
            keys = np.empty(len(fresh), dtype=_KEY)
            keys["place"], keys["print"], keys["first"] = place[fresh], mark[fresh], docs[fresh]
            keys["count"] = np.diff(np.append(fresh, len(docs)))
            shard = shard_of(keys["place"], shards)
            cuts = _changes(shard)
            docs_of = np.split(docs, fresh[cuts[1:]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(cuts), block)),
                    pa.array(shard[cuts]),
                    pa.array([part.tobytes() for part in np.split(keys, cuts[1:])], pa.binary()),
                    pa.array([part.tobytes() for part in docs_of], pa.binary()),
                    pa.array([len(part) for part in docs_of], pa.int64()),
                ],
                names=["block", "shard", "keys", "docs", "pairs"],
            )

        for batch in batches:
            for doc, text in text_rows(batch, ["doc_id", "text"]):
                keys = {key for line in (text or b"").split(b"\n") if long_enough(key := line_key(line), least)}
                if keys:
                    hashes += map(key_hash, keys)
                    owners.append((NO_ID if doc is None else doc, len(keys)))
                if len(hashes) >= BLOCK_PAIRS:
                    yield emit()
                    block += 1
                    hashes.clear()
                    owners.clear()
        if hashes:
            yield emit()

    return run


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def packed_keys(docs: DataFrame, shards: int, least: int = LEAST) -> DataFrame:
    """(block, shard, keys, docs, pairs): a block's distinct key hashes of a shard, the documents of each, and how many pairs that makes."""
    return _raw(docs).mapInArrow(_packed_keys(shards, least), "block bigint, shard int, keys binary, docs binary, pairs bigint")


_INDEX_COLUMNS = ("of_shard", "sizes", "words", "rest", "prints", "counts", "first", "twins")
_INDEX = "of_shard int, sizes binary, words binary, rest binary, prints binary, counts binary, first binary, twins binary"


def _index(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([np.frombuffer(p, dtype=_KEY) for p in blocks["keys"]])
    keys = keys[np.lexsort((keys["first"], keys["print"], keys["place"]))]
    fresh = _changes(keys["place"], keys["print"])
    documents = np.add.reduceat(keys["count"].astype(np.int64), fresh)
    keys = keys[fresh]
    own = np.diff(np.append(_changes(keys["place"]), len(keys)))
    alone = np.repeat(own == 1, own)
    twins = np.empty(int((~alone).sum()), dtype=_TWIN)
    for name in _TWIN.names:
        twins[name] = keys[name][~alone]
    keys, documents = keys[alone], documents[alone]
    found = PerfectHash.build(keys["place"])
    number = found.number(keys["place"])
    prints, counts, first = np.empty(len(keys), "<u8"), np.empty(len(keys), np.uint8), np.empty(len(keys), "<i8")
    prints[number], first[number] = keys["print"], keys["first"]
    counts[number] = np.minimum(documents, 255)
    parts = (found.sizes, found.words, found.rest, prints, counts, first, twins)
    return pd.DataFrame([(key[0], *(x.tobytes() for x in parts))], columns=list(_INDEX_COLUMNS))


def shard_index(packed: DataFrame) -> DataFrame:
    """One row per shard: the perfect hash and its arrays."""
    return packed.select("shard", "keys").groupBy("shard").applyInPandas(_index, _INDEX)


def _probe(key: tuple, blocks: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    row = index.iloc[0]
    found = PerfectHash(np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["words"], "<u8"), np.frombuffer(row["rest"], "<u8"))
    prints, counts, first = np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["first"], "<i8")
    twins = np.frombuffer(row["twins"], dtype=_TWIN)
    out = []
    for packed, owners in zip(blocks["keys"], blocks["docs"]):
        keys, docs = np.frombuffer(packed, dtype=_KEY), np.frombuffer(owners, "<i8")
        keeper = np.full(len(keys), NO_ID, dtype=np.int64)
        shared = np.zeros(len(keys), dtype=bool)
        if len(prints):
            number = found.number(keys["place"])
            known = (number >= 0) & (prints[number] == keys["print"])
            keeper[known] = first[number[known]]
            shared[known] = counts[number[known]] >= 2
        for twin in twins:
            same = (keys["place"] == twin["place"]) & (keys["print"] == twin["print"])
            keeper[same], shared[same] = twin["first"], True
        each = keys["count"].astype(np.int64)
        lost = np.flatnonzero(np.repeat(shared, each) & (np.repeat(keeper, each) != docs))
        if not len(lost):
            continue
        lost = lost[np.argsort(docs[lost], kind="stable")]
        which = np.repeat(np.arange(len(keys)), each)[lost]
        hashes = np.stack([keys["place"][which], keys["print"][which]], axis=1)
        cuts = _changes(docs[lost])
        out += [(doc, part.tobytes()) for doc, part in zip(docs[lost][cuts].tolist(), np.split(hashes, cuts[1:]))]
    return pd.DataFrame(out, columns=["doc", "hashes"]).astype({"doc": "int64"})


def lines_to_drop(docs: DataFrame, shards: int | None = None, least: int = LEAST) -> DataFrame:
    """(doc, hashes): for each document that loses lines, the hashes of their keys, 16 bytes each."""
    spark = docs.sparkSession
    shards = shards or max(SHARDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = stage(packed_keys(docs, shards, least), "line-keys")
    index = stage(shard_index(packed), "line-index")
    # a shard with more than twice the mean of probes is dealt to several tasks: one row per shard, so a small table
    loads = packed.groupBy("shard").agg(F.sum("pairs").alias("load"))
    mean = loads.agg(F.avg("load")).first()[0] or 1.0
    parts = stage(loads.select("shard", F.ceil(F.col("load") / (2 * mean)).cast("int").alias("parts")), "line-parts")
    probes = packed.join(F.broadcast(parts), "shard").select("shard", F.pmod(F.xxhash64("block"), "parts").cast("int").alias("part"), "keys", "docs")
    copies = index.join(F.broadcast(parts), F.col("of_shard") == F.col("shard")).select(
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("of_part"), *_INDEX_COLUMNS
    )
    answers = probes.groupBy("shard", "part").cogroup(copies.groupBy("of_shard", "of_part")).applyInPandas(_probe, "doc bigint, hashes binary")
    return answers.groupBy("doc").agg(F.concat_ws("", F.collect_list(F.hex("hashes"))).alias("hashes")).select("doc", F.unhex("hashes").alias("hashes"))


_KEPT = "doc_id bigint, n_lines bigint, n_dropped bigint, kept binary"


def _keep(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, hashes in text_rows(batch, ["doc_id", "text", "hashes"]):
                lines = (text or b"").split(b"\n")
                kept = lines
                if hashes:
                    lost = {hashes[i : i + 16] for i in range(0, len(hashes), 16)}
                    kept = [x for x in lines if not (long_enough(key := line_key(x), least) and key_hash(key) in lost)]
                out.append((doc, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            columns = zip(*out) if out else ([], [], [], [])
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, shards: int | None = None, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text of the lines that stay) for every row."""
    lost = stage(lines_to_drop(docs, shards, least), "lines-to-drop")
    met = _raw(docs).withColumn("doc", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(lost, "doc", "left").select("doc_id", "text", "hashes")
    return met.mapInArrow(_keep(least), _KEPT).withColumn("kept", F.col("kept").cast("string"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the lines that stay."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
