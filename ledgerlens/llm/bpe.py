"""Byte-level BPE over the distinct words of all documents, and back.

1. Documents are cut into pre-tokens where they lie. A block of documents (bounded by characters and by distinct words) numbers its
   distinct words by falling frequency and keeps its documents as lists of word numbers: the positions. Both are packed and written once to the shared folder.
   A task holds the distinct words of every ``STEP`` words and four bytes an occurrence, not the words themselves.
2. The words of all blocks meet in one shuffle, packed and sorted by shard (a hash of the word decides). Each distinct word is encoded once; what goes back
   to a block are the ids in the order of its words; the block keeps the numbers in that order.
3. Each block reassembles its documents by position, and decodes their ids by the token-byte table (as large as the vocabulary).

A frequent word is one entry per block, not per occurrence, so no word is a hot key; a long document only
makes its own block larger. Later steps read what step 1 wrote, so they never depend on cutting the input in the same way twice.

Cases: a null text counts as empty; an empty text has no tokens; equal rows (equal ids too) are encoded separately; a null id
is kept; an empty table gives an empty result; further columns are not read. Words of any length are encoded in time n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerlens.llm.frames import text_rows
from ledgerlens.session import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of text in a block of documents.
BLOCK_CHARS = 32_000_000
#: Words of a text that are numbered at a time.
STEP = 200_000
#: Words held, distinct ones of each step, that end a block before its characters do.
BLOCK_WORDS = 4_000_000
#: Least number of shards of the words.
SHARDS = 256
#: Effort of the compression of packed numbers.
LEVEL = 5
#: Words up to this many bytes are merged by plain search.
SHORT = 48


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# White space as Unicode has it, which is not what Python's str.isspace says.
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _members(of: str) -> str:
    """The characters below U+10000 that match a class of the library ``regex``, as ranges for the library ``re``."""
    import regex

    points = [ord(c) for c in regex.findall(of, "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))))]
    starts = [c for c, before in zip(points, [-2, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -2]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


class Splitter:
    """Cuts a text into pre-tokens.

    Texts without characters from U+10000 on, nearly all, are cut by the standard library with the classes written out, in less than half the time.
    """

    def __init__(self, pattern: str) -> None:
        import regex

        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.exact = self.fast = regex.compile(spaced).findall
        letters, numbers = _members(r"\p{L}"), _members(r"\p{N}")
        inside = spaced.replace(r"\p{L}\p{N}]", f"{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        if r"\p" not in inside:
            self.fast = re.compile(inside).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def findall(self, text: str) -> list[str]:
        return self.fast(text) if text.isascii() or not self.beyond(text) else self.exact(text)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def encode_word(word: bytes, table: dict[bytes, int]) -> list[int]:
    """Merge the neighbouring pair of lowest rank, the leftmost of equals, until none is in the table."""
    if word in table:
        return [table[word]]
    if len(word) <= SHORT:
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [table.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        while pairs:
            low, at = -1, -1
            for i, r in enumerate(pairs):
                if r >= 0 and (low < 0 or r < low):
                    low, at = r, i
            if low < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = table.get(parts[at - 1] + parts[at], -1)
            if at < len(pairs):
                pairs[at] = table.get(parts[at] + parts[at + 1], -1)
        return [table[p] for p in parts]
    # long words: pairs in a heap, parts in a linked list
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    back = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := table.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop or end[i] == stop:
            continue
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            back[stop] = i
        offer(i)
        if back[i] >= 0:
            offer(back[i])
    out, i = [], 0
    while i < n:
        out.append(table[word[i : end[i]]])
        i = end[i]
    return out


# -- packed numbers -----------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in their least width, byte planes apart, compressed."""
    parts = [np.uint32(len(arrays)).tobytes()]
    for values in arrays:
        kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
        planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T)
        parts += [np.array([kind.itemsize, len(values)], dtype=np.int64).tobytes(), planes.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(raw, asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    at, out = 4, []
    for _ in range(int(np.frombuffer(raw, np.uint32, 1)[0])):
        width, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        at += 16
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += width * n
    return out


def pack_places(places: np.ndarray) -> bytes:
    """Small numbers, the frequent ones, in one byte; what is above seven bits in a second list."""
    large = places >= 128
    low = places.astype(np.uint8)  # the lowest eight bits
    low[large] |= 128
    return pack(low, places[large] >> 7)


def unpack_places(data: bytes) -> np.ndarray:
    low, high = unpack(data)
    places = (low & 127).astype(np.int32)
    places[low >= 128] |= high.astype(np.int32) << 7
    return places


# -- blocks of documents ------------------------------------------------------------------------

_PARTS = "block bigint, shard int, doc_ids array<bigint>, sizes array<bigint>, places binary, numbers binary, words binary"


def _cut(pattern: str, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = splitter(pattern).findall
        block, size, held = TaskContext.get().partitionId() << 32, 0, 0
        ids: list[int | None] = []
        sizes: list[int] = []
        waiting: list[str] = []
        parts: list[pa.Array] = []  # of a step each: its distinct words, and the number of every word

        def settle() -> int:
            parts.append(pa.array(waiting, pa.large_string()).dictionary_encode())
            waiting.clear()
            return len(parts[-1].dictionary)

        def emit() -> Iterator[pa.RecordBatch]:
            settle()
            steps = pa.chunked_array(parts).unify_dictionaries().chunks
            parts.clear()
            words = steps[0].dictionary.cast(pa.large_binary())
            count = sum(np.bincount(step.indices.to_numpy(), minlength=len(words)) for step in steps)
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order))
            places = np.concatenate([rank[step.indices.to_numpy()] for step in steps])
            del steps
            pa.default_memory_pool().release_unused()
            shard = np.fromiter((zlib.crc32(w.as_buffer()) % shards for w in words), dtype=np.int64, count=len(words))
            asked = pc.sort_indices(words).to_numpy().astype(np.int64)
            asked = asked[np.argsort(shard[asked], kind="stable")]  # by shard, then by word
            yield batch_of(None, list(ids), list(sizes), pack_places(places), pack(rank[asked]), None)
            words, shard = words.take(pa.array(asked)), shard[asked]
            edge = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
            letters = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)]):
                yield batch_of(int(shard[low]), None, None, None, None, pack(np.diff(edge[low : high + 1]), letters[edge[low] : edge[high]]))

        def batch_of(*values) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            columns = [pa.array([block]), *(pa.array([v], k) for v, k in zip(values, kinds))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "shard", "doc_ids", "sizes", "places", "numbers", "words"])

        for batch in batches:
            for doc, text in text_rows(batch, ["doc_id", "text"]):
                words = cut(text or "")
                ids.append(doc)
                sizes.append(len(words))
                waiting += words
                size += len(text or "")
                if len(waiting) >= STEP:
                    held += settle()
                if size >= BLOCK_CHARS or held >= BLOCK_WORDS:
                    yield from emit()
                    block, size, held = block + 1, 0, 0
                    ids.clear()
                    sizes.clear()
        if ids:
            yield from emit()

    return run


def cut_blocks(docs: DataFrame, pattern: str, shards: int) -> DataFrame:
    """A row (block, doc_ids, sizes, places, numbers) for the documents of a block and rows (block, shard, words) for its distinct words."""
    return docs.select("doc_id", "text").mapInArrow(_cut(pattern, shards), _PARTS)


def _vocabulary_path(path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes one after the other, start and length by id. It has one entry per id of the vocabulary."""
    table = {i: b for b, i in ranks(path).items()}
    return _flat([table.get(i, b"") for i in range(max(table) + 1)])


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes one after the other, their starts and lengths."""
    length = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    return np.frombuffer(b"".join(values), dtype=np.uint8), np.cumsum(length) - length, length


def _gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
    n = length[places]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(start[places], n) + inside]


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of a list of ids, by the token-byte table."""
    return _gather(*token_bytes(path), ids).tobytes()


def _encode_shard(path: str, with_ids: bool):
    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        table = ranks(path)
        known: dict[bytes, int] = {}
        rows = []
        for block, packed in zip(blocks["block"].tolist(), blocks["words"]):
            lengths, letters = unpack(packed)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw, first = letters.tobytes(), (ends - lengths).tolist()
            rows.append((block, np.fromiter((known.setdefault(raw[a:b], len(known)) for a, b in zip(first, ends.tolist())), dtype=np.int64, count=len(ends))))
        encoded = [encode_word(word, table) for word in known]  # each distinct word once
        length = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), dtype=np.int64, count=int(length.sum()))
        start = np.cumsum(length) - length
        out = [(block, key[0], pack(length[at], *([_gather(flat, start, length, at)] if with_ids else []))) for block, at in rows]
        return pd.DataFrame(out, columns=["of_block", "of_shard", "answer"]).astype({"of_block": "int64"})

    return run


def _met(docs: DataFrame, path: str, pattern: str, with_ids: bool, assemble, schema: str) -> DataFrame:
    """Blocks of documents with the encoded words of their block."""
    spark = docs.sparkSession
    shards = max(SHARDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = stage(cut_blocks(docs, pattern, shards), "blocks")
    words = parts.where("shard IS NOT NULL").select("block", "shard", "words")
    answers = words.groupBy("shard").applyInPandas(_encode_shard(path, with_ids), "of_block bigint, of_shard int, answer binary")
    texts = parts.where("shard IS NULL").select("block", "doc_ids", "sizes", "places", "numbers")
    return texts.groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(assemble, schema)


def _documents(texts: pd.DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, numbers of its words) of a block; it has one row."""
    for ids, sizes, packed in zip(texts["doc_ids"], texts["sizes"], texts["places"]):
        places, at = unpack_places(packed), 0
        for doc, n in zip(ids, sizes):
            yield (None if doc is None or doc != doc else int(doc)), places[at : at + int(n)]
            at += int(n)


def _answers(texts: pd.DataFrame, words: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers of a block's words, and what all shards say of them in that order."""
    lists = [unpack(answer) for answer in words.sort_values("of_shard")["answer"]]
    joined = [np.concatenate([x[k] for x in lists]) for k in range(len(lists[0]))] if lists else [np.zeros(0, np.int64)] * 2
    return unpack(texts["numbers"].iloc[0])[0], joined


_ENCODED = "doc_id bigint, ids array<int>"
_RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _token_lists(texts: pd.DataFrame, words: pd.DataFrame) -> Iterator[tuple[int | None, np.ndarray]]:
    numbers, (lengths, flat) = _answers(texts, words)
    start, length = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=np.int64)
    start[numbers], length[numbers] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
    for doc, places in _documents(texts):
        yield doc, _gather(flat, start, length, places)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the tokens of every document."""
    path, pattern = _vocabulary_path(path)

    def assemble(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = [(doc, ids.astype(np.int32)) for doc, ids in _token_lists(texts, words)]
        return pd.DataFrame(rows, columns=["doc_id", "ids"]).astype({"doc_id": "Int64"})

    return _met(docs, path, pattern, True, assemble, _ENCODED)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: number of tokens, digest of the ids and of the bytes decoded from them."""
    path, pattern = _vocabulary_path(path)

    def assemble(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, path)).hexdigest())
            for doc, ids in _token_lists(texts, words)
        ]
        return pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    return _met(docs, path, pattern, True, assemble, _RESULT)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n): the number of tokens of each document; only the lengths of the words come back."""
    path, pattern = _vocabulary_path(path)

    def assemble(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        numbers, (lengths, *_) = _answers(texts, words)
        length = np.zeros(len(numbers), dtype=np.int64)
        length[numbers] = lengths
        rows = [(doc, int(length[places].sum())) for doc, places in _documents(texts)]
        return pd.DataFrame(rows, columns=["doc_id", "n"]).astype({"doc_id": "Int64"})

    return _met(docs, path, pattern, False, assemble, "doc_id bigint, n bigint")
