"""Encoding by distinct words against the tiktoken library, and back to the bytes."""

import hashlib
import random
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import bpe
from tests.conftest import DATA

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(P.path(bpe.VOCABULARY)), special_tokens={})


def expected(library, rows):
    out = []
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_words_of_any_length(library):
    table = bpe.ranks(P.path(bpe.VOCABULARY))
    rnd = random.Random(5)
    for n in [1, 2, 3, 10, 47, 48, 49, 200, 3000]:
        for letters in ("ab", "etaoin", "é中\U0001f600a"):
            word = "".join(rnd.choice(letters) for _ in range(n)).encode()
            assert bpe.encode_word(word, table) == library._core_bpe.encode_single_piece(word)


def test_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (5, "x" * 20_000), (6, " 　 \x1c tabs\t\n\n İß 12² กำ"), (7, "a\r\n\r\n  b \x85 c\x1f d <|endoftext|>")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, ids string")
    got = sorted([tuple(r) for r in bpe.round_trip(docs).collect()], key=repr)
    assert got == expected(library, rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in bpe.round_trip(docs).collect()], key=repr) == expected(library, rows)


def test_cutting_by_either_library():
    """The written-out classes cut as the library's own ones do."""
    import regex

    space = bpe.SPACE
    exact = regex.compile(P.PATTERN.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")).findall
    rnd = random.Random(9)
    letters = "ab Z9²'strevml \n\t\r.-\x1c\x85\xa0  　éß中กำ\U0001f600\U00020000\U0001d7ce٣Ⅻ"
    for _ in range(4000):
        text = "".join(rnd.choice(letters if rnd.random() < 0.5 else letters[:24]) for _ in range(rnd.randrange(30)))
        assert bpe.splitter(P.PATTERN).findall(text) == exact(text)
    every = "".join(chr(c) + rnd.choice(" a1.") for c in (*range(0xD800), *range(0xE000, 0x10000)))
    assert bpe.splitter(P.PATTERN).findall(every) == exact(every)


@pytest.mark.parametrize("top", [0, 1, 127, 128, 300, 70_000, 2**31])
def test_packed_numbers(top):
    rnd = np.random.default_rng(top)
    for n in (0, 1, 500):
        values = rnd.integers(0, top + 1, n)
        assert bpe.unpack_places(bpe.pack_places(values)).tolist() == values.tolist()
        assert [x.tolist() for x in bpe.unpack(bpe.pack(values, values[:1]))] == [values.tolist(), values[:1].tolist()]


def test_many_blocks(spark, library):
    """Words in many blocks; tokens as lists."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "word", "é中", "x" * 60, "12 34"]) for _ in range(rnd.randrange(30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert got == {d: library.encode_ordinary(t) for d, t in rows}
    assert {r["doc_id"]: r["n"] for r in bpe.token_counts(docs).collect()} == {d: len(ids) for d, ids in got.items()}


class Task:
    """Stands for the task that cuts, outside of Spark."""

    get = staticmethod(lambda: Task)
    partitionId = staticmethod(lambda: 0)


def cut_here(monkeypatch, texts):
    monkeypatch.setattr(bpe, "TaskContext", Task)
    batches = (pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "text": pa.array([t], pa.string())}) for i, t in enumerate(texts))
    return bpe._cut(P.PATTERN, 4)(batches)


def test_a_block_in_the_making_is_small(monkeypatch):
    """Two million words of one block take less than 30 bytes each while they are cut, numbered and packed."""
    text = "".join(f" w{i}" for i in range(1000))
    before, own = pa.default_memory_pool(), pa.proxy_memory_pool(pa.system_memory_pool())
    bpe.splitter(P.PATTERN)
    pa.set_memory_pool(own)
    tracemalloc.start()
    try:
        blocks = {row["block"][0].as_py() for row in cut_here(monkeypatch, (text for _ in range(1000)))}
        taken = tracemalloc.get_traced_memory()[1] + own.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
    assert blocks == {0}
    assert taken < 30 * 2_000_000, taken


def test_new_words_end_a_block(monkeypatch):
    """A block of nothing but new words ends before it has all its characters; every word is still there once a block."""
    monkeypatch.setattr(bpe, "STEP", 10)
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 20)
    texts = ["".join(f" {a}{'bcdefghij'[k]}" for a in "klmnopqrstuv") for k in range(9)]
    rows = [r for batch in cut_here(monkeypatch, texts) for r in batch.to_pylist()]
    docs = [r["doc_ids"] for r in rows if r["shard"] is None]
    assert docs == [[0, 1], [2, 3], [4, 5], [6, 7], [8]]
    for r in (r for r in rows if r["shard"] is None):
        held = b"".join(bpe.unpack(x["words"])[1].tobytes() for x in rows if x["block"] == r["block"] and x["shard"] is not None)
        assert sorted(held.split()) == sorted(w.encode() for d in r["doc_ids"] for w in texts[d].split())
        assert sorted(bpe.unpack_places(r["places"])) == list(range(sum(r["sizes"])))


def test_places_of_any_size():
    places = np.array([0, 1, 127, 128, 129, 255, 256, 300, 16_383, 16_384, 2**24, 2**31 - 1], dtype=np.int32)
    assert bpe.unpack_places(bpe.pack_places(places)).tolist() == places.tolist()
    assert bpe.unpack_places(bpe.pack_places(places[:0])).tolist() == []
