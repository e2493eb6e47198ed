"""SimHash groups against fingerprints compared pair by pair."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash as S
from ledgerlens.llm.cells import forest
from ledgerlens.llm.components import components
from tests.conftest import DATA


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(prints):
    """doc_id -> smallest reachable doc_id, from (doc_id, fingerprint)."""
    ids = np.array([d for d, _ in prints])
    fps = np.array([f for _, f in prints], dtype=np.uint64)
    root = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    ids, fps = ids[order], fps[order]
    changed = True
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = root[others].min()
            if (root[others] != low).any():
                root[others] = np.minimum(root[others], low)
                changed = True
    return {int(d): int(ids[r]) for d, r in zip(ids, root)}


def groups(frame):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in frame.collect()}


def test_fingerprint_as_written_down():
    texts = [None, "", " \n", "one", "One TWO", "a b c", "a b c d e", "Ä ß é ſ İ x y z", "x\x0by\x0cz q", "a " * 500, "ab cd e f g"]
    assert [S.fingerprint(t) % 2**64 for t in texts] == [plain_fingerprint(t) for t in texts]


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    monkeypatch.setattr(S, "BLOCK_SHINGLES", 7)
    assert S.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    roots = brute(prints)
    assert groups(S.near_duplicates(docs)) == {d: (f"{f:016x}", roots[d]) for d, f in prints}


@pytest.mark.parametrize("levels", [4, 8, 16, 32])
@pytest.mark.parametrize("chunk", [8, 1024])
def test_links_at_every_depth_and_chunk(spark, levels, chunk):
    rnd = np.random.default_rng(levels)
    centres = rnd.integers(0, 2**64, 12, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(25):
            f = int(c)
            for bit in rnd.choice(64, rnd.integers(0, 4), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    prints = list(enumerate(sorted(fps), 100))
    classes = spark.createDataFrame([(S._signed(f), d) for d, f in prints], "fp bigint, rep bigint")
    found = {r["node"]: r["root"] for r in components(S.near_links(classes, 3, levels, chunk)).collect()}
    expected = brute(prints)
    assert {d: found.get(d, d) for d, _ in prints} == expected


def test_one_tree_per_half_leaves_no_bit_out():
    for levels in (4, 8, 16, 32):
        masks = [m % 2**64 for t in S.plant(np.array([5, -7], dtype=np.int64), levels) for m in t.masks]
        assert sum(masks) == 2**64 - 1 and len(masks) == 2 * levels


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "a b c d", "z"), (3, "a b c d", "z"), (None, "a b c d", "n"), (None, "only here once", "n"), (9, "A B C D", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = [(r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (None, None), (9, 3)], key=repr)
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 80)] + [(900, 901), (901, 902), (902, 900), (902, 902)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {500 + i: 500 for i in range(80)} | {900: 900, 901: 900, 902: 900}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        a, b = rnd.integers(0, 30, (2, 25))
        root = forest(30, a, b)
        expected = np.arange(30)
        for _ in range(30):
            for x, y in zip(a, b):
                expected[[x, y]] = min(expected[x], expected[y])
        assert (root == expected).all()


def test_copies_do_not_meet_pairwise(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that is the same in every row").alias("text"))
    classes = S.fingerprints(docs).groupBy("fp").agg(F.min("doc_id").alias("rep"))
    assert classes.count() == 1
    assert S.near_duplicates(docs).agg(F.max("component_id"), F.min("n_copies")).first() == (0, 3000)
