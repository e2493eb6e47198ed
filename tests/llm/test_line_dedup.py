"""Shared lines against plain Python; the perfect hash against a dictionary."""

import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerlens.llm import line_dedup as L
from ledgerlens.llm.perfect_hash import PerfectHash


def plain(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda doc: (doc is None, doc or 0)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)], key=order) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 60_000])
def test_perfect_hash_numbers_every_key_once(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    found = PerfectHash.build(keys)
    assert sorted(found.number(keys).tolist()) == list(range(len(keys)))
    strangers = found.number(keys + np.uint64(1))
    assert ((strangers >= -1) & (strangers < max(1, len(keys)))).all()


def test_perfect_hash_keeps_what_no_level_settles(monkeypatch):
    monkeypatch.setattr("ledgerlens.llm.perfect_hash.LEVELS", 1)
    keys = np.arange(5_000, dtype=np.uint64) * np.uint64(77_777_777)
    found = PerfectHash.build(keys)
    assert len(found.rest) and sorted(found.number(keys).tolist()) == list(range(5_000))


def test_cases(spark):
    shared = "A line that is shared"
    rows = [
        (5, None), (6, ""), (7, "\n\n"), (2, f"{shared}\nonly here once\n{shared}"), (3, f" \t{shared.upper()}\r\nshort\nown line of three"), (4, f"short\n{shared}\n"),
        (4, f"same id, again\n{shared}"), (None, f"{shared}\nwithout an id at all"), (None, "without an id at all"), (9, "É" * 10 + "\nÉé" * 4), (10, "é" * 10 + "\n" + "É" * 10),
        (11, "x" * 2_000_000 + "\n" + shared), (12, "x" * 2_000_000), (13, "　wide blank stays　\nnine code"), (14, "wide blank stays\nnine code"), (3, "own line of three"),
    ]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, kept string, shard int")
    assert rows_of(L.dedup_lines(docs)) == plain(rows)
    assert L.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    pool = [f"{rnd.choice(['Line', 'LINE', 'lïne'])} number {rnd.randrange(60)}" for _ in range(120)]
    rows = [(rnd.choice([None, *range(80)]) if rnd.random() < 0.1 else i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else f"only in {i} at {k}" for k in range(rnd.randrange(12)))) for i in range(300)]
    rows += [(1000 + i, "the very same line for a third of all rows") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert rows_of(L.dedup_lines(docs, shards=rnd.choice([1, 7, 300]))) == plain(rows)


def test_places_that_agree(monkeypatch):
    """Keys with equal first halves of their hashes stay apart."""
    import pandas as pd

    keys = np.zeros(4, dtype=L._KEY)
    keys["place"], keys["print"], keys["first"], keys["count"] = [7, 7, 9, 9], [1, 2, 3, 4], [10, 20, 30, 40], [2, 1, 1, 1]
    blocks = pd.DataFrame({"keys": [keys[:2].tobytes(), keys[2:].tobytes()], "docs": [np.array([10, 11, 20], "<i8").tobytes(), np.array([30, 40], "<i8").tobytes()]})
    out = L._probe((0, 0), blocks, L._index((0,), blocks))
    assert out["doc"].tolist() == [11] and np.frombuffer(out["hashes"][0], "<u8").tolist() == [7, 1]
