"""Boundary sets against plain lists; examples against slices of code points, and back to the text."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlens.llm import boundary_set as B
from ledgerlens.llm import fill_in_middle as M


def plain(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc, n, form, a, b - a, f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}", text


@pytest.mark.parametrize("seed", range(12))
def test_select(seed):
    rnd = np.random.default_rng(seed)
    parts = [np.flatnonzero(rnd.random(B.CONTAINER) < share) + k * B.CONTAINER for k, share in enumerate(rnd.choice([0.0, 0.0001, 0.02, 0.4, 0.7, 1.0], 4))]
    members = np.concatenate(parts)
    found = B.BoundarySet(members)
    assert len(found) == len(members)
    for rank in {0, len(members) - 1, *rnd.integers(0, max(1, len(members)), 200).tolist()} if len(members) else ():
        assert found.select(rank) == members[rank]
    for rank in (-1, len(members)):
        with pytest.raises(IndexError):
            found.select(rank)


def test_smallest_container_is_taken():
    assert B.container(np.arange(B.CONTAINER)).kind == "run"
    assert B.container(np.arange(0, 1000, 7)).kind == "array"
    assert B.container(np.arange(0, B.CONTAINER, 2)).kind == "bitmap"
    assert {c.kind for c in B.character_boundaries(("é" * 40_000 + "a" * 100_000).encode()).containers} == {"bitmap", "run"}


def test_examples_and_back(spark):
    rnd = random.Random(3)
    letters = "ab <>PSM\né中\U0001f600\0"
    rows = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))) for i in range(3000)]
    rows += [(None, "without an id"), (None, None), (5, None), (6, ""), (7, "same"), (7, "same"), (8, "long é " * 200_000), (9, "ends <S"), (9, "<M"), (11, "has <M> in it")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id bigint, text string, output string, form string")
    got = [tuple(r) for r in M.restored(M.fill_in_middle(docs)).collect()]
    assert sorted(got, key=repr) == sorted((plain(*row) for row in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(docs.limit(0)).count() == 0
