import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.functions.alignment import best_in_order, best_matching, overlaps
from tests.helpers import best_ordered, overlap


def weight(c, held):
    on = held >= 0
    assert len(set(held[on])) == on.sum()
    return int(c[np.flatnonzero(on), held[on]].sum())


def brute(c):
    c = c if c.shape[0] <= c.shape[1] else c.T
    return max(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.randoms(use_true_random=False))
def test_matching_is_optimal(n, m, rng):
    c = np.array([[rng.choice([0, 0, 1, 2, 3]) for _ in range(m)] for _ in range(n)])
    assert weight(c, best_matching(c)) == brute(c)


@pytest.mark.parametrize(
    "c, best",
    [
        (np.ones((700, 500), int), 500),
        (np.add.outer(np.arange(300) % 7, np.arange(400) % 5), None),
        ((np.arange(400)[:, None] % 10 == np.arange(390)[None, :] % 10) * 3, 1170),
    ],
)
def test_ties_do_not_stall(c, best):
    start = time.time()
    total = weight(c, best_matching(c))
    assert time.time() - start < 60
    assert best is None or total == best


def test_no_profit_means_unmatched():
    assert list(best_matching(np.zeros((3, 2), int))) == [-1, -1, -1]


def test_overlaps_of_a_batch_and_order():
    tables = [([["a#1", "b#1"], ["c#1", "c#2"]], [["b#1", "a#1"], ["c#1", "d#1"], ["x#1", "y#1"]]), ([], [["a#1"]]), ([["q#1"]], [["q#1"]])]
    p, g = (pa.array([t[k] for t in tables], pa.list_(pa.list_(pa.string()))) for k in (0, 1))
    for (a, b), c in zip(tables, overlaps(p, g), strict=True):
        assert c.shape == (len(a), len(b))
        assert all(c[i, j] == overlap(a[i], b[j]) for i in range(len(a)) for j in range(len(b)))
        assert best_in_order(c) == best_ordered(a, b)
    tail = list(overlaps(p.slice(2), g.slice(2)))
    assert len(tail) == 1 and tail[0].tolist() == [[1]]


def test_large_tables_take_the_blocked_product():
    rng = np.random.default_rng(0)
    make = lambda n: [[f"{k}#{v}" for k, v in enumerate(rng.integers(0, 9, 4))] for _ in range(n)]
    a, b = make(600), make(500)
    c = next(overlaps(pa.array([a]), pa.array([b])))
    for i, j in ((0, 0), (5, 77), (599, 499)):
        assert c[i, j] == overlap(a[i], b[j])
