"""Sparse edges against the whole matrix."""

import random

import pytest

from ledgerlens.operators import edges as E
from ledgerlens.operators import rows as R
from tests.helpers import overlap, results


@pytest.mark.parametrize("heavy", [1, 6, 40, 10**9])
def test_row_weights(spark, heavy):
    rnd = random.Random(heavy)
    cases = {}
    for k in range(6):
        pred = [(rnd.choice([0, 0, None, rnd.randrange(30)]), rnd.choice([0, rnd.randrange(4)]), None if k % 2 else rnd.randrange(50)) for _ in range(rnd.randrange(25))]
        gold = [(rnd.choice([0, 0, None, rnd.randrange(30)]), rnd.choice([0, rnd.randrange(4)]), None if k % 2 else rnd.randrange(50)) for _ in range(rnd.randrange(1, 25))]
        cases[f"q{k}"] = (pred, [gold, gold[:2]])
    cases["none"] = ([(1, 2, 3)], [[]])
    rows, pairs = results(spark, cases, ["int", "int", "int"])
    sided = R.pair_sides(rows, pairs)
    got = {(r["query_id"], r["variant"], r["row_idx"]): r for r in E.row_weights(sided, heavy=heavy).collect()}
    want = 0
    for query, (pred, golds) in cases.items():
        for v, gold in enumerate(golds):
            for i, row in enumerate(pred):
                shared = [overlap(row, other) for other in gold]
                r = got[query, v, i]
                assert r["partners"] == sum(c > 0 for c in shared)
                assert r["best"] == pytest.approx(max(shared, default=0) / 3) and r["total"] == pytest.approx(sum(shared) / 3)
                want += 1
    assert len(got) == want
    edges, classes, _ = E.sparse_weights(sided, heavy)
    listed = {(r["query_id"], r["variant"], r["p_row"], r["g_row"]): r for r in edges.collect()}
    for (query, v, i, j), r in listed.items():
        both = len(set(r["p_heavy"]) & set(r["g_heavy"]))
        assert r["light"] > 0 and r["light"] + both == overlap(cases[query][0][i], cases[query][1][v][j])
    assert (classes.count() == 0) == (heavy == 10**9) and (not listed) == (heavy == 1)


def test_a_value_in_every_row_makes_no_pairs(spark):
    """3,000 rows a side that share a null and a zero: nine million pairs are two classes."""
    table = [(0, None, i) for i in range(3000)]
    rows, pairs = results(spark, {"q": (table, [table[::-1]])}, ["int", "int", "int"])
    edges, classes, _ = E.sparse_weights(R.pair_sides(rows, pairs))
    assert edges.count() == 3000 and classes.count() == 1
    weights = E.row_weights(R.pair_sides(rows, pairs)).agg({"partners": "min", "best": "min", "total": "max"}).first()
    assert weights["min(partners)"] == 3000 and weights["min(best)"] == 1.0 and weights["max(total)"] == pytest.approx((2 * 3000 + 1) / 3)


def test_large_and_common_pairs_have_equal_weights(spark):
    """Pairs worked out in one task and from shuffled edges, next to each other and each alone."""
    rnd = random.Random(3)
    row = lambda: (rnd.choice([0, None, rnd.randrange(9)]), rnd.choice([0, rnd.randrange(4)]), rnd.randrange(20))
    cases = {f"q{k}": ([row() for _ in range(k)], [[row() for _ in range(9 - k)], []]) for k in range(1, 9)}
    rows, pairs = results(spark, cases, ["int", "int", "int"])
    sided = R.pair_sides(rows, pairs)
    found = [sorted(map(tuple, E.row_weights(sided, heavy=6, pairs=pairs, near=near).collect())) for near in (E.NEAR, 16, -1)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * sum(range(1, 9))


def test_common_pairs_shuffle_no_marks(spark):
    rows, pairs = results(spark, {"q": ([(1, 2)], [[(1, 3)]])}, ["int", "int"])
    text = E.row_weights(R.pair_sides(rows, pairs), pairs=pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "mark" not in text and "MapInArrow" in text
