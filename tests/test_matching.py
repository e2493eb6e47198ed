"""Spread matchings against the kernel that solves one pair in one task."""

import random

import numpy as np

from ledgerlens.functions.alignment import best_matching
from ledgerlens.operators import matching as M

SCHEMA = "query_id string, variant int, side string, id bigint, marks array<string>"


def marks(row):
    return [f"{k}:{v}" for k, v in enumerate(row)]


def test_spread_matchings_weigh_as_much(spark):
    rng = random.Random(3)
    rows, best = [], {}
    for q in range(12):
        width, values = rng.randint(1, 4), rng.randint(2, 6)
        p, g = ([tuple(rng.randint(0, values) + 10 * (q == 11) * side for _ in range(width)) for _ in range(rng.randint(1, 24))] for side in (0, 1))
        overlap = np.array([[sum(x == y for x, y in zip(a, b)) for b in g] for a in p])
        held = best_matching(overlap)
        best[str(q)] = int(overlap[np.flatnonzero(held >= 0), held[held >= 0]].sum())
        rows += [(str(q), 0, side, i * 70_000, marks(r)) for side, table in (("p", p), ("g", g)) for i, r in enumerate(table)]
    got = M.heaviest_matching(spark.createDataFrame(rows, SCHEMA), block=8).collect()
    cells = {(r[0], r[2], r[3]): set(r[4]) for r in rows}
    assert all(r["shared"] == len(cells[r["query_id"], "p", r["p"]] & cells[r["query_id"], "g", r["g"]]) > 0 for r in got)
    for side in ("p", "g"):
        assert len({(r["query_id"], r[side]) for r in got}) == len(got)
    assert {q: sum(r["shared"] for r in got if r["query_id"] == q) for q in best} == best and best["11"] == 0
    assert M.heaviest_matching(spark.createDataFrame([], SCHEMA)).count() == 0
