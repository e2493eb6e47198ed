"""Links by the inverted multi-index against all pairs."""

import numpy as np
import pytest

from ledgerlens.llm import embedding_dedup as E
from tests.conftest import DATA

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell string"


def by_pairs(rows, threshold=0.93):
    valid = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    links, parent = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(valid):
        for j in valid[x + 1 :]:
            a, b = np.array(rows[i][1], dtype=float), np.array(rows[j][1], dtype=float)
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], links[i], least.get(top(i)), r[0] is not None and r[0] == least.get(top(i))) for i, r in enumerate(rows)), key=repr)


def planted(seed, n, width=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, width))
    rows = []
    for i in range(n):
        x = base[rng.integers(len(base))] + rng.standard_normal(width) * rng.choice([0, 0.1, 0.3])
        rows.append((i, [float(np.float32(v)) for v in x * rng.choice([1, 3])], int(rng.integers(3)), "x"))
    return rows


def test_planted_links_are_found(spark):
    rows = planted(1, 400)
    want = by_pairs(rows)
    for chunk in (1024, 8):
        got = sorted([tuple(r) for r in E.near_vectors(spark.createDataFrame(rows, SCHEMA), codewords=6, chunk=chunk).collect()], key=repr)
        found = sum(min(a[1], b[1]) for a, b in zip(got, want))
        assert [r[0] for r in got] == [r[0] for r in want] and all(a[1] <= b[1] for a, b in zip(got, want))
        assert found >= 0.99 * sum(r[1] for r in want)


@pytest.mark.parametrize("codewords", [8, 16, 32, 64])
def test_recall_of_finer_grids(spark, codewords):
    """Pairs spread around the threshold, in one label, against all pairs; links are counted on both sides."""
    rng = np.random.default_rng(codewords)
    base = rng.standard_normal((900, 32))
    x = np.concatenate([base + rng.standard_normal(base.shape) * s for s in (0, 0.2, 0.27, 0.3)]).astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in E.near_vectors(spark.createDataFrame(rows, SCHEMA), codewords=codewords).collect()}
    want = near.sum(1)
    assert all(got[i] <= want[i] for i in range(len(rows)))
    found = sum(got.values())
    print("codewords", codewords, "recall", found / want.sum())
    assert found % 2 == 0 and want.sum() > 1500 and found >= 0.99 * want.sum()


def test_the_grid_grows_with_the_largest_label():
    for rows in (1, 5_000, 40_000, 2_000_000, 100_000_000):
        k = E._grid_for(rows)
        assert k == E.COARSEST or E.CELL_ROWS / 2 <= rows / k**2 <= 2 * E.CELL_ROWS
    assert E._grid_for(10**12) == E.FINEST


def test_cases(spark):
    one, near = [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.5]
    nan, inf = float("nan"), float("inf")
    rows = [
        (7, one, 1, "x"), (3, near, 1, "x"), (5, one, 2, "x"), (5, one, 2, "x"), (9, one, None, "x"), (11, None, 1, "x"), (12, [], 1, "x"),
        (13, [0.0] * 4, 1, "x"), (14, [0.0] * 4, 1, "x"), (15, [1.0, None, 3.0, 4.0], 1, "x"), (16, [nan, 1.0, 1.0, 1.0], 1, "x"), (17, [inf, 1.0, 1.0, 1.0], 1, "x"),
        (None, one, 1, "x"), (None, [-1.0, 0.0, 0.0, 0.0], 1, "x"), (20, [1.0, 2.0, 3.0], 1, "x"), (21, [v * 1e-30 for v in one], 1, "x"), (22, [2.0], 3, "x"), (23, [5.0], 3, "x"),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted([tuple(r) for r in E.near_vectors(docs).collect()], key=repr) == by_pairs(rows)
    assert E.near_vectors(docs.limit(0)).count() == 0
    assert E.near_vectors(docs.where("embedding IS NULL")).count() == 1


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet")
    rows = [tuple(r) for r in docs.select("vec_id", "embedding", "label").collect()]
    assert sorted([tuple(r) for r in E.near_vectors(docs).collect()], key=repr) == by_pairs(rows)
