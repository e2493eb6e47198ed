"""Runs through suffix trees against all periods tried one by one."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import runs as R
from tests.conftest import DATA


def least_period(s):
    border, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = border[k - 1]
        k += s[i] == s[k]
        border[i] = k
    return len(s) - border[-1]


def plain(s, least=24, periods=3):
    """Stretches in which words q apart are equal, for every q."""
    s, out = np.asarray(s), []
    for q in range(1, len(s) // periods + 1):
        same = np.diff(np.concatenate([[0], (s[q:] == s[:-q]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(same == 1).tolist(), np.flatnonzero(same == -1).tolist()):
            if b - a + q >= max(least, periods * q) and least_period(s[a : b + q].tolist()) == q:
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain(np.unique(words, return_inverse=True)[1] if words else np.zeros(0))
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(found), *facts, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(8))
def test_small_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        s = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randint(0, 70))]
        if rnd.random() < 0.5 and len(s) > 6:
            a, p = rnd.randrange(len(s) - 6), rnd.randint(1, 6)
            s[a:] = [s[a + (i - a) % p] for i in range(a, len(s))]
        for least, periods in ((2, 2), (4, 3), (24, 3)):
            assert list(map(tuple, R.runs_of(np.array(s, dtype=np.int64), least, periods).tolist())) == plain(s, least, periods)
        assert list(map(tuple, R.document_runs(np.array(s, dtype=np.int64)).tolist())) == plain(s)


def test_common_extensions():
    rnd = random.Random(4)
    s = [rnd.randrange(2) for _ in range(300)]
    found = R.SuffixTree(s).common_extensions()
    one, two = np.array([(i, j) for i in range(300) for j in range(300) if i != j]).T
    want = []
    for i, j in zip(one.tolist(), two.tolist()):
        k = 0
        while max(i, j) + k < 300 and s[i + k] == s[j + k]:
            k += 1
        want.append(k)
    assert found.lengths(one, two).tolist() == want
    assert R.SuffixTree(s).suffix_order(False).tolist() == sorted(range(300), key=lambda i: s[i:])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in R.digest(docs).collect())
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs.collect())
    assert sum(r[1] for r in got)


def test_cases(spark):
    # 37 is one of the ids whose documents are made periodic
    assert zlib.crc32(b"37") % 10 == 0
    rows = [(1, None), (2, ""), (3, "a\x1cb   c"), (3, "a b c " * 20), (3, "a b c " * 20), (None, "x y " * 30), (37, "one two three four " * 30), (37, ""), (5, "z " * 60_000), (7, "a b " * 11 + "a"), (8, "a b " * 12)]
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id bigint, text string, runs string, n_words int")
    got = R.digest(docs).collect()
    by_row = sorted([tuple(r) for r in got if r["doc_id"] != 5], key=repr)
    assert by_row == sorted((expected(*row) for row in rows if row[0] != 5), key=repr)
    long = next(r for r in got if r["doc_id"] == 5)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 60_000, 1)
    assert R.digest(docs.limit(0)).count() == 0
    plain_rows = {r["doc_id"]: r for r in R.find_runs(docs.where("doc_id IN (7, 8)")).collect()}
    assert not plain_rows[7]["runs"] and plain_rows[8]["collapsed"] == "a b"
