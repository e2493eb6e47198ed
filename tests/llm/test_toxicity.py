"""Held-out accuracy and cases of the toxicity classifier."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity as T
from ledgerlens.llm import training_sample as S
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = T.score(docs, T.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    print("recall", sum(caught) / len(caught), "false alarms", sum(clean) / len(clean))
    assert sum(caught) >= 0.6 * len(caught) and sum(clean) <= 0.05 * len(clean)


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same", "x"), (3, "same", "x"), (None, "no id", "x"), (6, "long " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    for marks in ([], [(1, 1)], [(1, 0), (None, 1), (3, None), (6, 1), (3, 1), (3, 0), (4, 0)]):
        model = T.train(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"))
        got = T.score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert T.score(docs.limit(0), model).count() == 0
    assert T.passing(docs, model).columns == docs.columns


def grams(text):
    s = f" {' '.join((text or '').lower().split())} "
    return [s[i : i + n] for n in T.SIZES for i in range(len(s) - n + 1)] if len(s) > 2 else []


def number(gram):
    h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
    for c in gram:
        h = (h ^ ord(c) + 1) * 0x01000193 & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x2C1B3C6D & 0xFFFFFFFF
    h ^= h >> 13
    return h >> 32 - T.HASH_BITS


def test_ratios_are_those_of_plain_counts(spark):
    """Characters, not bytes: letters of several bytes are one character."""
    rows = [(i, text, i % 3 == 0) for i, text in enumerate(["Ünder  é\n中文字符 idiot", "clean 中文 words ée", "IDIOT é中", "über clean 中文字", None, "", "idiot é", "clean é", "a"])]
    want = [Counter(), Counter()]
    for _, text, toxic in rows:
        want[toxic].update({number(g) for g in grams(text)})
    p, q = (np.array([want[k][g] for g in range(T.WIDTH)]) + T.SMOOTHING for k in (True, False))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[[g for g in range(T.WIDTH) if want[0][g] + want[1][g] < T.MIN_DOCS]] = 0
    frame = spark.createDataFrame([(t, int(k)) for _, t, k in rows], "text string, kind int").repartition(3)
    assert np.allclose(T.log_count_ratios(frame), ratio, atol=1e-12) and np.count_nonzero(ratio)
    for _, text, _ in rows:
        counted = Counter(number(g) for g in grams(text))
        assert dict(zip(*(x.tolist() for x in T.ngram_counts(text)))) == counted


def test_long_text_is_counted_in_blocks():
    text = "ab çd " * 60_000
    found = dict(zip(*(x.tolist() for x in T.ngram_counts(text))))
    assert found == Counter(number(g) for g in grams(text))


def test_sample_is_bounded_and_of_the_smallest_hashes(spark):
    known = spark.range(5_000).selectExpr("id AS doc_id", "cast(id % 10 = 0 AS int) AS kind")
    docs = spark.range(100, 6_000).selectExpr("id AS doc_id", "cast(id AS string) AS text").unionByName(spark.createDataFrame([(200, "again")] * 50, "doc_id bigint, text string"))
    present, sizes = S.labelled_ids(docs, known)
    assert sizes == {0: 4410, 1: 490}
    chosen = S.smallest_hashes(present, sizes, 300).collect()
    assert Counter(r["kind"] for r in chosen) == {0: 300, 1: 300}
    shares = {r["doc_id"]: r["s"] for r in present.select("doc_id", S.share_of(F.col("doc_id")).alias("s")).collect()}
    assert all(0 <= s < 1 for s in shares.values())
    for kind in (0, 1):
        ids = sorted((d for d in shares if (d % 10 == 0) == kind), key=lambda d: (shares[d], d))
        assert {r["doc_id"] for r in chosen if r["kind"] == kind} == set(ids[:300])
