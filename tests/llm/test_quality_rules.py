"""Quality rules: counts by plain loops, distances by their definition, the cases of the docstring."""

import math
import random
import re
from collections import Counter

import numpy as np

from ledgerlens.llm import quality_rules as Q
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r["doc_id"]][n] for n in NAMES) == brute(r["text"])
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    good = [got[d]["kept"] for d, q in labels.items() if q == 1 and d in got and not got[d]["base_failed"]]
    assert sum(good) >= 0.98 * len(good)


def test_random_texts():
    parts = ["a", "bb", "c", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "é", "漢字", "#", "$", "<", "a b c", "\na\n"]
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 200)))
        assert Q.base_counts(text.encode()) == brute(text)


def test_distance_by_definition():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.25, 0.25, 0.5])
    m = (p + q) / 2
    want = sum(x * math.log2(x / y) / 2 for side in (p, q) for x, y in zip(side, m) if x)
    assert abs(Q.js_distance(p, q) - math.sqrt(want)) < 1e-12
    assert Q.js_distance(p, p) == 0 and abs(Q.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) - 1) < 1e-12


def test_cases(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, plain, "en", "c"), (3, plain, "en", "c"), (None, plain, None, "d"), (6, "word " * 200_000, "xx", "e"), (7, " \n\t ", None, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept string")
    got = Q.judge(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["base_failed"]} == {1, 2, 6, 7}
    assert len({tuple(r)[1:] for r in got if r["doc_id"] == 3}) == 1
    assert Q.judge(docs.limit(0)).count() == 0
    assert Q.passing(docs).columns == docs.columns
    assert Q.passing(docs.drop("lang")).columns == ["doc_id", "text", "kept"]


def test_only_the_own_language_counts(spark):
    """Without a reference of its own language a clean document is kept; more than 256 languages have theirs."""
    draw = random.Random(9)

    def prose(words, n):
        return " ".join(draw.choice(words) for _ in range(n))

    german = [f"wort{i}" for i in range(80)]
    greek = ["".join(draw.choice("αβγδεζηθικλμ") for _ in range(6)) for _ in range(80)]
    rows = [(i, prose(german, 300), "de") for i in range(20)]
    rows += [(100, prose(greek, 300), "el"), (101, prose(greek, 300), None), (102, prose(german, 300), None), (103, prose(greek, 300), "de")]
    for k in range(300):  # small languages of equal size, each with a reference
        own = [f"{chr(97 + k % 26)}{k}x{i}" for i in range(60)]
        rows += [(1000 + 10 * k + i, prose(own, 1100), f"l{k:03}") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in Q.judge(docs).collect()}
    assert len(got) == len(rows)
    assert {d for d, r in got.items() if not r["kept"]} == {103}
    assert all(got[d]["char_distance"] is None and got[d]["word_distance"] is None for d in (100, 101, 102))
    assert all(r["word_distance"] < 0.4 for d, r in got.items() if d >= 1000 or d < 20)
    assert {r["doc_id"] for r in Q.passing(docs).collect()} == set(got) - {103}
