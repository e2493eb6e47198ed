"""Packing on the histogram against packing piece by piece."""

import random
from collections import Counter

import pytest

from ledgerlens.llm import packing as P
from tests.conftest import DATA


def one_by_one(lengths, capacities, cost=P.attention_cost):
    """Best-fit in order of falling length; the contents of each bin with its final size."""
    bins = []  # [capacity, used, contents]
    for i, length in enumerate(sorted(lengths, reverse=True)):
        fits = [b for b in bins if b[0] - b[1] >= length]
        if fits:
            chosen = min(fits, key=lambda b: b[0] - b[1])
        else:
            size = min((c for c in sorted(capacities) if c >= length), key=lambda c: (cost(c) / (c // length), c))
            chosen = [size, 0, []]
            bins.append(chosen)
        chosen[1] += length
        chosen[2].append(length)
    return Counter((min(c for c in capacities if c >= used), tuple(sorted(held))) for _, used, held in bins)


def unrolled(plan):
    bins = {}
    for length, first, last, at, each, used, capacity in plan:
        for rank in range(first, last):
            number = at + (rank - first) // each
            bins.setdefault(number, (capacity, []))
            assert bins[number][0] == capacity
            bins[number][1].append((used + (rank - first) % each * length, length))
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_same_as_piece_by_piece(seed):
    rnd = random.Random(seed)
    capacities = rnd.choice([(8, 16, 32), (10,), (7, 12, 30, 31), (64, 128)])
    lengths = [rnd.randint(1, max(capacities)) if rnd.random() < 0.7 else rnd.choice([1, 3, 5]) for _ in range(rnd.randint(0, 120))]
    bins = unrolled(P.plan_bins(Counter(lengths), capacities))
    assert Counter((c, tuple(sorted(n for _, n in held))) for c, held in bins.values()) == one_by_one(lengths, capacities)
    for capacity, held in bins.values():
        at = 0
        for start, length in sorted(held):
            assert start == at
            at += length
        assert at <= capacity


def test_plan_does_not_grow_with_the_documents():
    few = {n: 3 + n % 7 for n in range(1, 200)}
    many = {n: count * 10**9 for n, count in few.items()}
    assert len(P.plan_bins(many, (64, 128, 200))) < 4000
    assert sum(last - first for _, first, last, *_ in P.plan_bins(many, (64, 128, 200))) == sum(many.values())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = P.pack(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {d: len(t.encode().split()) for d, t in texts.items()}
    assert Counter(r["doc_id"] for r in rows) == {d: max(1, -(-n // 8192)) for d, n in words.items()}
    for d, n in words.items():
        mine = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == d)
        assert sum(length for _, length in mine) == n and [s for s, _ in mine] == [8192 * i for i in range(len(mine))]
    bins = {}
    for r in rows:
        if r["length"]:
            bins.setdefault(r["bin"], (r["capacity"], []))[1].append((r["bin_offset"], r["length"]))
    expected = one_by_one([r["length"] for r in rows if r["length"]], P.CAPACITIES)
    assert Counter((c, tuple(sorted(n for _, n in held))) for c, held in bins.values()) == expected


def test_one_length_in_small_buckets(spark):
    docs = spark.createDataFrame([(i, "w " * (3 if i % 3 else 5)) for i in range(1000)], "doc_id bigint, text string")
    rows = P.pack(docs, (8, 16), bucket=16).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1000))
    places = {(r["bin"], r["bin_offset"]) for r in rows}
    assert len(places) == 1000
    assert all(r["bin_offset"] + r["length"] <= r["capacity"] for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "c " * 20, 5), (3, "c " * 20, 5)], "doc_id bigint, text string, length int"
    )
    rows = P.pack(docs, (4, 16)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (1, 0), (2, 0), (3, 4), (3, 4), (3, 16), (3, 16)]
    assert all((r["bin"] is None) == (r["length"] == 0) for r in rows)
    assert P.pack(docs.where("false")).count() == 0


def test_lengths_are_tokens(spark):
    """Texts without blanks are cut, and no bin holds more tokens than its capacity."""
    import public_tokenizers
    from ledgerlens.llm import bpe

    table = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    find = bpe.splitter(public_tokenizers.PATTERN).findall
    rnd = random.Random(2)
    base64 = "".join(rnd.choice("abcdefghijABCDEFGHIJ0123456789+/") for _ in range(4000))
    texts = {1: base64, 2: "漢字仮名交じり文" * 40, 3: "plain words, and marks.", 4: "", 5: None, 6: '{"a":1,"b":[2,3]}' * 50, 7: " \n "}
    rows = [*texts.items(), (3, texts[3]), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tokens = [(d, sum(len(bpe.encode_word(w.encode(), table)) for w in find(t or ""))) for d, t in rows]
    assert sorted(map(repr, ((r["doc_id"], r["n"]) for r in bpe.token_counts(docs).collect()))) == sorted(map(repr, tokens))
    got = P.pack_tokens(docs, (64, 128)).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert r["start"] == 128 * r["piece"] and r["length"] <= 128 and (r["bin"] is None) == (r["length"] == 0)
        assert r["bin"] is None or r["bin_offset"] + r["length"] <= r["capacity"]
    want = Counter()
    for d, n in tokens:
        want[d] += n
    assert total == want and want[1] > 1000
    assert Counter(r["doc_id"] for r in got)[1] == -(-want[1] // 128)
    assert P.pack_tokens(docs.where("false")).count() == 0


def test_registered_query_counts_tokens(spark):
    from ledgerlens.llm import bpe, queries

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    packed = queries.registry.queries["op10_best_fit_packing"](spark, f"{DATA}/sf0.001")
    got = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert got == {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs).collect()}
