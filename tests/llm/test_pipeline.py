"""The stages against plain Python on a small fixture, and all of them on a table."""

import pytest

from ledgerlens.llm import quality_rules, simhash
from ledgerlens.llm import packing, pii, quality_rules, simhash, toxicity
from tests.conftest import DATA

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = f"{DATA}/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    known = quality_rules.references(docs)
    kept = [r for r in rows if quality_rules.judged(r["text"], r["lang"], known, quality_rules.Limits())[-3]]
    got = corpus_pipeline.quality(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in got.collect())
    model = toxicity.train(got, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in kept if model.score(r["text"]) < 0.5]
    got = corpus_pipeline.toxic(spark, got, SF)
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in got.collect())
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) & (2**64 - 1) for r in kept}
    left = sorted(prints)
    best = dict(zip(left, left))
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if best[b] < best[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    best[a], changed = best[b], True
    got = corpus_pipeline.near_duplicates(spark, got, SF)
    assert sorted(set(best.values())) == sorted(r["doc_id"] for r in got.collect())
    field = pii.train_field(got)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    clean = corpus_pipeline.personal_data(spark, got, SF)
    assert clean.columns == docs.columns
    for r in clean.collect():
        known_, added = pii.find(texts[r["doc_id"]], field)
        assert r["text"] == pii.redact(texts[r["doc_id"]], known_ + added) and r["n_chars"] == len(r["text"])
    result = corpus_pipeline.packed(spark, clean, SF).collect()
    assert {r["doc_id"] for r in result} == set(texts)
    used = {}
    for r in result:
        used.setdefault((r["bin"], r["capacity"]), []).append((r["bin_offset"], r["length"]))
    for (_, capacity), parts in used.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end <= capacity and capacity == min(c for c in packing.CAPACITIES if c >= end)


def test_one_of_each_cases(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text, 1), (2, text, 1), (2, text, 0), (None, text, 1), (None, "lonely text without any id", 1), (None, "lonely text without any id", 1), (9, None, 1), (10, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted([tuple(r) for r in simhash.one_of_each(docs).collect()], key=repr)
    assert got == sorted([(2, text, 0), (None, "lonely text without any id", 1), (9, None, 1)], key=repr)


def test_whole_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_that_clash_and_maps(spark):
    """Names that stages use inside, and columns without an order, pass through."""
    text = "Plain words of a sentence that goes on, with commas and a full stop at the end. " * 12
    rows = [(1, text, "en", {"a": 1}, "r", "l"), (2, text + "more", "en", {"b": 2}, "r2", "l2"), (2, text + "more", "en", {"c": 2}, "r3", None), (None, text[:700], None, None, "r", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, notes map<string,int>, _reference string, _OF_LANG string")
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["_reference"], r["_OF_LANG"]) for r in kept.collect()} <= {(r[0], r[4], r[5]) for r in rows}
    assert quality_rules.judge(docs).count() == len(rows)
    single = simhash.one_of_each(docs)
    assert single.columns == docs.columns
    assert all(isinstance(r["notes"], dict | None) for r in single.collect())
