"""Held-out accuracy, shrinkage of sparse sites and cases."""

from ledgerlens.llm import quality_classifier as Q
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = Q.classify(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "score").collect()
    good = sorted(r["score"] for r in rows if r["quality"] == 1)
    bad = sorted(r["score"] for r in rows if r["quality"] == 0)
    above = sum(sum(g > b for b in bad) + 0.5 * sum(g == b for b in bad) for g in good) / (len(good) * len(bad))
    print("AUC", above, "kept of good", sum(g >= 0.5 for g in good) / len(good), "kept of bad", sum(b >= 0.5 for b in bad) / len(bad))
    assert above > 0.9
    assert sum(g >= 0.5 for g in good) >= 0.97 * len(good)


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", 1)] * 200 + [("mean", "a", 0)] * 200 + [("tiny", "a", 0)] + [("mixed", "b", i % 2) for i in range(100)]
    table = spark.createDataFrame(rows, "host string, path string, good int").selectExpr("host", "path", "cast(good * 1000000 as bigint) AS chance")
    sites, (mean, of_hosts, of_paths) = Q.site_posteriors(table)
    assert abs(mean - 250 / 501) < 1e-9 and 1 <= of_hosts < 50
    found = {r["host"]: (r["host_sum"] / 1e6 + of_hosts * mean) / (r["host_n"] + of_hosts) for r in sites.collect()}
    assert found["mean"] < 0.05 < 0.2 < found["tiny"] < mean and found["big"] > 0.95 and of_paths >= 1


def test_cases(spark):
    schema = "doc_id bigint, text string, lang string, source string, score string"
    rows = [(1, None, None, None, "x"), (2, "", "en", "s", "x"), (3, "same text", "en", "s", "x"), (3, "same text", "en", "s", "x"), (None, "no id", "en", "s", "x"), (6, "long " * 500_000, "en", "s", "x")]
    docs = spark.createDataFrame(rows, schema)
    for marks in ([], [(1, 1)], [(1, 0), (None, 1), (3, None), (6, 1), (3, 1), (3, 0), (7, 1)]):
        labels = spark.createDataFrame(marks, "doc_id bigint, quality int")
        got = Q.classify(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        same = [r["score"] for r in got if r["doc_id"] == 3]
        assert same[0] == same[1]
    assert Q.classify(docs.limit(0), labels).count() == 0
