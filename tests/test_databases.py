"""Evaluation by database: own sessions, catalogs, run lists; and terms in free text."""

import json

import pytest

from ledgerlens.operators import vocabulary as V
from ledgerlens.plans import evaluate as E
from ledgerlens.sources import questions as J


def test_databases_may_share_table_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "BATCH", 2)
    monkeypatch.setattr(E, "SESSIONS", 1)
    for database, rows in (("one", [(1, "a"), (2, "b")]), ("two", [(1, "x")])):
        spark.createDataFrame(rows, "k int, v string").write.parquet(f"{tmp_path}/bench/{database}/facts.parquet")
    catalog = E.database_tables(spark, str(tmp_path))
    assert {(r["benchmark"], r["database"], r["name"]) for r in catalog.collect()} == {("bench", "one", "facts"), ("bench", "two", "facts")}
    sql = "SELECT v FROM facts ORDER BY v"
    rows = [("1", "bench", "one"), ("2", "bench", "two"), ("3", "bench", "one"), ("4", "bench", "three"), ("5", None, "one"), ("6", "bench", "two")]
    questions = spark.createDataFrame([(i, b, d, "simple", sql, {}, None) for i, b, d in rows], "id string, benchmark string, database string, difficulty string, sql string, variants map<string,string>, order_relevant boolean")
    # an answer that names another database's rows, a wrong one replaced by a right one, none, and a statement that fails
    answers = [("1", 0, sql), ("2", 0, "SELECT 'a' AS v"), ("2", 1, sql), ("3", 0, "SELECT 'x' AS v"), ("4", 0, sql), ("5", 0, sql), ("6", 0, "SELECT w FROM facts"), ("7", 0, sql)]
    out = {r["query_id"]: r for r in E.evaluate_submission(spark, questions, spark.createDataFrame(answers, "id string, pos int, sql string"), catalog=catalog).collect()}
    assert set(out) == {"1", "2", "3", "4", "5", "6"}
    assert [out[i]["exo"] for i in "123"] == [1.0, 1.0, 0.0] and all(out[i]["success"] for i in "123")
    assert out["4"]["pred_error"] == "DB resolution failed: no database three in bench"
    assert out["5"]["pred_error"] == "DB resolution failed: no database one in "
    assert "UNRESOLVED_COLUMN" in out["6"]["pred_error"] and not out["6"]["success"]
    assert "facts" not in [t.name for t in spark.catalog.listTables()]


def test_one_question_by_id(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(f"{tmp_path}/bench/one/facts.parquet")
    catalog = E.database_tables(spark, str(tmp_path))
    rows = [("1", 0, "SELECT 0 AS v"), ("1", 4, "SELECT v FROM facts ORDER BY v"), ("2", 5, "SELECT w FROM facts"), ("3", 6, None)]
    schema = "id string, pos int, benchmark string, database string, difficulty string, sql string, variants map<string,string>, order_relevant boolean"
    questions = spark.createDataFrame([(i, p, "bench", "one", "simple", q, {}, None) for i, p, q in rows], schema)
    shown = E.run_question(spark, questions, "1", catalog=catalog)
    assert [r["v"] for r in shown.expected.collect()] == ["a", "b"] and shown.predicted is None and shown.outcome is None
    shown = E.run_question(spark, questions, "1", " SELECT v FROM facts ORDER BY v DESC\n", catalog)
    assert [r["v"] for r in shown.predicted.collect()] == ["b", "a"] and shown.errors == {}
    assert [(r["success"], r["exo"], r["exu"]) for r in shown.outcome.collect()] == [(True, 0.0, 1.0)]
    shown = E.run_question(spark, questions, "1", "SELECT nothing FROM facts", catalog)
    assert shown.predicted is None and "UNRESOLVED_COLUMN" in shown.errors["predicted"]
    assert [r["success"] for r in shown.outcome.collect()] == [False]
    shown = E.run_question(spark, questions, "2", "SELECT v FROM facts", catalog)
    assert shown.expected is None and "UNRESOLVED_COLUMN" in shown.errors["expected"] and shown.outcome.first()["gt_error"]
    assert E.run_question(spark, questions, "3", catalog=catalog).errors == {}
    assert E.run_statement(spark, "\nSELECT count(*) AS n FROM facts ", catalog, "bench", "one").first()["n"] == 2
    with pytest.raises(KeyError):
        E.run_question(spark, questions, "7", catalog=catalog)


def test_open_records_survive(spark, tmp_path):
    question = {
        "benchmark": "b", "database": "d", "id": "Q1", "question": "q", "dialect": "x", "sql": "SELECT 1", "sql.2": "SELECT 2", "sql.x": "no", "score": 5, "text5": "5", "none": None, "context/zone": [], "a~1b": 0,
        "schema": {"t": ["a", {"b": 1.5}]}, "context": {"query_time": 202509, "zone": "UTC", "user_profile": {"occupation": "o", "caliber": None, "currency": None, "la\"ng": ["de", 1], "region": {}, "department": {}, "preferences": []}},
        "metadata": {"difficulty": "simple", "query_tags": [], "order-relevant": None, "verified": True, "by": {"who": "me"}},
    }
    rows = [question, {"id": "Q0", "schema": "plain text"}, {"id": "Q2"}]
    (tmp_path / "q.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    first = J.read_questions(spark, str(tmp_path / "q.json"))
    by_id = {r["id"]: r for r in first.collect()}
    assert by_id["Q1"]["query_time"] == 202509 and json.loads(by_id["Q1"]["schema"]) == question["schema"]
    assert by_id["Q0"]["schema"] == '"plain text"' and by_id["Q2"]["schema"] is None and by_id["Q2"]["extra"] == {}
    assert {k: json.loads(v) for k, v in by_id["Q1"]["extra"].items()} == {
        "/sql.x": "no", "/score": 5, "/text5": "5", "/none": None, "/context~1zone": [], "/a~01b": 0, "/context/zone": "UTC", '/context/user_profile/la"ng': ["de", 1], "/metadata/by": {"who": "me"},
    }
    J.write_questions(first.repartition(3), str(tmp_path / "out"))
    again = J.read_questions(spark, str(tmp_path / "out"))
    assert again.orderBy("pos").collect() == first.orderBy("pos").collect()
    written = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert next(x for x in written if x["id"] == "Q1") == question
    (tmp_path / "list.json").write_text(json.dumps(rows), encoding="utf-8")
    assert J.read_questions(spark, str(tmp_path / "list.json"), lines=False).orderBy("pos").drop("pos").collect() == first.orderBy("pos").drop("pos").collect()


def test_terms_in_free_text(spark):
    known = [("country", "China", ["People's Republic of China", "中国", "PRC"]), ("region", "Asia-Pacific", ["APAC", "---"]), ("country", "New Zealand", None), ("product", "PRC", None)]
    dictionary = spark.createDataFrame(known, "field string, standard_word string, synonyms array<string>")
    texts = [(1, "Revenue of the PEOPLE’S republic-of China, asia pacific"), (2, "中国的收入 in newzealand"), (3, "new zealand new-zealand prc"), (4, None), (5, ""), (6, "people s republic of"), (7, "word " * 3000 + "apac")]
    got = V.find_terms(spark.createDataFrame(texts, "id int, text string"), "text", dictionary).collect()
    assert sorted((r["id"], r["start"], r["term"], r["field"], r["standard_word"]) for r in got) == [
        (1, 4, "people s republic of china", "country", "China"), (1, 8, "china", "country", "China"), (1, 9, "asia pacific", "region", "Asia-Pacific"),
        (2, 1, "中 国", "country", "China"),
        (3, 1, "new zealand", "country", "New Zealand"), (3, 3, "new zealand", "country", "New Zealand"), (3, 5, "prc", "country", "China"), (3, 5, "prc", "product", "PRC"),
        (7, 3001, "apac", "region", "Asia-Pacific"),
    ]
    assert V.find_terms(spark.createDataFrame(texts, "id int, text string"), "text", dictionary.limit(0)).count() == 0
