import json

import pytest

from ledgerlens.operators import questions as Q
from ledgerlens.plans import evaluate as V
from ledgerlens.sources import questions as J

QUESTIONS = [
    {
        "benchmark": "b", "database": "d", "id": "Q1", "question": "Wie viel?", "dialect": "duckdb",
        "context": {"query_time": 202408, "user_profile": {"occupation": "Sales", "currency": "EUR", "region": {"a": "Berlin", "b": ["Rom", "Bari"]}, "department": {}, "preferences": ["short"]}},
        "sql": "SELECT 1 AS x ORDER BY x", "sql.10": "SELECT 10", "sql.2": "SELECT 1 AS y", "sql.x": "no",
        "metadata": {"difficulty": "simple", "query_tags": ["type-basic"], "order-relevant": None, "verified": True},
    },
    {"id": "Q2", "question": "", "sql": "SELECT nothing", "metadata": {"query_tags": [], "order-relevant": False}},
    {"id": "Q3", "question": "", "sql": "SELECT 3 AS x -- order by x", "metadata": {}},
    {"id": "Q4", "question": "", "sql": "SELECT 4", "metadata": {"difficulty": "hard"}},
    {"id": "Q5", "question": "", "sql": "SELECT 5", "metadata": {"difficulty": "hard"}},
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("lines", [True, False])
def test_questions(spark, tmp_path, lines):
    text = "\n".join(map(json.dumps, QUESTIONS)) if lines else json.dumps(QUESTIONS, indent=2)
    questions = J.read_questions(spark, write(tmp_path / "q.json", text), lines)
    first = questions.orderBy("id").first()
    assert (first["occupation"], first["verified"], first["order_relevant"]) == ("Sales", True, None)
    assert first["region"] == {"a": ["Berlin"], "b": ["Rom", "Bari"]}
    assert [r["sql"] for r in Q.gold_variants(questions).where("id = 'Q1'").orderBy("variant").collect()] == [
        "SELECT 1 AS x ORDER BY x", "SELECT 10", "SELECT 1 AS y",
    ]
    assert {r["id"]: r["ordered"] for r in Q.is_ordered(questions).collect()} == {"Q1": True, "Q2": False, "Q3": False, "Q4": False, "Q5": False}
    assert Q.keyword_search(questions, "bari", "q1").count() == 1
    assert Q.filter_difficulty(questions, "unknown").count() == 0
    J.write_questions(questions, str(tmp_path / "out"))
    again = J.read_questions(spark, str(tmp_path / "out"))
    assert again.drop("pos").orderBy("id").collect() == questions.drop("pos").orderBy("id").collect()


def test_malformed_questions_fail(spark, tmp_path):
    with pytest.raises(Exception):
        J.read_questions(spark, write(tmp_path / "q.json", "{not json"), True).collect()


def test_submission(spark, tmp_path):
    path = write(tmp_path / "s.json", json.dumps({"Q1": "SELECT 1", "Q2": None}))
    assert {r["id"]: r["sql"] for r in J.read_submission(spark, path).collect()} == {"Q1": "SELECT 1", "Q2": ""}
    bad = write(tmp_path / "bad.json", json.dumps({"Q1": 5, " ": "x", "Q3": "SELECT 3"}))
    errors = {r["id"]: r["error"] for r in J.read_submission(spark, bad, strict=False).collect()}
    assert errors["Q3"] is None and "must be a SQL string" in errors["Q1"] and "non-empty" in errors[" "]
    with pytest.raises(Exception):
        J.read_submission(spark, bad).collect()


def test_stable_sample_grows(spark):
    questions = spark.range(300).selectExpr("id AS pos", "concat('Q', id) AS id")
    small = [r["id"] for r in Q.stable_sample(questions, 20, 7).collect()]
    large = [r["id"] for r in Q.stable_sample(questions, 60, 7).collect()]
    assert set(small) < set(large) and len(large) == 60
    assert Q.stable_sample(questions, 1000, 7).count() == 300
    places = [int(i[1:]) for i in large]
    assert places == sorted(places)


def test_evaluation_of_a_submission(spark, tmp_path):
    questions = J.read_questions(spark, write(tmp_path / "q.json", "\n".join(map(json.dumps, QUESTIONS))))
    answers = {"Q1": "SELECT 1", "Q2": "SELECT 1", "Q3": "SELEC 3", "Q4": None, "Q5": "SELECT id / (id - 1) FROM range(5)", "Q9": "SELECT 9"}
    submission = J.read_submission(spark, write(tmp_path / "s.json", json.dumps(answers)))
    got = {r["query_id"]: r for r in V.evaluate_submission(spark, questions, submission).collect()}
    assert set(got) == {"Q1", "Q2", "Q3", "Q4", "Q5"}
    assert got["Q1"]["success"] and got["Q1"]["exo"] == 1.0 and got["Q1"]["variant"] == 0 and got["Q1"]["ordered"]
    assert not got["Q2"]["success"] and got["Q2"]["pred_error"].startswith("GT execution failed") and got["Q2"]["gt_error"]
    assert "PARSE_SYNTAX_ERROR" in got["Q3"]["pred_error"] and got["Q3"]["gt_error"] is None
    assert got["Q4"]["pred_error"] == "No prediction provided"
    assert not got["Q5"]["success"] and "DIVIDE_BY_ZERO" in got["Q5"]["pred_error"]


def test_pair_keeps_equal_column_names_and_row_order(spark):
    _, _, scores = V.run_sql_pair(
        spark,
        "SELECT id AS a, id * 2 AS a FROM range(500) ORDER BY id DESC",
        "SELECT id AS a, id * 2 AS b FROM range(500) ORDER BY id DESC",
    )
    row = scores.first()
    assert (row["n"], row["exo"], row["exu"], row["bfo"]) == (500, 1.0, 1.0, 1.0)


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    """Several files, several blocks each, blank lines between: positions are dense and in order."""
    from ledgerlens.session import machine_folder
    from ledgerlens.sources.questions import numbered_lines

    lines = [f"line {i} " + "x" * (i % 50) for i in range(2000)]
    for k in range(4):
        (tmp_path / f"part-{k}.txt").write_text("\n\n".join(lines[500 * k : 500 * k + 500]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [tuple(r) for r in numbered_lines(spark, str(tmp_path)).orderBy("pos").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(lines))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", ""):
        with pytest.raises(ValueError):
            machine_folder(master)
