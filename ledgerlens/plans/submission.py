"""Registered queries: whole evaluations that execute SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.plans import evaluate as V
from ledgerlens.plans.registry import Registry
from ledgerlens.session import stage
from ledgerlens.sources.tables import register_tables, table

registry = Registry()
add = registry.add

# One question per market segment; its statements scan orders and customer as a whole.
GOLD = (
    "SELECT o_orderpriority, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders JOIN customer "
    "ON o_custkey = c_custkey WHERE c_mktsegment = '{}' GROUP BY o_orderpriority ORDER BY o_orderpriority"
)


def segment_corpus(spark, folder):
    """Questions and predictions: as expected, reversed, failing to compile, missing, wrong filter."""
    segments = table(spark, folder, "customer").select("c_mktsegment").distinct()
    place = F.array_position(F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), F.col("c_mktsegment"))
    head, tail = GOLD.split("{}")
    sql = F.concat(F.lit(head), "c_mktsegment", F.lit(tail))
    damaged = (
        F.when(place == 1, sql)
        .when(place == 2, F.concat(sql, F.lit(" DESC")))
        .when(place == 3, F.replace(sql, F.lit("o_totalprice"), F.lit("no_such_column")))
        .when(place == 4, F.lit(None))
        .otherwise(F.replace(sql, F.lit("WHERE"), F.lit("WHERE o_totalprice > 100000 AND")))
    )
    base = segments.withColumn("place", place).withColumn("sql", sql).withColumn("pd", damaged)
    questions = base.select(
        F.col("c_mktsegment").alias("id"),
        F.when(F.col("place") <= 2, "simple").otherwise("moderate").alias("difficulty"),
        "sql",
        F.create_map().cast("map<string,string>").alias("variants"),
        F.lit(None).cast("boolean").alias("order_relevant"),
    )
    return questions, base.select(F.col("c_mktsegment").alias("id"), F.col("pd").alias("sql"))


_EXPECTED_SQL = """
WITH t AS (
  SELECT c_mktsegment AS id, o_orderpriority AS k, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total,
         COUNT(*) FILTER (o_totalprice > 100000) AS n2, SUM(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (o_totalprice > 100000) AS total2
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (
  SELECT id, row_number() OVER (ORDER BY id) AS place, COUNT(*) AS m, bool_and(n = n2 AND total = total2) AS same FROM t GROUP BY id)
SELECT id AS query_id, CASE WHEN place <= 2 THEN 'simple' ELSE 'moderate' END AS difficulty, place NOT IN (3, 4) AS success,
       CASE WHEN place = 1 THEN 1e0 WHEN place = 2 AND m = 1 THEN 1e0 WHEN place = 5 AND same THEN 1e0 ELSE 0e0 END AS exo,
       CASE WHEN place IN (1, 2) THEN 1e0 WHEN place = 5 AND same THEN 1e0 ELSE 0e0 END AS exu,
       CASE WHEN place IN (1, 2) THEN 1e0 WHEN place = 5 THEN round((SELECT AVG((1 + CAST(n = n2 AS INTEGER) + CAST(total = total2 AS INTEGER)) / 3e0) FROM t WHERE t.id = s.id), 6) ELSE 0e0 END AS bfu,
       CASE place WHEN 3 THEN 'failed' WHEN 4 THEN 'No prediction provided' END AS pred_error
FROM s"""


@add("evaluate_submission", _EXPECTED_SQL)
def evaluate_submission(spark, folder):
    register_tables(spark, folder, ("orders", "customer"))
    questions, submission = segment_corpus(spark, folder)
    outcomes = V.evaluate_submission(spark, questions, submission)
    error = F.when(F.col("pred_error").startswith("[UNRESOLVED"), "failed").otherwise(F.col("pred_error"))
    return outcomes.select(
        "query_id", "difficulty", "success", "exo", "exu", F.round("bfu", 6).alias("bfu"), error.alias("pred_error")
    )


# Questions over two databases that share the table name ``facts``, and over one that does not exist. The number decides the answer:
# 0 as expected, 1 reversed, 2 fails, 3 none, 4 totals off by one, 5 a wrong and then a right one, 6 as the second expected variant.
_ORDERS = "SELECT o_orderstatus AS k, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM facts WHERE o_orderpriority = '{}' GROUP BY o_orderstatus ORDER BY o_orderstatus"
_LINES = (
    "SELECT l_linestatus AS k, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS total FROM facts "
    "WHERE l_returnflag = '{}' AND l_linenumber = {} GROUP BY l_linestatus ORDER BY l_linestatus"
)


def filled(pattern: str, *values) -> Column:
    parts = pattern.split("{}")
    between = [x for part, value in zip(parts[1:], values) for x in (value.cast("string"), F.lit(part))]
    return F.concat(F.lit(parts[0]), *between)


def database_corpus(spark, folder):
    """(questions, submission, catalog), made from the rows of the tables."""
    orders, lines, region = (table(spark, folder, t) for t in ("orders", "lineitem", "region"))
    of_orders = orders.select("o_orderpriority").distinct().select(
        F.concat(F.lit("O:"), "o_orderpriority").alias("id"), F.lit("orders").alias("database"), F.lit("simple").alias("difficulty"),
        (F.substring("o_orderpriority", 1, 1).cast("int") % 7).alias("kind"), filled(_ORDERS, F.col("o_orderpriority")).alias("sql"),
    )
    of_lines = lines.select("l_returnflag", "l_linenumber").distinct().select(
        F.concat_ws(":", F.lit("L"), "l_returnflag", F.col("l_linenumber").cast("string")).alias("id"), F.lit("lines").alias("database"),
        F.lit("moderate").alias("difficulty"), ((F.ascii("l_returnflag") + 3 * F.col("l_linenumber")) % 7).alias("kind"),
        filled(_LINES, F.col("l_returnflag"), F.col("l_linenumber")).alias("sql"),
    )
    of_none = region.select(
        F.concat(F.lit("G:"), "r_name").alias("id"), F.lit("gone").alias("database"), F.lit("nightmare").alias("difficulty"), F.lit(0).alias("kind"), F.lit("SELECT 1").alias("sql")
    )
    base = stage(of_orders.unionByName(of_lines).unionByName(of_none), "corpus")
    sql, kind = F.col("sql"), F.col("kind")
    counted = F.concat(F.lit("SELECT COUNT(*) AS n FROM facts "), F.regexp_extract("sql", "(WHERE .*) GROUP BY", 1))
    questions = base.select(
        "id", F.lit("test").alias("benchmark"), "database", "difficulty", "sql", F.create_map(F.lit("sql.1"), counted).alias("variants"), F.lit(None).cast("boolean").alias("order_relevant")
    )
    answer = (
        F.when(kind == 1, F.concat(sql, F.lit(" DESC")))
        .when(kind == 2, F.replace(sql, F.lit("facts"), F.lit("no_such_table")))
        .when(kind == 3, F.lit(None))
        .when(kind == 4, F.replace(sql, F.lit(" AS total"), F.lit(" + 1 AS total")))
        .when(kind == 6, counted)
        .otherwise(sql)
    )
    answers = base.select("id", F.lit(1).alias("pos"), answer.alias("sql"))
    first = base.where("kind = 5").select("id", F.lit(0).alias("pos"), F.lit("SELECT 0").alias("sql"))
    rows = [("test", "orders", "facts", f"{folder}/orders.parquet"), ("test", "lines", "facts", f"{folder}/lineitem.parquet")]
    return questions, answers.unionByName(first), spark.createDataFrame(rows, "benchmark string, database string, name string, path string")


_DATABASES_SQL = """
WITH q AS (
  SELECT 'O:' || o_orderpriority AS id, 'simple' AS difficulty, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 7 AS kind, COUNT(DISTINCT o_orderstatus) AS m FROM orders GROUP BY o_orderpriority
  UNION ALL
  SELECT 'L:' || l_returnflag || ':' || l_linenumber, 'moderate', (ascii(l_returnflag) + 3 * l_linenumber) % 7, COUNT(DISTINCT l_linestatus) FROM lineitem GROUP BY l_returnflag, l_linenumber
  UNION ALL SELECT 'G:' || r_name, 'nightmare', -1, 1 FROM region)
SELECT id AS query_id, difficulty, kind NOT IN (-1, 2, 3) AS success,
       CASE WHEN kind IN (0, 5, 6) OR (kind = 1 AND m = 1) THEN 1e0 ELSE 0e0 END AS exo,
       CASE WHEN kind IN (0, 1, 5, 6) THEN 1e0 ELSE 0e0 END AS exu,
       round(CASE WHEN kind IN (0, 5, 6) THEN 1e0 WHEN kind = 1 AND m % 2 = 1 THEN 1e0 / m WHEN kind = 4 THEN 0.5e0 ELSE 0e0 END, 6) AS sfo,
       round(CASE WHEN kind IN (0, 5, 6) THEN 1e0 WHEN kind = 1 THEN 1e0 / m WHEN kind = 4 THEN 0.5e0 ELSE 0e0 END, 6) AS bfo,
       CASE WHEN kind IN (0, 1, 5, 6) THEN 1e0 WHEN kind = 4 THEN 0.5e0 ELSE 0e0 END AS bfu,
       CASE kind WHEN -1 THEN 'DB resolution failed: no database gone in test' WHEN 2 THEN 'failed' WHEN 3 THEN 'No prediction provided' END AS pred_error
FROM q"""


@add("evaluate_databases", _DATABASES_SQL)
def evaluate_databases(spark, folder):
    """One evaluation over several databases: each statement meets the tables of its own."""
    questions, submission, catalog = database_corpus(spark, folder)
    outcomes = V.evaluate_submission(spark, questions, submission, catalog=catalog)
    error = F.when(F.col("pred_error").startswith("[TABLE_OR_VIEW_NOT_FOUND"), "failed").otherwise(F.col("pred_error"))
    metrics = [F.round(m, 6).alias(m) for m in ("exo", "exu", "sfo", "bfo", "bfu")]
    return outcomes.select("query_id", "difficulty", "success", *metrics, error.alias("pred_error"))


@add(
    "run_sql_pair",
    """WITH t AS (SELECT l_shipdate, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS a, SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS b
  FROM lineitem GROUP BY l_shipdate)
SELECT COUNT(*) AS n, COUNT(*) AS m, CASE WHEN bool_and(a IS NOT DISTINCT FROM b) THEN 1e0 ELSE 0e0 END AS exo,
round(AVG((1 + CAST(a IS NOT DISTINCT FROM b AS INTEGER)) / 2e0), 6) AS sfo FROM t""",
)
def run_sql_pair(spark, folder):
    """Revenue per day, with and without returned lines: more rows than the cap."""
    register_tables(spark, folder, ("lineitem",))
    sql = "SELECT l_shipdate, SUM({}) AS total FROM lineitem GROUP BY l_shipdate ORDER BY l_shipdate"
    amount = "CAST(l_extendedprice AS DECIMAL(12,2))"
    _, _, scores = V.run_sql_pair(
        spark, sql.format(amount), sql.format(f"CASE WHEN l_returnflag <> 'R' THEN {amount} END")
    )
    return scores.select("n", "m", "exo", F.round("sfo", 6).alias("sfo"))


@add(
    "run_question",
    """SELECT l_linestatus AS k, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS expected, CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) + 1 AS DOUBLE) AS predicted,
0e0 AS exo, 0e0 AS exu, 5e-1 AS sfo, 5e-1 AS bfo, 5e-1 AS bfu FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1 GROUP BY l_linestatus""",
)
def run_question(spark, folder):
    """One question of a database corpus by its id, with the answer of the submission: both tables side by side and the scores."""
    questions, submission, catalog = database_corpus(spark, folder)
    answer = submission.where("id = 'L:N:1'").first()["sql"]
    run = V.run_question(spark, questions, "L:N:1", answer, catalog)
    both = run.expected.withColumnRenamed("total", "expected").join(run.predicted.withColumnRenamed("total", "predicted"), "k", "full")
    scores = run.outcome.select("exo", "exu", "sfo", "bfo", "bfu").first()  # one row
    metrics = [F.round(F.lit(scores[m]), 6).alias(m) for m in scores.asDict()]
    return both.select("k", *[F.col(c).cast("double").alias(c) for c in ("expected", "predicted")], *metrics)
