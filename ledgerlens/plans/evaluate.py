"""Run the statements of a submission and of the expected answers, then score all results at once.

The driver only submits SQL text, several statements at a time; each result goes straight from the
executors to the shared folder, one folder per statement. Scoring is one job over all of them.
Statements that fail are told in the run list, with the error of Spark; the list is written in batches.

Each database has a session of its own with its tables as temporary views, so that databases may share
table names. A statement runs in the session of its question's database.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import questions as Q
from ledgerlens.operators import report as P
from ledgerlens.operators import rows as R
from ledgerlens.session import SETTINGS, shared_dir, stage

RUNS = "query_id string, side string, variant int, error string"
BATCH = 1000  # entries of the run list that are held at a time
SESSIONS = 64  # databases that are kept open


@dataclass(frozen=True)
class Statement:
    query_id: str
    side: str
    variant: int
    sql: str
    benchmark: str | None = None
    database: str | None = None


def database_tables(spark: SparkSession, root: str) -> DataFrame:
    """The catalog of a folder ``root/<benchmark>/<database>/<table>.parquet``: (benchmark, database, name, path). Only paths are listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    place = "^(.*?/([^/]+)/([^/]+)/([^/]+)\\.parquet)(/.*)?$"
    part = lambda k: F.regexp_extract("path", place, k)
    return files.select(part(2).alias("benchmark"), part(3).alias("database"), part(4).alias("name"), part(1).alias("path")).distinct()


class Databases:
    """Sessions by database. Without a catalog every statement runs in the given session."""

    def __init__(self, spark: SparkSession, catalog: DataFrame | None) -> None:
        self.spark, self.catalog = spark, catalog
        self.open: OrderedDict[tuple, SparkSession] = OrderedDict()
        self.lock = Lock()

    def session(self, benchmark: str | None, database: str | None) -> SparkSession:
        if self.catalog is None:
            return self.spark
        key = (benchmark, database)
        with self.lock:
            if key not in self.open:
                self.open[key] = self._opened(*key)
                if len(self.open) > SESSIONS:
                    self.open.popitem(last=False)
            self.open.move_to_end(key)
            return self.open[key]

    def _opened(self, benchmark: str | None, database: str | None) -> SparkSession:
        own = self.spark.newSession()
        for setting in (*SETTINGS, "spark.sql.shuffle.partitions"):
            own.conf.set(setting, self.spark.conf.get(setting))
        here = F.col("benchmark").eqNullSafe(F.lit(benchmark)) & F.col("database").eqNullSafe(F.lit(database))
        for table in self.catalog.where(here).collect():  # the tables of one database
            own.read.parquet(table["path"]).createOrReplaceTempView(table["name"])
        return own


def result_rows(frame: DataFrame, statement: Statement, ndigits: int = 3) -> DataFrame:
    """A statement's result in the long form. Columns are taken by place, equal names stay apart;
    row numbers follow the order of the result and still have gaps."""
    names = [f"c{i}" for i in range(len(frame.columns))]
    numbered = (
        frame.toDF(*names)
        .withColumn("row_idx", F.monotonically_increasing_id())
        .withColumn("query_id", F.lit(statement.query_id))
        .withColumn("side", F.lit(statement.side))
        .withColumn("variant", F.lit(statement.variant))
    )
    return R.norm_cells(numbered, names, ndigits)


def _run(databases: Databases, statement: Statement, path: str, ndigits: int) -> tuple:
    key = (statement.query_id, statement.side, statement.variant)
    try:
        own = databases.session(statement.benchmark, statement.database)
        result_rows(own.sql(statement.sql), statement, ndigits).write.parquet(path)
        return (*key, None)
    except Exception as error:  # any failure of a statement is its outcome, not ours
        first = str(error).strip().splitlines()
        return (*key, first[0] if first else type(error).__name__)


def run_statements(
    spark: SparkSession, statements: Iterator[Statement], ndigits: int = 3, parallel: int = 8, catalog: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Execute statements and return (results, runs). At most ``parallel`` texts and ``BATCH`` outcomes are held at a time.

    ``catalog(benchmark, database, name, path)`` names the tables of the databases.
    """
    folder, told = shared_dir(spark, "results"), shared_dir(spark, "runs")
    databases = Databases(spark, catalog)
    runs: list[tuple] = []
    written = succeeded = 0

    def tell(done: set[Future], least: int) -> None:
        nonlocal written, succeeded
        runs.extend(f.result() for f in done)
        if len(runs) >= least:
            spark.createDataFrame(runs, RUNS).write.parquet(f"{told}/{written:08d}")
            written += 1
            succeeded += sum(error is None for *_, error in runs)
            runs.clear()

    waiting: set[Future] = set()
    with ThreadPoolExecutor(parallel) as pool:
        for number, statement in enumerate(statements):
            if len(waiting) >= parallel:
                done, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                tell(done, BATCH)
            waiting.add(pool.submit(_run, databases, statement, f"{folder}/{number:08d}", ndigits))
        tell(wait(waiting).done, 0)
    if succeeded:
        raw = spark.read.schema(R.RESULTS).option("recursiveFileLookup", "true").parquet(folder)
    else:
        raw = spark.createDataFrame([], R.RESULTS)
    keys = ["query_id", "side", "variant"]
    results = R.dense_index(raw, keys, F.col("row_idx")).select(*keys, "row_idx", "cells")
    return results, spark.read.schema(RUNS).option("recursiveFileLookup", "true").parquet(told)


def _statements(answered: DataFrame) -> Iterator[Statement]:
    """Prediction and expected variants of every question with a prediction, database by database."""
    runnable = answered.where("database_error IS NULL AND pd_sql <> ''")
    pred = runnable.select("id", F.lit("p").alias("side"), F.lit(0).alias("variant"), F.col("pd_sql").alias("sql"))
    gold = Q.gold_variants(runnable).select("id", F.lit("g").alias("side"), "variant", "sql")
    nothing = F.lit(None).cast("string")
    home = [F.col(c) if c in runnable.columns else nothing.alias(c) for c in ("benchmark", "database")]
    listed = pred.unionByName(gold).join(runnable.select("id", *home), "id")
    for row in listed.orderBy("benchmark", "database", "id", "side", "variant").toLocalIterator():
        yield Statement(row["id"], row["side"], row["variant"], row["sql"], row["benchmark"], row["database"])


def evaluate_submission(
    spark: SparkSession,
    questions: DataFrame,
    submission: DataFrame,
    query_ids: list[str] | None = None,
    difficulty: list[str] | None = None,
    bf_beta: float = 2.0,
    sf_beta: float = 1.0,
    ndigits: int = 3,
    dedup: bool = False,
    unordered: bool = False,
    best: str = "exo",
    parallel: int = 8,
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Outcome per question: success, ordered, the five metrics, pred_error and gt_error.

    Statements name the tables that ``catalog(benchmark, database, name, path)`` lists for the question's database; a question
    whose database is not listed fails. Without a catalog they name temporary views or tables of the session.
    Question ids are unique (``latest_by_id``). ``report_rollup`` turns the outcomes into the report.
    """
    chosen = questions if query_ids is None else Q.filter_ids(questions, query_ids)
    chosen = chosen if difficulty is None else Q.filter_difficulty(chosen, *difficulty)
    answered = Q.is_ordered(P.submission_join(chosen, submission), unordered)
    if catalog is not None:
        known = catalog.groupBy("benchmark", "database").agg(F.min("path").alias("path"))
        answered = Q.resolve_database(answered.drop("path", "database_error"), known)
    if "database_error" not in answered.columns:
        answered = answered.withColumn("database_error", F.lit(None).cast("string"))
    answered = stage(answered, "answered")
    results, runs = run_statements(spark, _statements(answered), ndigits, parallel, catalog)
    results = stage(results, "rows")
    scores = P.score_results(
        results, R.pair_list(results, runs.where("error IS NULL")), bf_beta=bf_beta, sf_beta=sf_beta, dedup=dedup
    )
    picked = P.best_variant(scores, best)
    errors = runs.groupBy("query_id").agg(
        F.max(F.when(F.col("side") == "p", F.col("error"))).alias("run_error"),
        F.max_by(F.concat(F.lit("GT execution failed: "), F.col("error")), F.when((F.col("side") == "g") & F.col("error").isNotNull(), F.col("variant"))).alias("gt_error"),
        F.coalesce(F.bool_or((F.col("side") == "g") & F.col("error").isNull()), F.lit(False)).alias("gold_valid"),
    )
    entries = (
        answered.select(F.col("id").alias("query_id"), "difficulty", "ordered", "pd_sql", "database_error")
        .withColumn("known", F.lit(True))
        .join(errors, "query_id", "left")
        .withColumn("gold_valid", F.coalesce("gold_valid", F.lit(False)))
        .join(picked, "query_id", "left")
    )
    outcomes = P.classify_outcome(entries)
    failed_pred = F.col("run_error").isNotNull()
    metrics = [F.when(F.col("success"), F.col(m)).otherwise(0.0).alias(m) for m in P.METRICS]
    return outcomes.select(
        "query_id",
        "difficulty",
        "ordered",
        "success",
        "pd_sql",
        F.col("variant"),
        *metrics,
        "pred_error",
        F.when(~failed_pred, F.col("gt_error")).alias("gt_error"),
    )


def run_sql_pair(spark: SparkSession, gold_sql: str, pred_sql: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run one expected and one predicted statement: (expected table, predicted table, scores)."""
    gold, pred = spark.sql(gold_sql), spark.sql(pred_sql)
    both = result_rows(gold, Statement("pair", "g", 0, gold_sql)).unionByName(
        result_rows(pred, Statement("pair", "p", 0, pred_sql))
    )
    keys = ["query_id", "side", "variant"]
    results = stage(R.dense_index(stage(both, "pair"), keys, F.col("row_idx")).select(*keys, "row_idx", "cells"), "rows")
    runs = spark.createDataFrame([("pair", "g", 0), ("pair", "p", 0)], "query_id string, side string, variant int")
    return gold, pred, P.score_results(results, R.pair_list(results, runs), **options)


@dataclass(frozen=True)
class QuestionRun:
    """One question with its tables; ``predicted`` and ``outcome`` are there only where a statement was given.

    A table that cannot be made is None, with Spark's words in ``errors``.
    """

    question: DataFrame
    expected: DataFrame | None
    predicted: DataFrame | None
    outcome: DataFrame | None
    errors: dict[str, str]


def run_statement(
    spark: SparkSession, sql: str, catalog: DataFrame | None = None, benchmark: str | None = None, database: str | None = None
) -> DataFrame:
    """The table of a bare statement, over the tables of one database of the catalog."""
    return Databases(spark, catalog).session(benchmark, database).sql(sql.strip())


def run_question(
    spark: SparkSession, questions: DataFrame, query_id: str, sql: str | None = None, catalog: DataFrame | None = None, **options
) -> QuestionRun:
    """Look a question up by id and run its first expected statement and, if given, a predicted one in the question's database.

    The outcome is that of ``evaluate_submission`` for this one answer, all variants included; ``options`` are passed on to it.
    An id that is not there is a KeyError; a statement that fails leaves its table out and is told in ``errors``.
    """
    own = questions.where(F.col("id") == query_id)
    question = stage(Q.latest_by_id(own) if "pos" in questions.columns else own, "question")
    found = question.first()
    if found is None:
        raise KeyError(f"no question has the id {query_id}")
    entry = found.asDict()
    home = entry.get("benchmark"), entry.get("database")
    tables, errors = {}, {}
    gold = Q.gold_variants(question).orderBy("variant").first()["sql"]
    for side, text in (("expected", gold), ("predicted", sql)):
        if text:
            try:
                tables[side] = run_statement(spark, text, catalog, *home)
            except Exception as error:  # a statement that cannot be read is a finding about the statement
                errors[side] = (str(error).strip().splitlines() or [type(error).__name__])[0]
    outcome = None
    if sql is not None:
        answer = spark.createDataFrame([(query_id, sql)], "id string, sql string")
        outcome = evaluate_submission(spark, question, answer, catalog=catalog, **options)
    return QuestionRun(question, tables.get("expected"), tables.get("predicted"), outcome, errors)
