"""Registered queries: question sets, JSON sources and vocabulary.

The question set is derived from ``documents`` and ``labels``: one question per document, with the
whole text as the question and, for some, inside the quoted part of its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import sqltext as S
from ledgerlens.operators import questions as Q
from ledgerlens.operators import vocabulary as V
from ledgerlens.plans.registry import Registry
from ledgerlens.session import shared_dir
from ledgerlens.sources import questions as J
from ledgerlens.sources.tables import TABLES, table

registry = Registry()
add = registry.add

# Statement templates by document; {name} stands for a column as text.
TEMPLATES = (
    "SELECT n_chars FROM documents WHERE doc_id = {doc_id}",
    "SELECT lang, COUNT(*) AS n FROM documents WHERE source = '{source}' GROUP BY lang ORDER BY n DESC LIMIT 5",
    "WITH t AS (SELECT DISTINCT source FROM documents) SELECT source FROM t -- order by source",
    "SELECT doc_id FROM documents WHERE text = '{quoted}' /* ORDER BY doc_id */",
    "SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'x' END AS c, CAST(l.quality AS DOUBLE) FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL HAVING COUNT(*) > {n_chars}",
    "SELECT source, ROW_NUMBER() OVER (PARTITION BY lang\nORDER   BY doc_id) FROM (SELECT * FROM documents) WHERE COALESCE(n_chars, 0) > {n_chars} UNION SELECT source, 1 FROM documents",
)


def _pieces(template: str) -> list[tuple[bool, str]]:
    out = []
    for chunk in template.split("{"):
        name, _, rest = chunk.partition("}")
        out += [(True, name), (False, rest)] if _ else [(False, chunk)]
    return [(is_column, value) for is_column, value in out if value]


def _template_spark():
    made = F.lit(None).cast("string")
    for i, template in reversed(list(enumerate(TEMPLATES))):
        parts = [F.col(v).cast("string") if is_column else F.lit(v) for is_column, v in _pieces(template)]
        made = F.when(F.col("doc_id") % 6 == i, F.concat(*parts)).otherwise(made)
    return made


def _template_sql() -> str:
    whens = []
    for i, template in enumerate(TEMPLATES):
        parts = [f"CAST({v} AS VARCHAR)" if is_column else "'" + v.replace("'", "''") + "'" for is_column, v in _pieces(template)]
        whens.append(f"WHEN {i} THEN " + " || ".join(parts))
    return "CASE doc_id % 6 " + " ".join(whens) + " END"


def questions(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left")
    docs = docs.withColumn("quoted", F.replace(F.col("text"), F.lit("'"), F.lit("''")))
    docs = docs.withColumn("sql", _template_spark())
    level = (
        F.when(F.col("n_chars") % 11 == 0, F.lit(None))
        .when(F.col("n_chars") < 500, "simple")
        .when(F.col("n_chars") < 1500, "Moderate")
        .when(F.col("n_chars") < 4000, "challenging")
        .otherwise("nightmare")
    )
    other = F.create_map(
        F.lit("sql.2"), F.concat("sql", F.lit(" ")), F.lit("sql.10"), F.concat(F.lit("SELECT "), F.col("doc_id").cast("string"))
    )
    none = F.create_map().cast("map<string,string>")
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.format_string("Q%05d", "doc_id").alias("id"),
        F.when(F.col("doc_id") % 4 != 0, "docs").alias("benchmark"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("database"),
        F.col("text").alias("question"),
        F.col("lang").alias("dialect"),
        "sql",
        F.when(F.col("doc_id") % 3 == 0, other).otherwise(none).alias("variants"),
        level.alias("difficulty"),
        F.array(F.concat(F.lit("lang-"), "lang"), F.concat(F.lit("type-"), F.col("n_chars") % 5)).alias("tags"),
        F.when(F.col("toxic") == 1, True).when(F.col("quality") == 0, False).alias("order_relevant"),
        (F.col("quality") == 1).alias("verified"),
        F.when(F.col("source") != "src0", F.col("source")).alias("occupation"),
        F.lit("A").alias("caliber"),
        F.when(F.col("lang") == "en", "USD").otherwise("EUR").alias("currency"),
        F.create_map(F.lit("region_name_en"), F.array(F.upper("lang"), F.col("source"))).alias("region"),
        F.create_map().cast("map<string,array<string>>").alias("department"),
        F.array().cast("array<string>").alias("preferences"),
    )


Q_SQL = f"""
WITH docs AS (SELECT d.*, quality, toxic, replace(text, '''', '''''') AS quoted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
q AS (
  SELECT doc_id AS pos, format('Q{{:05d}}', doc_id) AS id, CASE WHEN doc_id % 4 <> 0 THEN 'docs' END AS benchmark,
         CASE WHEN doc_id % 5 <> 0 THEN source END AS database, text AS question, lang AS dialect, {_template_sql()} AS sql, doc_id % 3 = 0 AS more,
         CASE WHEN n_chars % 11 = 0 THEN NULL WHEN n_chars < 500 THEN 'simple' WHEN n_chars < 1500 THEN 'Moderate' WHEN n_chars < 4000 THEN 'challenging' ELSE 'nightmare' END AS difficulty,
         ['lang-' || lang, 'type-' || (n_chars % 5)] AS tags, CASE WHEN toxic = 1 THEN true WHEN quality = 0 THEN false END AS order_relevant,
         quality = 1 AS verified, CASE WHEN source <> 'src0' THEN source END AS occupation, CASE WHEN lang = 'en' THEN 'USD' ELSE 'EUR' END AS currency,
         upper(lang) || ' ' || source AS region_words, doc_id
  FROM docs)
"""
_STRIPPED = f"regexp_replace(sql, '{S.COMMENTS.replace(chr(39), chr(39) * 2)}', '\\1', 'g')"
_ORDER = "regexp_matches({}, '(?i)\\border\\s+by\\b')"


# -- filters and views -----------------------------------------------------------------------


@add("filter_ids", Q_SQL + "SELECT id, difficulty FROM q WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def filter_ids(spark, folder):
    wanted = table(spark, folder, "labels").where("quality = 0").select(F.format_string("Q%05d", "doc_id").alias("id"))
    return Q.filter_ids(questions(spark, folder), wanted).select("id", "difficulty")


@add("filter_difficulty", Q_SQL + "SELECT id, difficulty FROM q WHERE lower(coalesce(difficulty, '')) IN ('simple', 'moderate', 'unknown')")
def filter_difficulty(spark, folder):
    return Q.filter_difficulty(questions(spark, folder), "SIMPLE", "moderate", "unknown").select("id", "difficulty")


@add("filter_tags", Q_SQL + "SELECT id, array_to_string(tags, '|') AS tags FROM q WHERE list_has_any(tags, ['lang-fr', 'type-3'])")
def filter_tags(spark, folder):
    return Q.filter_tags(questions(spark, folder), "lang-fr", "type-3").select("id", F.array_join("tags", "|").alias("tags"))


@add("filter_dialect", Q_SQL + "SELECT id, dialect FROM q WHERE lower(dialect) = 'de'")
def filter_dialect(spark, folder):
    return Q.filter_dialect(questions(spark, folder), "DE").select("id", "dialect")


@add("filter_verified", Q_SQL + "SELECT id, verified FROM q WHERE coalesce(verified, false)")
def filter_verified(spark, folder):
    return Q.filter_verified(questions(spark, folder)).select("id", "verified")


@add(
    "lookup_id",
    Q_SQL + "SELECT dialect || '-' || occupation AS id, MAX(pos) AS pos, arg_max(difficulty, pos) AS difficulty FROM q WHERE occupation IN ('src3', 'src4', 'src5') AND difficulty IS NOT NULL GROUP BY 1",
)
def lookup_id(spark, folder):
    """Ids made to repeat: the last question of each counts."""
    repeated = questions(spark, folder).where("difficulty IS NOT NULL").withColumn("id", F.concat_ws("-", "dialect", "occupation"))
    wanted = [f"{lang}-src{k}" for lang in ("en", "fr", "de", "es") for k in (3, 4, 5)]
    return Q.lookup_id(repeated, *wanted).select("id", "pos", "difficulty")


@add("slice_rows", Q_SQL + "SELECT pos, id, sql FROM q WHERE pos >= 100 AND pos < 180")
def slice_rows(spark, folder):
    return Q.slice_rows(questions(spark, folder), 100, 180).select("pos", "id", "sql")


@add("stable_sample", Q_SQL + ", s AS (SELECT pos, id FROM q ORDER BY md5('42:' || id), id LIMIT 50) SELECT pos, id FROM s ORDER BY pos")
def stable_sample(spark, folder):
    return Q.stable_sample(questions(spark, folder), 50, 42).select("pos", "id")


@add(
    "keyword_search",
    Q_SQL + """, b AS (SELECT id, lower(concat_ws(' ', id, question, array_to_string(tags, ' '), currency, region_words)) AS blob FROM q)
SELECT id FROM b WHERE contains(blob, 'eur') AND contains(blob, 'src1') AND contains(blob, 'la')""",
)
def keyword_search(spark, folder):
    return Q.keyword_search(questions(spark, folder), "EUR", "src1", "la").select("id")


# -- order, comments, variants ---------------------------------------------------------------


@add("strip_sql_comments", Q_SQL + f"SELECT id, {_STRIPPED} AS sql FROM q")
def strip_sql_comments(spark, folder):
    return questions(spark, folder).select("id", S.strip_comments(F.col("sql")).alias("sql"))


@add("has_order_by", Q_SQL + f"SELECT id, {_ORDER.format(_STRIPPED)} AS ordered FROM q")
def has_order_by(spark, folder):
    return questions(spark, folder).select("id", S.has_order_by(F.col("sql")).alias("ordered"))


@add("is_ordered", Q_SQL + f"SELECT id, coalesce(order_relevant, {_ORDER.format(_STRIPPED)}) AS ordered FROM q")
def is_ordered(spark, folder):
    return Q.is_ordered(questions(spark, folder)).select("id", "ordered")


@add(
    "order_relevance_counts",
    Q_SQL + """SELECT COUNT(*) FILTER (order_relevant) AS explicit,
COUNT(*) FILTER (coalesce(order_relevant, false) OR (order_relevant IS NULL AND contains(upper(sql), 'ORDER BY'))) AS deduced FROM q""",
)
def order_relevance_counts(spark, folder):
    return Q.order_relevance_counts(questions(spark, folder))


@add(
    "gold_variants",
    Q_SQL + """SELECT id, 0 AS variant, sql FROM q UNION ALL SELECT id, 1, 'SELECT ' || doc_id FROM q WHERE more UNION ALL SELECT id, 2, sql || ' ' FROM q WHERE more""",
)
def gold_variants(spark, folder):
    return Q.gold_variants(questions(spark, folder))


# -- profile ---------------------------------------------------------------------------------


@add(
    "question_stats",
    Q_SQL + """, f AS (SELECT coalesce(difficulty, 'unknown') AS difficulty, dialect, coalesce(verified, false) AS verified, length(sql) AS len FROM q)
SELECT CASE WHEN grouping(difficulty) = 0 THEN 'difficulty' WHEN grouping(dialect) = 0 THEN 'dialect' ELSE 'total' END AS kind, coalesce(difficulty, dialect, 'all') AS name,
COUNT(*) AS n, COUNT(*) FILTER (verified) AS verified, round(SUM(len) / CAST(COUNT(*) AS DOUBLE), 4) AS avg_length FROM f GROUP BY GROUPING SETS ((difficulty), (dialect), ())""",
)
def question_stats(spark, folder):
    stats = Q.question_stats(questions(spark, folder))
    return stats.withColumn("avg_length", F.round("avg_length", 4))


@add(
    "tag_counts",
    Q_SQL + ", e AS (SELECT pos, unnest(tags) AS tag, unnest([1, 2]) AS place FROM q), c AS (SELECT tag, COUNT(*) AS n, MIN(pos * 2 + place) AS first_at FROM e GROUP BY tag) SELECT tag, n FROM c ORDER BY n DESC, first_at LIMIT 10",
)
def tag_counts(spark, folder):
    return Q.tag_counts(questions(spark, folder))


@add(
    "sql_length_profile",
    Q_SQL + """SELECT coalesce(difficulty, 'unknown') AS difficulty, COUNT(*) AS n, round(AVG(length(sql)), 4) AS avg, MIN(length(sql)) AS low, MAX(length(sql)) AS high,
round(COUNT(*) / CAST((SELECT COUNT(*) FROM q) AS DOUBLE), 6) AS share FROM q GROUP BY 1""",
)
def sql_length_profile(spark, folder):
    profile = Q.sql_length_profile(questions(spark, folder))
    return profile.select("difficulty", "n", F.round("avg", 4).alias("avg"), "low", "high", F.round("share", 6).alias("share"))


def _census_sql() -> str:
    cases = " UNION ALL ".join(f"SELECT '{name}' AS feature, '{pattern}' AS pattern" for name, pattern in S.FEATURES.items())
    return (
        Q_SQL + f", s AS (SELECT {_STRIPPED} AS sql FROM q), f AS ({cases}) SELECT feature, COUNT(*) AS n, "
        "round(COUNT(*) / CAST((SELECT COUNT(*) FROM q) AS DOUBLE), 6) AS share FROM s JOIN f ON regexp_matches(sql, pattern) GROUP BY feature"
    )


@add("sql_feature_census", _census_sql())
def sql_feature_census(spark, folder):
    return Q.sql_feature_census(questions(spark, folder)).withColumn("share", F.round("share", 6))


@add(
    "table_coverage",
    Q_SQL + f""", n AS (SELECT DISTINCT id, unnest(list_transform(regexp_extract_all({_STRIPPED}, '{S.TABLE_NAME}', 1), lambda x: lower(x))) AS name FROM q)
SELECT name, COUNT(*) AS n FROM n WHERE name IN ('documents', 'labels') GROUP BY name""",
)
def table_coverage(spark, folder):
    return Q.table_coverage(questions(spark, folder), list(TABLES))


@add(
    "profile_distribution",
    Q_SQL + "SELECT coalesce(occupation, 'Unspecified') AS occupation, COUNT(*) AS n, round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM q), 4) AS percent FROM q GROUP BY 1",
)
def profile_distribution(spark, folder):
    return Q.profile_distribution(questions(spark, folder)).withColumn("percent", F.round("percent", 4))


# -- sources and sinks -----------------------------------------------------------------------

_BACK_SQL = Q_SQL + """SELECT id, dialect, difficulty, order_relevant, verified, occupation, currency, md5(sql) AS sql, md5(question) AS question,
array_to_string(tags, '|') AS tags, CASE WHEN more THEN 2 ELSE 0 END AS variants, region_words FROM q"""


def _back(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "dialect", "difficulty", "order_relevant", "verified", "occupation", "currency", F.md5("sql").alias("sql"),
        F.md5("question").alias("question"), F.array_join("tags", "|").alias("tags"), F.size("variants").alias("variants"),
        F.array_join(F.flatten(F.map_values("region")), " ").alias("region_words"),
    )


@add("read_questions", _BACK_SQL)
def read_questions(spark, folder):
    path = shared_dir(spark, "questions")
    J.write_questions(questions(spark, folder), path)
    return _back(J.read_questions(spark, path))


@add("write_questions", Q_SQL + "SELECT database, COUNT(*) AS n, SUM(length(sql)) AS chars FROM q GROUP BY database")
def write_questions(spark, folder):
    path = shared_dir(spark, "questions")
    J.write_questions(questions(spark, folder), path)
    return J.read_questions(spark, path).groupBy("database").agg(F.count("*").alias("n"), F.sum(F.length("sql")).alias("chars"))


@add("partition_questions", Q_SQL + "SELECT id, dialect FROM q WHERE database = 'src3'")
def partition_questions(spark, folder):
    path = shared_dir(spark, "questions")
    J.partition_questions(questions(spark, folder), path)
    return J.read_questions(spark, f"{path}/database=src3").select("id", "dialect")


@add("partitioned_corpus", Q_SQL + "SELECT id, dialect, database, md5(question) AS question FROM q")
def partitioned_corpus(spark, folder):
    """All folders of a corpus that was written by database."""
    path = shared_dir(spark, "questions")
    J.partition_questions(questions(spark, folder), path)
    return J.read_questions(spark, path).select("id", "dialect", "database", F.md5("question").alias("question"))


@add(
    "open_questions",
    Q_SQL + """SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, id, 202400 + doc_id % 12 AS query_time, CASE WHEN doc_id % 2 = 0 THEN '{"tables":["' || dialect || '"]}' END AS schema,
CAST(doc_id AS VARCHAR) AS score, '{"by":["' || dialect || '",' || doc_id || '],"ok":true}' AS review, CASE WHEN doc_id % 3 = 0 THEN '"a \\"b\\""' END AS note FROM q""",
)
def open_questions(spark, folder):
    """Keys without a column of their own, on every level, written and read again."""
    path = shared_dir(spark, "questions")
    corpus, n = questions(spark, folder), F.col("pos")
    review = F.concat(F.lit('{"by":["'), "dialect", F.lit('",'), n.cast("string"), F.lit('],"ok":true}'))
    extra = F.map_from_arrays(F.array(F.lit("/score"), F.lit("/metadata/review"), F.lit("/context/user_profile/note")), F.array(n.cast("string"), review, F.lit('"a \\"b\\""')))
    open_corpus = corpus.select(
        "*",
        (202400 + n % 12).alias("query_time"),
        F.when(n % 2 == 0, F.concat(F.lit('{"tables":["'), "dialect", F.lit('"]}'))).alias("schema"),
        F.map_filter(extra, lambda k, v: (k != "/context/user_profile/note") | (n % 3 == 0)).alias("extra"),
    )
    J.write_questions(open_corpus, path)
    back = J.read_questions(spark, path)
    named = {"score": "/score", "review": "/metadata/review", "note": "/context/user_profile/note"}
    return back.select("pos", "id", "query_time", "schema", *[F.col("extra")[key].alias(name) for name, key in named.items()])


@add("read_submission", "SELECT format('Q{:05d}', doc_id) AS id, CASE WHEN toxic = 1 THEN '' ELSE 'SELECT ''' || quality || '''' END AS sql, NULL AS error FROM labels")
def read_submission(spark, folder):
    path = shared_dir(spark, "submission")
    statement = F.concat(F.lit("SELECT '"), F.col("quality").cast("string"), F.lit("'"))
    answers = table(spark, folder, "labels").select(
        F.format_string("Q%05d", "doc_id").alias("id"), F.when(F.col("toxic") != 1, statement).alias("sql")
    )
    J.write_submission(answers, path)
    return J.read_submission(spark, path, strict=False)


@add("submission_template", Q_SQL + "SELECT id, 'SELECT 1+1;' AS sql FROM q")
def submission_template(spark, folder):
    return Q.submission_template(questions(spark, folder), "SELECT 1+1;")


@add("write_report", Q_SQL + "SELECT coalesce(difficulty, 'unknown') AS level, COUNT(*) AS n, COUNT(*) FILTER (coalesce(verified, false)) AS c FROM q GROUP BY 1")
def write_report(spark, folder):
    path = shared_dir(spark, "report")
    scores = questions(spark, folder).select("id", F.coalesce("difficulty", F.lit("unknown")).alias("level"), F.coalesce("verified", F.lit(False)).alias("success"))
    report = scores.groupBy("level").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    J.write_report(scores, report, path)
    return spark.read.schema("level string, n bigint, c bigint").json(f"{path}/report")


@add(
    "report_with_results",
    Q_SQL + """, r AS (SELECT id, coalesce(difficulty, 'unknown') AS level, coalesce(verified, false) AS success FROM q)
SELECT id, level, success, n, c FROM r JOIN (SELECT level, COUNT(*) AS n, COUNT(*) FILTER (success) AS c FROM r GROUP BY level) USING (level)""",
)
def report_with_results(spark, folder):
    """Both parts of a written report: every question's result beside the line of its level."""
    path = shared_dir(spark, "report")
    scores = questions(spark, folder).select("id", F.coalesce("difficulty", F.lit("unknown")).alias("level"), F.coalesce("verified", F.lit(False)).alias("success"))
    J.write_report(scores, scores.groupBy("level").agg(F.count("*").alias("n"), F.count_if("success").alias("c")), path)
    results = spark.read.schema("id string, level string, success boolean").json(f"{path}/results")
    return results.join(spark.read.schema("level string, n bigint, c bigint").json(f"{path}/report"), "level").select("id", "level", "success", "n", "c")


# The columns of the tables.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


@add(
    "scan_columns",
    " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS column_name, COUNT(*) AS n, COUNT({c}) AS filled, SUM(CAST(length(CAST({c} AS VARCHAR)) > 0 AS BIGINT)) AS written FROM {t}" for t, cs in COLUMNS.items() for c in cs),
)
def scan_columns(spark, folder):
    """Every column of the tables is read: rows, values that are there, and values that are not empty as text. One pass per table."""
    out = None
    for name, columns in COLUMNS.items():
        facts = [
            F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count(c).alias("filled"), F.sum((F.length(F.col(c).cast("string")) > 0).cast("bigint")).alias("written"))
            for c in columns
        ]
        one = table(spark, folder, name).agg(F.array(*facts).alias("f")).select(F.lit(name).alias("name"), F.explode("f").alias("f")).select("name", "f.*")
        out = one if out is None else out.unionByName(one)
    return out


@add("scan_tables", " UNION ALL ".join(f"SELECT '{name}' AS name, COUNT(*) AS n FROM {name}" for name in TABLES))
def scan_tables(spark, folder):
    out = None
    for name in TABLES:
        one = table(spark, folder, name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


_CATALOG_SQL = ", c AS (SELECT DISTINCT 'docs' AS benchmark, source AS database, '/data/' || source AS path FROM documents WHERE source <> 'src7')"


@add(
    "resolve_database",
    Q_SQL + _CATALOG_SQL + """ SELECT q.id, path, CASE WHEN path IS NULL THEN 'no database ' || coalesce(q.database, '') || ' in ' || coalesce(q.benchmark, '') END AS database_error
FROM q LEFT JOIN c ON q.benchmark = c.benchmark AND q.database = c.database""",
)
def resolve_database(spark, folder):
    catalog = (
        table(spark, folder, "documents")
        .where("source <> 'src7'")
        .select(F.lit("docs").alias("benchmark"), F.col("source").alias("database"), F.concat(F.lit("/data/"), "source").alias("path"))
        .distinct()
    )
    return Q.resolve_database(questions(spark, folder), catalog).select("id", "path", "database_error")


@add(
    "unify_bird",
    """SELECT format('Q{:05d}', CASE WHEN doc_id % 7 = 0 THEN doc_id + 5 ELSE doc_id + 1000 END) AS id, source AS database, md5(text) AS question, 'SELECT ' || n_chars AS sql,
CASE WHEN doc_id % 3 = 0 THEN 'unknown' ELSE lower(lang) END AS difficulty, CASE WHEN doc_id % 2 = 0 THEN 'about ' || lang ELSE '' END AS preferences, 'sqlite' AS dialect FROM documents""",
)
def unify_bird(spark, folder):
    number = F.when(F.col("doc_id") % 7 == 0, "none").otherwise((F.col("doc_id") + 1000).cast("string"))
    raw = table(spark, folder, "documents").select(
        (F.col("doc_id") + 5).alias("pos"),
        number.alias("question_id"),
        F.col("source").alias("db_id"),
        F.col("text").alias("question"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" about "), "lang", F.lit(" "))).alias("evidence"),
        F.concat(F.lit("SELECT "), F.col("n_chars").cast("string")).alias("SQL"),
        F.when(F.col("doc_id") % 3 != 0, F.upper("lang")).alias("difficulty"),
    )
    return Q.unify_bird(raw).select(
        "id", "database", F.md5("question").alias("question"), "sql", "difficulty", F.array_join("preferences", "|").alias("preferences"), "dialect"
    )


@add(
    "apply_corrections",
    """SELECT d.doc_id AS question_id, CASE WHEN toxic = 1 THEN NULL ELSE 'fixed ' || quality END AS question, 'SELECT ' || n_chars AS SQL,
lang AS evidence, CASE WHEN quality = 1 THEN 'easy' ELSE source END AS difficulty FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def apply_corrections(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").alias("question_id"),
        F.lit("raw").alias("question"),
        F.concat(F.lit("SELECT "), F.col("n_chars").cast("string")).alias("SQL"),
        F.col("lang").alias("evidence"),
        F.col("source").alias("difficulty"),
    )
    fixed = F.when(F.col("toxic") != 1, F.concat(F.lit("fixed "), F.col("quality").cast("string")))
    fields = F.when(F.col("quality") == 1, F.create_map(F.lit("question"), fixed, F.lit("difficulty"), F.lit("easy"))).otherwise(
        F.create_map(F.lit("question"), fixed)
    )
    corrections = table(spark, folder, "labels").select(F.col("doc_id").alias("question_id"), fields.alias("fields"))
    return Q.apply_corrections(raw, corrections)


@add(
    "unify_kaggle",
    """WITH r AS (SELECT doc_id, source, doc_id % 4 = 0 AS shot, CAST(source[4:] AS INTEGER) AS place FROM documents WHERE source <> 'src19')
SELECT doc_id AS pos, source AS database, CASE WHEN shot THEN 'fewshot' ELSE 'test' END AS split,
CASE WHEN shot THEN format('F{:05d}', row_number() OVER (PARTITION BY shot, source ORDER BY doc_id)) ELSE format('Q{:05d}', row_number() OVER (PARTITION BY shot ORDER BY place, doc_id)) END AS id FROM r""",
)
def unify_kaggle(spark, folder):
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("source").alias("db_id"),
        F.when(F.col("doc_id") % 4 == 0, "fewshot").otherwise("test").alias("split"),
        F.col("text").alias("question"),
        F.concat(F.lit("SELECT "), F.col("n_chars").cast("string")).alias("query"),
    )
    return Q.unify_kaggle(raw, [f"src{k}" for k in range(19)]).select("pos", "database", "split", "id")


@add("inject_fields", Q_SQL + "SELECT id, coalesce(benchmark, 'base') AS benchmark, coalesce(database, 'main') AS database FROM q")
def inject_fields(spark, folder):
    return Q.inject_fields(questions(spark, folder), "base", "main").select("id", "benchmark", "database")


# -- vocabulary ------------------------------------------------------------------------------


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """Standard words are the values of three columns; synonyms are their first and last two letters."""
    values = None
    for name, column in (("region", "r_name"), ("customer", "c_mktsegment"), ("part", "p_type")):
        one = table(spark, folder, name).select(F.lit(column).alias("field"), F.col(column).alias("standard_word")).distinct()
        values = one if values is None else values.unionByName(one)
    ends = F.array(F.substring("standard_word", 1, 2), F.expr("right(standard_word, 2)"))
    return values.withColumn("synonyms", ends)


DICTIONARY_SQL = """
WITH v AS (SELECT DISTINCT 'r_name' AS field, r_name AS standard_word FROM region UNION SELECT 'c_mktsegment', c_mktsegment FROM customer UNION SELECT 'p_type', p_type FROM part),
e AS (SELECT DISTINCT lower(unnest([standard_word, standard_word[1:2], right(standard_word, 2)])) AS term, field, standard_word FROM v)
"""


@add(
    "resolve_synonyms",
    DICTIONARY_SQL + """, b AS (SELECT o_orderkey, c_mktsegment, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT o_orderkey, c_mktsegment[1:2] AS term, NULL AS context FROM b UNION ALL SELECT o_orderkey, right(r_name, 2), 'r_name' FROM b
  UNION ALL SELECT o_orderkey, r_name, NULL FROM b UNION ALL SELECT o_orderkey, lower(c_mktsegment), NULL FROM b)
SELECT o_orderkey, m.term, field, standard_word FROM m JOIN e ON lower(m.term) = e.term AND (context IS NULL OR context = field)""",
)
def resolve_synonyms(spark, folder):
    """Short forms with and without field context, and words found in free text."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    base = buyers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "r_name")
    short = F.array(
        F.struct(F.substring("c_mktsegment", 1, 2).alias("term"), F.lit(None).cast("string").alias("context")),
        F.struct(F.expr("right(r_name, 2)").alias("term"), F.lit("r_name").alias("context")),
        F.struct(F.col("r_name").alias("term"), F.lit(None).cast("string").alias("context")),
    )
    mentions = base.select("o_orderkey", F.explode(short).alias("m")).select("o_orderkey", "m.*")
    text = F.concat(F.lit("sales: ("), F.lower("c_mktsegment"), F.lit("), total"))
    known = dictionary(spark, folder)
    spoken = V.find_terms(base.select("o_orderkey", text.alias("text")), "text", known)
    columns = "o_orderkey", "term", "field", "standard_word"
    return V.resolve_synonyms(mentions, known).select(*columns).unionByName(spoken.select(*columns))


@add(
    "resolve_free_text",
    """WITH b AS (SELECT c_custkey, n_name, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, 6 AS start, lower(regexp_replace(n_name, '[^A-Za-z0-9_]+', ' ', 'g')) AS term, n_name AS standard_word FROM b
UNION ALL SELECT c_custkey, 1, 'grand people s republic of ' || lower(regexp_replace(n_name, '[^A-Za-z0-9_]+', ' ', 'g')), n_name FROM b
UNION ALL SELECT c_custkey, 7 + len(regexp_split_to_array(n_name, '[^A-Za-z0-9_]+')) - 1, '第 ' || n_nationkey || ' 国 家', n_name FROM b""",
)
def resolve_free_text(spark, folder):
    """Terms of more than four words, with hyphens, apostrophes and Chinese characters, found in running text."""
    nation = table(spark, folder, "nation")
    name, number = F.col("n_name"), F.col("n_nationkey").cast("string")
    synonyms = F.array(F.concat(F.lit("Grand People's Republic of "), name), F.concat(F.lit("第"), number, F.lit("国家")))
    known = nation.select(F.lit("n_name").alias("field"), name.alias("standard_word"), synonyms.alias("synonyms"))
    text = F.concat(F.lit("GRAND PEOPLE\u2019S republic-of "), F.lower(name), F.lit(",第"), number, F.lit("国家的客户"))
    texts = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", text.alias("text"))
    return V.find_terms(texts, "text", known).select("c_custkey", "start", "term", "standard_word")


@add("ambiguous_synonyms", DICTIONARY_SQL + "SELECT term, COUNT(DISTINCT field || standard_word) AS targets FROM e GROUP BY term HAVING COUNT(DISTINCT field || standard_word) > 1")
def ambiguous_synonyms(spark, folder):
    return V.ambiguous_synonyms(dictionary(spark, folder))


@add("bilingual_filter", "SELECT c_custkey, c_mktsegment AS segment_en, '市场-' || lower(c_mktsegment) AS segment_zh FROM customer WHERE c_mktsegment = 'BUILDING'")
def bilingual_filter(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("segment_en"), F.concat(F.lit("市场-"), F.lower("c_mktsegment")).alias("segment_zh")
    )
    return customers.where(V.language_column("segment", "zh") == "市场-building")


@add(
    "semantic_trait_flags",
    Q_SQL + "SELECT id, list_contains(tags, 'lang-de') OR list_contains(tags, 'type-0') AS synonym, list_contains(tags, 'type-1') AS time_aware, list_contains(tags, 'lang-en') AS knowledge FROM q",
)
def semantic_trait_flags(spark, folder):
    traits = {"synonym": ("lang-de", "type-0"), "time_aware": ("type-1",), "knowledge": ("lang-en",)}
    return V.trait_flags(questions(spark, folder), traits)
