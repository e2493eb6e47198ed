"""Question sets, submissions and reports as JSON.

One JSON object per line is the form that Spark can split; ``lines=False`` reads files that hold one
JSON list (or one object), each in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRICT = {"mode": "FAILFAST"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, numbered 0, 1, 2, … in the order of files and of lines in a file.

    The lines of one file block are read by one task in order, so their ids follow each other; only
    the sizes of the blocks meet in one place.
    """
    block = ["_file", "_block"]
    kept = spark.read.text(path).where(F.trim("value") != "")
    lines = kept.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    sizes = lines.groupBy(*block).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*block, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return lines.join(starts, block).select((F.col("_before") + F.col("_id") - F.col("_first")).alias("pos"), "value")


def _objects(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Rows ``(pos, o map<string,string>, v map<string,variant>)``; nested values of ``o`` arrive as JSON text, ``v`` keeps all values as they are."""
    if lines:
        text = numbered_lines(spark, path)
    else:
        whole = spark.read.text(path, wholetext=True)
        parts = whole.select(F.posexplode(F.from_json("value", "array<variant>", STRICT)).alias("pos", "v"))
        text = parts.select(F.col("pos").cast("bigint").alias("pos"), F.to_json("v").alias("value"))
    return text.select(
        "pos", F.from_json("value", "map<string,string>", STRICT).alias("o"), F.from_json("value", "map<string,variant>", STRICT).alias("v")
    )


# The keys of a question by level; any other key is kept as it is in ``extra``.
KEYS = {
    "/": ("benchmark", "database", "id", "question", "context", "schema", "dialect", "sql", "metadata"),
    "/context/": ("query_time", "user_profile"),
    "/context/user_profile/": ("occupation", "caliber", "currency", "region", "department", "preferences"),
    "/metadata/": ("difficulty", "query_tags", "order-relevant", "verified"),
}
VARIANT_KEY = "^sql\\.[0-9]+$"


def _others(values: Column, level: str) -> Column:
    """Unknown keys of a level with their values as JSON text. Keys are paths; in a name ``~`` is written ``~0`` and ``/`` is ``~1``."""
    unknown = F.map_filter(values, lambda k, v: ~k.isin(*KEYS[level]) & ~(F.lit(level == "/") & k.rlike(VARIANT_KEY)))
    named = F.transform_keys(F.transform_values(unknown, lambda k, v: F.to_json(v)), lambda k, v: F.concat(F.lit(level), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    return F.coalesce(named, F.create_map().cast("map<string,string>"))


def _word_lists(raw: Column) -> Column:
    """A map whose values are a word or a list of words."""
    plain = F.from_json(raw, "map<string,string>")
    return F.transform_values(
        plain, lambda k, v: F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    )


def read_questions(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """One row per question. ``schema`` is JSON text; ``extra`` holds every key that has no column, by its path, as JSON text."""
    o = F.col("o")
    open_records = lambda c: F.from_json(c, "map<string,variant>", STRICT)
    parsed = _objects(spark, path, lines).select(
        "pos",
        "o",
        "v",
        F.from_json(o["context"], "map<string,string>", STRICT).alias("c"),
        F.from_json(o["metadata"], "map<string,string>", STRICT).alias("m"),
    )
    parsed = parsed.withColumn("u", F.from_json(F.col("c")["user_profile"], "map<string,string>", STRICT))
    m, u = F.col("m"), F.col("u")
    schema = F.to_json(F.col("v")["schema"])
    return parsed.select(
        "pos",
        o["id"].alias("id"),
        o["benchmark"].alias("benchmark"),
        o["database"].alias("database"),
        o["question"].alias("question"),
        o["dialect"].alias("dialect"),
        o["sql"].alias("sql"),
        F.map_filter("o", lambda k, v: k.rlike(VARIANT_KEY)).alias("variants"),
        m["difficulty"].alias("difficulty"),
        F.from_json(m["query_tags"], "array<string>").alias("tags"),
        m["order-relevant"].cast("boolean").alias("order_relevant"),
        m["verified"].cast("boolean").alias("verified"),
        u["occupation"].alias("occupation"),
        u["caliber"].alias("caliber"),
        u["currency"].alias("currency"),
        _word_lists(u["region"]).alias("region"),
        _word_lists(u["department"]).alias("department"),
        F.from_json(u["preferences"], "array<string>").alias("preferences"),
        F.col("c")["query_time"].cast("bigint").alias("query_time"),
        F.when(schema != "null", schema).alias("schema"),
        F.map_concat(
            _others(F.col("v"), "/"),
            _others(open_records(o["context"]), "/context/"),
            _others(open_records(F.col("c")["user_profile"]), "/context/user_profile/"),
            _others(open_records(o["metadata"]), "/metadata/"),
        ).alias("extra"),
    )


def _members(structure: Column) -> Column:
    """A struct as the members of a JSON object, without braces."""
    whole = F.to_json(structure, {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def question_json(questions: DataFrame) -> Column:
    """The question as one JSON object; variants stand beside ``sql`` under their own keys, the members of ``extra`` at their paths.

    Questions without the columns query_time, schema and extra get nulls and no further members.
    """
    given = lambda name, default: F.col(name) if name in questions.columns else default
    extra = given("extra", F.create_map().cast("map<string,string>"))

    def others(level: str) -> Column:
        here = F.filter(F.map_entries(extra), lambda e: F.regexp_extract(e["key"], "^(.*/)[^/]*$", 1) == level)
        name = lambda k: F.replace(F.replace(F.substring(k, F.lit(len(level) + 1), F.length(k)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        # names are quoted by writing them as a list of one text
        quoted = lambda k: F.regexp_extract(F.to_json(F.array(name(k))), "^.(.*).$", 1)
        return F.array_join(F.transform(here, lambda e: F.concat(F.lit(","), quoted(e["key"]), F.lit(":"), e["value"])), "")

    profile = _members(F.struct("occupation", "caliber", "currency", "region", "department", "preferences"))
    metadata = _members(F.struct("difficulty", F.col("tags").alias("query_tags"), F.col("order_relevant").alias("order-relevant"), "verified"))
    variants = F.to_json("variants")
    return F.concat(
        F.lit("{"),
        _members(F.struct("benchmark", "database", "id", "question")),
        F.lit(',"context":{'),
        _members(F.struct(given("query_time", F.lit(None).cast("bigint")).alias("query_time"))),
        F.lit(',"user_profile":{'),
        profile,
        others("/context/user_profile/"),
        F.lit("}"),
        others("/context/"),
        F.lit('},"schema":'),
        F.coalesce(given("schema", F.lit(None).cast("string")), F.lit("null")),
        F.lit(","),
        _members(F.struct("dialect", "sql")),
        F.when(F.size("variants") > 0, F.concat(F.lit(","), F.substring(variants, F.lit(2), F.length(variants) - 2))).otherwise(""),
        F.lit(',"metadata":{'),
        metadata,
        others("/metadata/"),
        F.lit("}"),
        others("/"),
        F.lit("}"),
    )


def write_questions(questions: DataFrame, path: str) -> None:
    """One line per question, in the order of ``pos`` where it is given, so that reading numbers them alike."""
    kept = [F.col("pos")] if "pos" in questions.columns else []
    lines = questions.select(question_json(questions).alias("value"), *kept)
    (lines.orderBy("pos") if kept else lines).select("value").write.text(path)


def partition_questions(questions: DataFrame, path: str) -> None:
    """One folder per database; reading one prunes the others."""
    questions.select("database", question_json(questions).alias("value")).write.partitionBy("database").text(path)


def read_submission(spark: SparkSession, path: str, lines: bool = True, strict: bool = True) -> DataFrame:
    """(id, sql) from JSON objects id to SQL text or null; null becomes ''.

    Empty ids and values of another type are errors: raised if ``strict``, else told in ``error``.
    """
    text = spark.read.text(path, wholetext=not lines).where(F.trim("value") != "")
    pairs = text.select(F.explode(F.from_json("value", "map<string,variant>", STRICT)).alias("id", "v"))
    kind = F.schema_of_variant("v")
    error = (
        F.when(F.trim("id") == "", "An answer needs a non-empty question id.")
        .when(
            ~kind.isin("STRING", "VOID"),
            F.concat(F.lit("The answer to "), F.col("id"), F.lit(" must be a SQL string or null; it is of type "), F.lower(kind)),
        )
    )
    checked = pairs.select("id", F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("")).alias("sql"), error.alias("error"))
    if not strict:
        return checked
    sql = F.when(F.col("error").isNull(), F.col("sql")).otherwise(F.raise_error("error").cast("string"))
    return checked.select("id", sql.alias("sql"))


def write_submission(answers: DataFrame, path: str) -> None:
    one = F.to_json(F.map_from_arrays(F.array("id"), F.array("sql")), {"ignoreNullFields": "false"})
    answers.select(one.alias("value")).write.text(path)


def write_report(scores: DataFrame, report: DataFrame, path: str) -> None:
    scores.write.json(f"{path}/results")
    report.write.json(f"{path}/report")


def file_integrity(spark: SparkSession, manifest: DataFrame, path: str, pattern: str = "*") -> DataFrame:
    """Check files against manifest(name, expected_md5, expected_size).

    No expected checksum is a pass; a missing file fails. Each file is hashed in the task that
    reads it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.length("content").cast("bigint").alias("size"), F.md5("content").alias("md5")
    )
    checked = manifest.join(found, "name", "left")
    status = (
        F.when(F.col("expected_md5").isNull(), "skipped")
        .when(F.col("md5").isNull(), "missing")
        .when(F.col("md5") != F.col("expected_md5"), "mismatch")
        .otherwise("ok")
    )
    return checked.select(
        "name",
        status.alias("status"),
        status.isin("ok", "skipped").alias("passed"),
        F.coalesce(F.col("size") == F.col("expected_size"), F.lit(False)).alias("size_matches"),
    )
