"""Operators on question sets.

A question frame is flat: pos (order in the set), id, benchmark, database, question, dialect, sql,
variants map<'sql.N', text>, difficulty, tags array<string>, order_relevant, verified, occupation,
caliber, currency, region and department map<string, array<string>>, preferences array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import sqltext as S
from ledgerlens.operators.rows import dense_index, rank_index

SAMPLE_SEED = 42


# -- filters ---------------------------------------------------------------------------------


def filter_ids(questions: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """By a list, or by a frame with a column id for long lists."""
    if isinstance(ids, DataFrame):
        return questions.join(ids.select("id"), "id", "left_semi")
    return questions.where(F.col("id").isin(*ids))


def filter_difficulty(questions: DataFrame, *levels: str) -> DataFrame:
    """Any of the levels, whatever the case. A missing level is the empty text, not 'unknown'."""
    wanted = [level.lower() for level in levels]
    return questions.where(F.lower(F.coalesce("difficulty", F.lit(""))).isin(*wanted))


def filter_tags(questions: DataFrame, *tags: str) -> DataFrame:
    return questions.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def filter_dialect(questions: DataFrame, dialect: str) -> DataFrame:
    return questions.where(F.lower(F.coalesce("dialect", F.lit(""))) == dialect.lower())


def filter_verified(questions: DataFrame) -> DataFrame:
    return questions.where(F.coalesce("verified", F.lit(False)))


def latest_by_id(questions: DataFrame) -> DataFrame:
    """One question per id; of several the last one counts."""
    row = F.struct(*[c for c in questions.columns if c != "id"])
    return questions.groupBy("id").agg(F.max_by(row, "pos").alias("q")).select("id", "q.*")


def lookup_id(questions: DataFrame, *ids: str) -> DataFrame:
    return latest_by_id(filter_ids(questions, list(ids)))


def slice_rows(questions: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions start to stop, the last one left out."""
    return questions.where((F.col("pos") >= start) & (F.col("pos") < stop))


def stable_sample(questions: DataFrame, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """The n smallest hashes of (seed, id), in question order. A larger n only adds questions."""
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))
    drawn = questions.withColumn("_ticket", ticket).orderBy("_ticket", "id").limit(n)
    return drawn.drop("_ticket").orderBy("pos")


def keyword_search(questions: DataFrame, *terms: str) -> DataFrame:
    """All terms occur in id, question, tags, currency, region or department words."""
    words = [F.flatten(F.map_values(name)) for name in ("region", "department")]
    blob = F.lower(F.concat_ws(" ", "id", "question", "tags", "currency", *words))
    found = F.lit(True)
    for term in terms:
        found = found & F.contains(blob, F.lit(term.lower()))
    return questions.where(found)


# -- order and variants ----------------------------------------------------------------------


def is_ordered(questions: DataFrame, unordered: bool = False) -> DataFrame:
    """Add ordered: the explicit flag, else whether the first statement has an ORDER BY."""
    flag = F.lit(False) if unordered else F.coalesce("order_relevant", S.has_order_by(F.col("sql")))
    return questions.withColumn("ordered", flag)


def order_relevance_counts(questions: DataFrame) -> DataFrame:
    """Explicit flags, and flags plus statements that contain the plain text ORDER BY."""
    said = F.coalesce("order_relevant", F.lit(False))
    deduced = F.col("order_relevant").isNull() & F.contains(F.upper(F.coalesce("sql", F.lit(""))), F.lit("ORDER BY"))
    return questions.agg(F.count_if(said).alias("explicit"), F.count_if(said | deduced).alias("deduced"))


def gold_variants(questions: DataFrame) -> DataFrame:
    """(id, variant, sql): the statement first, then the keys sql.N in text order; none gives ''."""
    numbered = F.map_filter("variants", lambda k, v: k.rlike("^sql\\.[0-9]+$"))
    others = F.transform(F.array_sort(F.map_keys(numbered)), lambda k: numbered[k])
    first = F.when(F.col("sql").isNotNull(), F.array("sql")).otherwise(F.array().cast("array<string>"))
    every = F.concat(first, F.coalesce(others, F.array().cast("array<string>")))
    every = F.when(F.size(every) == 0, F.array(F.lit(""))).otherwise(every)
    return questions.select("id", F.posexplode(every).alias("variant", "sql"))


# -- profile ---------------------------------------------------------------------------------


def _share(questions: DataFrame, count: Column) -> Column:
    return count / questions.agg(F.count("*").alias("n")).scalar()


def question_stats(questions: DataFrame) -> DataFrame:
    """Counts, verified counts and mean SQL length: overall, by difficulty, by dialect."""
    flat = questions.select(
        F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"),
        F.coalesce("dialect", F.lit("unknown")).alias("dialect"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.length(F.coalesce("sql", F.lit(""))).alias("length"),
    )
    by_level, by_dialect = F.grouping("difficulty") == 0, F.grouping("dialect") == 0
    kind = F.when(by_level, "difficulty").when(by_dialect, "dialect").otherwise("total")
    return (
        flat.groupingSets([["difficulty"], ["dialect"], []], "difficulty", "dialect")
        .agg(
            kind.alias("kind"),
            F.count("*").alias("n"),
            F.count_if("verified").alias("verified"),
            (F.sum("length") / F.count("*")).alias("avg_length"),
        )
        .select("kind", F.coalesce("difficulty", "dialect", F.lit("all")).alias("name"), "n", "verified", "avg_length")
    )


def tag_counts(questions: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent tags; of equals the one seen first."""
    tags = questions.select("pos", F.posexplode("tags").alias("place", "tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("pos", "place")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).select("tag", "n")


def sql_length_profile(questions: DataFrame) -> DataFrame:
    length = F.length(F.coalesce("sql", F.lit("")))
    counts = questions.groupBy(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(
        F.count("*").alias("n"), F.avg(length).alias("avg"), F.min(length).alias("low"), F.max(length).alias("high")
    )
    return counts.withColumn("share", _share(questions, F.col("n")))


def sql_feature_census(questions: DataFrame) -> DataFrame:
    """Questions that use each SQL feature, comments aside."""
    shown = questions.select(F.explode(S.features(S.strip_comments(F.coalesce("sql", F.lit(""))))).alias("feature"))
    counts = shown.groupBy("feature").agg(F.count("*").alias("n"))
    return counts.withColumn("share", _share(questions, F.col("n")))


def table_coverage(questions: DataFrame, tables: list[str]) -> DataFrame:
    """Questions per table; one question may use several."""
    names = questions.select(F.explode(S.table_names(S.strip_comments(F.col("sql")))).alias("name"))
    return names.where(F.col("name").isin(*tables)).groupBy("name").agg(F.count("*").alias("n"))


def profile_distribution(questions: DataFrame) -> DataFrame:
    counts = questions.groupBy(F.coalesce("occupation", F.lit("Unspecified")).alias("occupation")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", _share(questions, F.col("n")) * 100)


# -- unify -----------------------------------------------------------------------------------


def _no_map() -> Column:
    return F.create_map().cast("map<string,array<string>>")


def _plain(raw: DataFrame, benchmark: str, **columns: Column) -> DataFrame:
    """A question frame with the defaults of external corpora."""
    text = F.lit(None).cast("string")
    values = {
        "pos": F.col("pos"),
        "id": text,
        "benchmark": F.lit(benchmark),
        "database": F.when(F.col("db_id") != "", F.col("db_id")),
        "question": F.coalesce("question", F.lit("")),
        "dialect": F.lit("sqlite"),
        "sql": text,
        "variants": F.create_map().cast("map<string,string>"),
        "difficulty": F.lit("unknown"),
        "tags": F.array().cast("array<string>"),
        "order_relevant": F.lit(None).cast("boolean"),
        "verified": F.lit(False),
        "occupation": text,
        "caliber": text,
        "currency": text,
        "region": _no_map(),
        "department": _no_map(),
        "preferences": F.array().cast("array<string>"),
        "db_id": F.col("db_id"),
        **columns,
    }
    return raw.select(*[value.alias(name) for name, value in values.items()])


def numbered_id(prefix: str, number: Column) -> Column:
    return F.format_string(f"{prefix}%05d", number.cast("bigint"))


def unify_bird(raw: DataFrame) -> DataFrame:
    """pos, question_id, db_id, question, evidence, SQL, difficulty to the common form.

    The id comes from question_id, or from the position where that is no number.
    """
    evidence = F.trim(F.coalesce("evidence", F.lit("")))
    none = F.array().cast("array<string>")
    number = F.coalesce(F.expr("try_cast(question_id AS bigint)"), "pos")
    return _plain(
        raw,
        "BirdSQL",
        id=numbered_id("Q", number),
        sql=F.coalesce("SQL", F.lit("")),
        difficulty=F.lower(F.coalesce(F.when(F.col("difficulty") != "", F.col("difficulty")), F.lit("unknown"))),
        preferences=F.when(evidence != "", F.array(evidence)).otherwise(none),
    )


def apply_corrections(raw: DataFrame, corrections: DataFrame) -> DataFrame:
    """Keep corrected questions only and take over what the correction holds.

    corrections(question_id, fields map<string,string>): a field that is there replaces the value
    even if it is null; a field that is missing leaves the value. Of several corrections of one
    question the last by ``pos`` counts; without that column, the one whose fields sort last.
    """
    text = F.to_json("fields", {"ignoreNullFields": "false"})
    rank = F.struct("pos", text) if "pos" in corrections.columns else text
    fixed = raw.join(corrections.groupBy("question_id").agg(F.max_by("fields", rank).alias("fields")), "question_id")

    def value(name: str, default: Column) -> Column:
        given = F.map_contains_key("fields", F.lit(name))
        return F.when(given, F.col("fields")[name]).otherwise(default).alias(name)

    names = ("question", "SQL", "evidence", "difficulty")
    default = {name: F.coalesce(name, F.lit("unknown" if name == "difficulty" else "")) for name in names}
    kept = [c for c in raw.columns if c not in names]
    return fixed.select(*kept, *[value(name, default[name]) for name in names])


def unify_kaggle(raw: DataFrame, databases: list[str]) -> DataFrame:
    """pos, db_id, split, question, query to the common form.

    Test questions are numbered through all databases in the given order, few-shot ones anew in
    each database.
    """
    places = F.array(*[F.lit(d) for d in databases])
    known = raw.withColumn("_db", F.array_position(places, F.col("db_id"))).where("_db > 0")
    test = rank_index(known.where("split = 'test'"), [F.col("_db"), F.col("pos")], out="_number")
    shots = dense_index(known.where("split = 'fewshot'"), ["db_id"], F.col("pos"), out="_number")

    def unified(df: DataFrame, prefix: str) -> DataFrame:
        return _plain(
            df, "KaggleDBQA", id=numbered_id(prefix, F.col("_number") + 1), sql=F.coalesce("query", F.lit("")), split=F.col("split")
        )

    return unified(test, "Q").unionByName(unified(shots, "F"))


def inject_fields(questions: DataFrame, benchmark: str, database: str) -> DataFrame:
    """Fill in benchmark and database where they are missing."""
    return questions.withColumn("benchmark", F.coalesce("benchmark", F.lit(benchmark))).withColumn(
        "database", F.coalesce("database", F.lit(database))
    )


def submission_template(questions: DataFrame, placeholder: str = "") -> DataFrame:
    return questions.select("id", F.lit(placeholder).alias("sql"))


def resolve_database(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add path and database_error from catalog(benchmark, database, path)."""
    routed = questions.join(catalog, ["benchmark", "database"], "left")
    missing = F.concat_ws(" ", F.lit("no database"), F.coalesce("database", F.lit("")), F.lit("in"), F.coalesce("benchmark", F.lit("")))
    return routed.withColumn("database_error", F.when(F.col("path").isNull(), missing))
