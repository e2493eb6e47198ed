"""From scores per (query, variant) to outcomes per query and a report per difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import rows as R
from ledgerlens.functions import cells as C
from ledgerlens.operators.bipartite import (
    _marks,
    align_ordered,
    align_unordered,
    bf_score,
    equal_shared,
    mismatch,
    overlap_score,
)
from ledgerlens.operators.exact import ex_match, row_counts
from ledgerlens.operators.rows import PAIR, SIZES
from ledgerlens.operators.soft import fbeta, soft_fbeta, soft_row_counts, soft_totals
from ledgerlens.session import stage

# The metrics of a report, the success threshold, the order of difficulty levels.
METRICS = ("exo", "exu", "sfo", "bfo", "bfu")
SUCCESS = 0.9999
LEVELS = ("simple", "moderate", "challenging", "nightmare", "unknown")


def score_results(
    results: DataFrame,
    pairs: DataFrame | None = None,
    bf_beta: float = 2.0,
    sf_beta: float = 1.0,
    dedup: bool = False,
    legacy_empty: bool = False,
    staged: bool = True,
) -> DataFrame:
    """All five metrics of every (query, variant).

    Without de-duplication one alignment by position yields the ordered exact match, the soft sums
    and the span that the ordered alignment still has to solve. ``staged`` writes the paired rows
    once to the shared folder, where four branches read them.
    """
    pairs = R.pair_list(results) if pairs is None else pairs
    if dedup:
        parts = {
            "exo": ex_match(results, pairs, ordered=True),
            "exu": ex_match(results, pairs),
            "sfo": soft_fbeta(results, pairs, sf_beta),
            "bfo": bf_score(results, pairs, bf_beta, True, True, legacy_empty),
            "bfu": bf_score(results, pairs, bf_beta, False, True),
        }
        named = [scores.withColumnRenamed("score", name) for name, scores in parts.items()]
        return R.merge_pairs(pairs.select(*PAIR, "n", "m"), *named)
    sided = stage(R.pair_sides(results, pairs), "sided") if staged else R.pair_sides(results, pairs)
    aligned = R.by_position(sided)
    positional = (
        aligned.select(
            *PAIR,
            F.col("p").eqNullSafe(F.col("g")).alias("same"),
            mismatch().alias("place"),
            soft_row_counts(F.col("p"), F.col("g")).alias("s"),
        )
        .groupBy(*PAIR)
        .agg(
            F.bool_and("same").cast("double").alias("exo"),
            F.min("place").alias("lo"),
            F.max("place").alias("hi"),
            *soft_totals("s")[:3],
        )
    )
    rows = row_counts(sided, _marks(F.col("cells")).alias("k0"), C.encoded_keys(F.col("cells")).alias("k1"))
    by_marks = rows.groupBy(*PAIR, *SIZES, "k0").agg(F.sum("cp").alias("cp"), F.sum("cg").alias("cg"))
    exu = rows.groupBy(*PAIR).agg(F.bool_and(F.col("cp") == F.col("cg")).cast("double").alias("exu"))
    spans = positional.where("lo IS NOT NULL").select(*PAIR, "lo", "hi")
    in_order = align_ordered(sided, spans).withColumnRenamed("shared", "shared_o")
    free = align_unordered(sided, by_marks).withColumnRenamed("shared", "shared_u")
    sums = F.col("hit"), F.col("p_only"), F.col("g_only")
    nothing = (F.col("n") == 0) & (F.col("m") == 0)

    one = F.lit(1.0)
    return R.merge_pairs(pairs, positional, exu, in_order, free).select(
        *PAIR,
        "n",
        "m",
        F.coalesce("exo", one).alias("exo"),
        F.coalesce("exu", one).alias("exu"),
        F.when(nothing, one).otherwise(fbeta(*sums, sf_beta)).alias("sfo"),
        overlap_score(F.coalesce(F.col("shared_o"), equal_shared()), bf_beta, True, legacy_empty).alias("bfo"),
        overlap_score(F.coalesce("shared_u", F.lit(0)), bf_beta, False).alias("bfu"),
    )


def large_result_flags(results: DataFrame, above: int = 1000) -> DataFrame:
    """Result tables of more than ``above`` rows: a report, nothing is scored otherwise for it."""
    return R.table_sizes(results).where(F.col("n_rows") > above).select("query_id", "side", "variant", "n_rows")


def best_variant(scores: DataFrame, best: str = "exo") -> DataFrame:
    """One line per query: the metrics of the first variant with the highest ordered exact match.

    ``best='max'`` takes each metric's own maximum instead.
    """
    if best == "max":
        return scores.groupBy("query_id").agg(F.min("variant").alias("variant"), *[F.max(m).alias(m) for m in METRICS])
    rank = F.struct(F.col("exo"), (-F.col("variant")).alias("place"))
    pick = F.max_by(F.struct("variant", *METRICS), rank)
    return scores.groupBy("query_id").agg(pick.alias("pick")).select("query_id", "pick.*")


def classify_outcome(entries: DataFrame) -> DataFrame:
    """Add success and pred_error.

    Reads the columns known (question exists), database_error, pd_sql, run_error, gold_valid and
    gt_error; the first failure in this order names the outcome.
    """
    error = (
        F.when(F.coalesce("pd_sql", F.lit("")) == "", "No prediction provided")
        .when(~F.col("known"), F.concat(F.lit("Query ID not found: "), "query_id"))
        .when(F.col("database_error").isNotNull(), F.concat(F.lit("DB resolution failed: "), "database_error"))
        .when(F.col("run_error").isNotNull(), F.col("run_error"))
        .when(~F.col("gold_valid"), F.coalesce("gt_error", F.lit("No valid ground truth SQL")))
    )
    return entries.withColumn("pred_error", error).withColumn("success", F.col("pred_error").isNull())


def submission_join(questions: DataFrame, submission: DataFrame) -> DataFrame:
    """Questions that the submission answers; a null answer is the empty text.

    Of several answers to one id the last one by ``pos`` counts; without that column, the greatest text.
    """
    sql = F.coalesce("sql", F.lit(""))
    last = F.max_by(sql, F.struct("pos", sql)) if "pos" in submission.columns else F.max(sql)
    return questions.join(submission.groupBy("id").agg(last.alias("pd_sql")), "id")


def report_rollup(outcomes: DataFrame) -> DataFrame:
    """Per difficulty and overall: N, C = successes, C / N, and per metric A, A / N and the mean.

    Reads difficulty, success and the metrics; a failed query counts 0 everywhere.
    """
    levels = outcomes.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    measures = [F.count("*").alias("n"), F.count_if("success").alias("c")]
    for metric in METRICS:
        good = F.col("success") & (F.col(metric) >= SUCCESS)
        measures.append(F.count_if(good).alias(f"a_{metric}"))
        measures.append(F.sum(F.when(F.col("success"), F.col(metric)).otherwise(0.0)).alias(f"_sum_{metric}"))
    level = F.when(F.grouping("difficulty") == 1, "overall").otherwise(F.col("difficulty"))
    grouped = levels.groupingSets([["difficulty"], []], "difficulty").agg(level.alias("level"), *measures)
    rates = []
    for metric in METRICS:
        rates += [
            F.col(f"a_{metric}"),
            (F.col(f"a_{metric}") / F.col("n")).alias(f"rate_{metric}"),
            (F.col(f"_sum_{metric}") / F.col("n")).alias(f"mean_{metric}"),
        ]
    return grouped.select("level", "n", "c", (F.col("c") / F.col("n")).alias("compilable"), *rates)


def gt_failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("gt_error IS NOT NULL").select("query_id", F.col("gt_error").alias("error"))


def failed_top(outcomes: DataFrame, k: int = 10, order: str = "query_id") -> DataFrame:
    return outcomes.where(~F.col("success")).orderBy(order).limit(k).select("query_id", "pred_error")


def score_table(report: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Metric by difficulty, success rates in the cells."""
    pairs = ", ".join(f"'{m}', rate_{m}" for m in METRICS)
    long = report.selectExpr("level", f"stack({len(METRICS)}, {pairs}) AS (metric, rate)")
    return long.groupBy("metric").pivot("level", levels or [*LEVELS, "overall"]).agg(F.max("rate"))
