"""Registered queries: comparison of result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.operators import bipartite as B
from ledgerlens.operators import edges as D
from ledgerlens.operators import exact as E
from ledgerlens.operators import report as P
from ledgerlens.operators import rows as R
from ledgerlens.operators import soft as S
from ledgerlens.plans import result_pairs as X
from ledgerlens.plans.registry import Registry
from ledgerlens.session import stage
from ledgerlens.sources.tables import table

registry = Registry()
add = registry.add


def text(column):
    return F.array_join(column, "|")


def listed_pairs(results):
    """The pair list written once: the figures of a query read it several times."""
    return stage(R.pair_list(results), "pairs")


# -- cells and rows --------------------------------------------------------------------------


@add(
    "norm_cells",
    f"""
SELECT CAST(o_orderkey AS VARCHAR) AS query_id,
       'n' || o_custkey || '|' || {X.number_sql('o_totalprice / 7')} || '|' ||
       CASE WHEN o_orderstatus = 'P' THEN 'z' ELSE 's' || o_orderstatus END || '|d' || strftime(o_orderdate, '%Y-%m-%d') || '|' ||
       CASE WHEN o_orderstatus = 'F' THEN 'n1' ELSE 'n0' END AS cells,
       'i|f|' || CASE WHEN o_orderstatus = 'P' THEN 'a' ELSE 's' END || '|d|b' AS tags
FROM orders""",
)
def norm_cells(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("query_id"),
        F.lit("p").alias("side"),
        F.lit(0).alias("variant"),
        F.lit(0).alias("row_idx"),
        "o_custkey",
        (F.col("o_totalprice") / 7).alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_orderstatus") == "F").alias("done"),
    )
    cells = R.norm_cells(rows, ["o_custkey", "price", "status", "day", "done"])
    return cells.select(
        "query_id",
        text(F.transform("cells", lambda c: c["key"])).alias("cells"),
        text(F.transform("cells", lambda c: c["tag"])).alias("tags"),
    )


@add("row_bag", X.PARTS_SQL + "SELECT side, query_id, row_idx, array_to_string(list_sort(marks), '|') AS bag FROM marked")
def row_bag(spark, folder):
    counted = C.counted_keys(F.transform("cells", lambda c: c["key"]))
    marks = F.transform(counted, lambda c: F.concat(c["key"], F.lit("#"), c["ord"].cast("string")))
    return X.parts(spark, folder).select("side", "query_id", "row_idx", text(F.array_sort(marks)).alias("bag"))


@add(
    "row_encode",
    X.MONTHS_SQL
    + """SELECT query_id, 'g' AS side, variant, row_idx, array_to_string(enc, '|') AS enc FROM gold
UNION ALL SELECT query_id, 'p', 0, row_idx, array_to_string(enc, '|') FROM pred""",
)
def row_encode(spark, folder):
    results = X.stored_months(spark, folder)
    return results.select("query_id", "side", "variant", "row_idx", text(C.encoded_keys(F.col("cells"))).alias("enc"))


def _dedup_sql(key: str) -> str:
    return (
        X.PARTS_SQL
        + f""", first AS (
  SELECT side, query_id, {key} AS k, arg_min(keys, row_idx) AS keys, MIN(row_idx) AS first_at FROM marked GROUP BY side, query_id, {key})
SELECT side, query_id, row_number() OVER (PARTITION BY side, query_id ORDER BY first_at) - 1 AS row_idx,
       array_to_string(keys, '|') AS cells FROM first"""
    )


@add("dedup_rows_ordered", _dedup_sql("keys"))
def dedup_rows_ordered(spark, folder):
    rows = R.dedup_rows(X.stored_parts(spark, folder), "ordered")
    return rows.select("side", "query_id", "row_idx", text(C.ordered_keys(F.col("cells"))).alias("cells"))


@add("dedup_rows_bag", _dedup_sql("bag"))
def dedup_rows_bag(spark, folder):
    rows = R.dedup_rows(X.stored_parts(spark, folder), "bag")
    return rows.select("side", "query_id", "row_idx", text(C.ordered_keys(F.col("cells"))).alias("cells"))


# -- exact match -----------------------------------------------------------------------------


def _lists_sql(pred: str, gold: str) -> str:
    """Compare two whole result tables as lists."""
    return (
        X.MONTHS_SQL
        + f""", p AS (SELECT query_id, {pred} AS l FROM pred GROUP BY query_id),
g AS (SELECT query_id, variant, {gold} AS l FROM gold GROUP BY query_id, variant)
SELECT query_id, variant, CASE WHEN p.l = g.l THEN 1e0 ELSE 0e0 END AS score FROM g LEFT JOIN p USING (query_id)"""
    )


_IN_ORDER = "list(array_to_string(keys, '|') ORDER BY row_idx)"
_SORTED = "list_sort(list(array_to_string(enc, '|')))"
_DISTINCT = "list_sort(list(DISTINCT array_to_string(enc, '|')))"


@add("ex_ordered", _lists_sql(_IN_ORDER, _IN_ORDER))
def ex_ordered(spark, folder):
    return E.ex_ordered(X.stored_months(spark, folder), dedup=False)


@add("ex_multiset", _lists_sql(_SORTED, _SORTED))
def ex_multiset(spark, folder):
    return E.ex_multiset(X.stored_months(spark, folder))


@add("ex_set", _lists_sql(_DISTINCT, _DISTINCT))
def ex_set(spark, folder):
    return E.ex_set(X.stored_months(spark, folder))


@add(
    "ex_match",
    X.PARTS_SQL
    + """, c AS (SELECT query_id, bag, COUNT(*) FILTER (side = 'p') AS cp, COUNT(*) FILTER (side = 'g') AS cg FROM marked GROUP BY query_id, bag)
SELECT query_id, 0 AS variant, CASE WHEN bool_and(cp = cg) THEN 1e0 ELSE 0e0 END AS multiset,
       CASE WHEN bool_and((cp > 0) = (cg > 0)) THEN 1e0 ELSE 0e0 END AS same_set FROM c GROUP BY query_id""",
)
def ex_match(spark, folder):
    results = X.stored_parts(spark, folder)
    pairs = listed_pairs(results)
    multiset = E.ex_match(results, pairs, dedup=False).withColumnRenamed("score", "multiset")
    same_set = E.ex_match(results, pairs, dedup=False, fixed=False).withColumnRenamed("score", "same_set")
    return R.merge_pairs(multiset, same_set)


# -- soft F-beta -----------------------------------------------------------------------------

_SOFT_CTE = """, aligned AS (
  SELECT query_id, p.keys AS p, g.keys AS g FROM pred p FULL JOIN gold g USING (query_id, row_idx)),
parts AS (
  SELECT query_id,
         CASE WHEN p IS NULL OR g IS NULL THEN 0.0 ELSE len(list_filter(p, lambda x: list_contains(g, x))) / CAST(len(g) AS DOUBLE) END AS hit,
         CASE WHEN g IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 ELSE len(list_filter(p, lambda x: NOT list_contains(g, x))) / CAST(len(g) AS DOUBLE) END AS po,
         CASE WHEN g IS NULL THEN 0.0 WHEN p IS NULL THEN 1.0 ELSE len(list_filter(g, lambda x: NOT list_contains(p, x))) / CAST(len(g) AS DOUBLE) END AS go
  FROM aligned),
sums AS (SELECT query_id, SUM(hit) AS hit, SUM(po) AS po, SUM(go) AS go FROM parts GROUP BY query_id),
pr AS (SELECT query_id, coalesce(hit / nullif(hit + po, 0), 0) AS pr, coalesce(hit / nullif(hit + go, 0), 0) AS re FROM sums)
"""


@add(
    "soft_row_match",
    X.PARTS_SQL + _SOFT_CTE.split(",\nsums")[0]
    + """SELECT query_id, round(SUM(hit), 6) AS hit, round(SUM(po), 6) AS p_only, round(SUM(go), 6) AS g_only FROM parts GROUP BY query_id""",
)
def soft_row_match(spark, folder):
    results = X.stored_parts(spark, folder)
    sums = S.soft_sums(R.by_position(R.pair_sides(results, listed_pairs(results))))
    return sums.select("query_id", *[F.round(F.col(c) / F.col("width"), 6).alias(c) for c in S.COUNTS])


# Whole cells (rows are three cells wide) and one division, so that no sum depends on its order.
_CELLS_CTE = """, aligned AS (
  SELECT query_id, p.keys AS p, g.keys AS g FROM pred p FULL JOIN gold g USING (query_id, row_idx)),
cells AS (
  SELECT query_id,
         CASE WHEN p IS NULL OR g IS NULL THEN 0 ELSE len(list_filter(p, lambda x: list_contains(g, x))) END AS hit,
         CASE WHEN g IS NULL THEN 3 WHEN p IS NULL THEN 0 ELSE len(list_filter(p, lambda x: NOT list_contains(g, x))) END AS po,
         CASE WHEN g IS NULL THEN 0 WHEN p IS NULL THEN 3 ELSE len(list_filter(g, lambda x: NOT list_contains(p, x))) END AS go
  FROM aligned),
pr AS (SELECT query_id, SUM(hit) AS hit, SUM(po) AS po, SUM(go) AS go FROM cells GROUP BY query_id)
"""


def _fbeta_sql(beta: int) -> str:
    b = beta * beta
    return f"round(coalesce(CAST({1 + b} * hit AS DOUBLE) / nullif({b} * (hit + go) + hit + po, 0), 0), 6)"


@add("soft_fbeta", X.PARTS_SQL + _CELLS_CTE + f"SELECT query_id, 0 AS variant, {_fbeta_sql(1)} AS score FROM pr")
def soft_fbeta(spark, folder):
    results = X.stored_parts(spark, folder)
    scores = S.soft_fbeta(results, listed_pairs(results), dedup=False)
    return scores.select("query_id", "variant", F.round("score", 6).alias("score"))


# -- bipartite F-beta ------------------------------------------------------------------------


def _marks_sql(a: str, b: str, c: str) -> str:
    return f"[{a} || '#1', {b} || '#' || (1 + CAST({a} = {b} AS INTEGER)), {c} || '#' || (1 + CAST({a} = {c} AS INTEGER) + CAST({b} = {c} AS INTEGER))]"


# The rows of PARTS side by side, without what only the other metrics need.
_SIDE_BY_SIDE_SQL = X.PARTS_SQL[: X.PARTS_SQL.index("both_sides AS")] + f"""met AS (
  SELECT query_id, row_idx, {X.number_sql('p.a')} AS pa, {X.number_sql('p.b')} AS pb, {X.number_sql('p.c')} AS pc, {X.number_sql('g.a')} AS ga, {X.number_sql('g.b')} AS gb, {X.number_sql('g.c')} AS gc
  FROM pred_rows p JOIN gold_rows g USING (query_id, row_idx))
"""


@add(
    "row_fbeta",
    _SIDE_BY_SIDE_SQL
    + f"SELECT query_id, row_idx, round(5.0 * len(list_intersect({_marks_sql('pa', 'pb', 'pc')}, {_marks_sql('ga', 'gb', 'gc')})) / 15.0, 6) AS weight FROM met",
)
def row_fbeta(spark, folder):
    results = X.stored_parts(spark, folder)
    aligned = R.by_position(R.pair_sides(results, listed_pairs(results))).where("p IS NOT NULL AND g IS NOT NULL")
    return aligned.select("query_id", "row_idx", F.round(B.row_fbeta(F.col("p"), F.col("g")), 6).alias("weight"))


@add(
    "pair_weights",
    X.PARTS_SQL
    + """, w AS (SELECT query_id, p.row_idx, len(list_intersect(p.marks, g.marks)) AS c FROM pred p JOIN gold g USING (query_id))
SELECT query_id, row_idx, COUNT(*) FILTER (c > 0) AS partners, round(MAX(c) / 3.0, 6) AS best, round(SUM(c) / 3.0, 6) AS total
FROM w GROUP BY query_id, row_idx""",
)
def pair_weights(spark, folder):
    results = X.stored_parts(spark, folder)
    weights = B.pair_weights(results, listed_pairs(results))
    return weights.select(
        "query_id",
        "row_idx",
        F.size(F.array_remove("weights", 0.0)).cast("bigint").alias("partners"),
        F.round(F.array_max("weights"), 6).alias("best"),
        F.round(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w), 6).alias("total"),
    )


@add(
    "row_weights",
    X.PARTS_SQL
    + """, w AS (SELECT query_id, p.row_idx, len(list_intersect(p.marks, g.marks)) AS c FROM pred p JOIN gold g USING (query_id))
SELECT query_id, row_idx, COUNT(*) FILTER (c > 0) AS partners, round(MAX(c) / 3.0, 6) AS best, round(SUM(c) / 3.0, 6) AS total
FROM w GROUP BY query_id, row_idx""",
)
def row_weights(spark, folder):
    """The same sums from sparse edges: no matrix, and marks that many rows hold are counted by classes of rows."""
    results = X.stored_parts(spark, folder)
    pairs = listed_pairs(results)
    weights = D.row_weights(R.pair_sides(results, pairs), heavy=64, pairs=pairs)
    return weights.select("query_id", "row_idx", "partners", F.round("best", 6).alias("best"), F.round("total", 6).alias("total"))


# The recurrence row by row: each step takes the running maximum of the line above and the line
# above moved by one plus the weights.
_ORDERED_SQL = (
    X.MONTHS_SQL.replace("WITH base", "WITH RECURSIVE base", 1)
    + """, w AS (
  SELECT p.query_id, g.variant, p.row_idx AS i, list(len(list_intersect(p.keys, g.keys)) ORDER BY g.row_idx) AS w
  FROM pred p JOIN gold g USING (query_id) GROUP BY p.query_id, g.variant, p.row_idx),
dp AS (
  SELECT query_id, variant, CAST(0 AS BIGINT) AS i, list_transform(w, lambda x: CAST(0 AS BIGINT)) AS line FROM w WHERE i = 0
  UNION ALL
  SELECT query_id, variant, i + 1,
         list_transform(range(1, len(line) + 1), lambda j: list_max(list_slice(
           list_transform(range(1, len(line) + 1), lambda k: greatest(line[k], CASE WHEN k = 1 THEN 0 ELSE line[k - 1] END + w[k])), 1, j)))
  FROM (SELECT dp.query_id, dp.variant, dp.i, dp.line, w.w FROM dp JOIN w ON dp.query_id = w.query_id AND dp.variant = w.variant AND dp.i = w.i)),
best AS (SELECT query_id, variant, MAX(line[len(line)]) AS shared FROM dp GROUP BY query_id, variant),
size AS (
  SELECT g.query_id, g.variant, g.m, coalesce(p.n, 0) AS n, p.pw FROM (SELECT query_id, variant, COUNT(*) AS m FROM gold GROUP BY ALL) g
  LEFT JOIN (SELECT query_id, COUNT(*) AS n, MAX(len(keys)) AS pw FROM pred GROUP BY ALL) p USING (query_id))
"""
)


@add(
    "align_ordered",
    _ORDERED_SQL
    + """SELECT query_id, variant,
  round(CASE WHEN n = 0 THEN 0e0 ELSE 5e0 * coalesce(shared, 0) / (8 + pw) / greatest(n, m) END, 6) AS score
FROM size LEFT JOIN best USING (query_id, variant)""",
)
def align_ordered(spark, folder):
    scores = B.bf_score(X.stored_months(spark, folder), ordered=True, dedup=False)
    return scores.select("query_id", "variant", F.round("score", 6).alias("score"))


# Rows left after equal ones are taken out, then a table over subsets of the prediction rows.
_UNORDERED_SQL = (
    X.PARTS_SQL.replace("WITH lines", "WITH RECURSIVE lines", 1)
    + """, counts AS (
  SELECT query_id, bag, any_value(marks) AS marks, COUNT(*) FILTER (side = 'p') AS cp, COUNT(*) FILTER (side = 'g') AS cg
  FROM marked GROUP BY query_id, bag),
equal AS (SELECT query_id, 3 * SUM(least(cp, cg)) AS equal FROM counts GROUP BY query_id),
left_p AS (SELECT query_id, marks, row_number() OVER (PARTITION BY query_id ORDER BY bag, k) - 1 AS i
  FROM (SELECT *, unnest(range(cp - least(cp, cg))) AS k FROM counts)),
left_g AS (SELECT query_id, marks, row_number() OVER (PARTITION BY query_id ORDER BY bag, k) - 1 AS j
  FROM (SELECT *, unnest(range(cg - least(cp, cg))) AS k FROM counts)),
w AS (SELECT p.query_id, i, j, len(list_intersect(p.marks, g.marks)) AS c FROM left_p p JOIN left_g g USING (query_id)),
moves AS (SELECT query_id, j, CAST(1 << i AS BIGINT) AS bit, c FROM w WHERE c > 0
  UNION ALL SELECT DISTINCT query_id, j, 0, 0 FROM w),
dp AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS mask, CAST(0 AS BIGINT) AS v FROM w
  UNION ALL
  SELECT dp.query_id, dp.j + 1, dp.mask | bit, CAST(MAX(v + c) AS BIGINT)
  FROM dp JOIN moves ON dp.query_id = moves.query_id AND dp.j = moves.j AND (dp.mask & bit) = 0
  GROUP BY dp.query_id, dp.j, dp.mask | bit),
inner_best AS (SELECT query_id, MAX(v) AS best FROM dp GROUP BY query_id)
"""
)


@add(
    "align_unordered",
    _UNORDERED_SQL
    + """SELECT query_id, 0 AS variant, CAST(equal + coalesce(best, 0) AS BIGINT) AS shared
FROM equal LEFT JOIN inner_best USING (query_id)""",
)
def align_unordered(spark, folder):
    results = X.stored_parts(spark, folder)
    return B.align_unordered(R.pair_sides(results, listed_pairs(results)))


# In MONTHS a prediction row shares cells with the expected row of its month only.
_PARTNER_CTE = """, w AS (
  SELECT p.query_id, g.variant, p.row_idx, g.row_idx AS partner, len(list_intersect(p.keys, g.keys)) AS c, len(p.keys) AS pw
  FROM pred p JOIN gold g USING (query_id)),
size AS (
  SELECT g.query_id, g.variant, g.m, coalesce(p.n, 0) AS n FROM (SELECT query_id, variant, COUNT(*) AS m FROM gold GROUP BY ALL) g
  LEFT JOIN (SELECT query_id, COUNT(*) AS n FROM pred GROUP BY ALL) p USING (query_id))
"""


@add(
    "match_assignment",
    X.MONTHS_SQL + _PARTNER_CTE
    + "SELECT query_id, variant, row_idx, coalesce(MAX(partner) FILTER (c > 0), -1) AS partner FROM w GROUP BY query_id, variant, row_idx",
)
def match_assignment(spark, folder):
    results = X.stored_months(spark, folder)
    return B.match_assignment(R.pair_sides(results, R.pair_list(results)))


@add(
    "bf_score",
    X.MONTHS_SQL + _PARTNER_CTE
    + """, s AS (SELECT query_id, variant, SUM(5.0 * c / (8 + pw)) AS total FROM w GROUP BY query_id, variant)
SELECT query_id, variant, round(coalesce(total, 0) / greatest(n, m), 6) AS score FROM size LEFT JOIN s USING (query_id, variant)""",
)
def bf_score(spark, folder):
    scores = B.bf_score(X.stored_months(spark, folder), dedup=False)
    return scores.select("query_id", "variant", F.round("score", 6).alias("score"))


@add(
    "large_result_flags",
    X.PARTS_SQL + "SELECT query_id, side, 0 AS variant, COUNT(*) AS n_rows FROM marked GROUP BY query_id, side HAVING COUNT(*) > 35",
)
def large_result_flags(spark, folder):
    return P.large_result_flags(X.parts(spark, folder), above=35)


# -- outcome and report ----------------------------------------------------------------------


def _outcomes(spark, folder):
    """Best variant per query with its difficulty; the last year stands for failed predictions."""
    base = stage(X.months_base(spark, folder), "months")
    scores = P.best_variant(P.score_results(stage(X.months(base), "results")))
    failed = F.col("year") == "2001"
    return (
        scores.join(X.months_meta(base), "query_id")
        .withColumn("success", ~failed)
        .withColumn("pred_error", F.when(failed, "No prediction provided"))
        .withColumn("gt_error", F.when(F.col("year") == "1995", F.concat(F.lit("GT execution failed: "), F.col("difficulty"))))
    )


_SCORES_SQL = _ORDERED_SQL + """, lists_p AS (SELECT query_id, list(keys ORDER BY row_idx) AS o, list_sort(list(enc)) AS u FROM pred GROUP BY query_id),
lists_g AS (SELECT query_id, variant, list(keys ORDER BY row_idx) AS o, list_sort(list(enc)) AS u FROM gold GROUP BY query_id, variant),
ex AS (
  SELECT query_id, variant, CASE WHEN p.o = g.o THEN 1e0 ELSE 0e0 END AS exo, CASE WHEN p.u = g.u THEN 1e0 ELSE 0e0 END AS exu
  FROM lists_g g LEFT JOIN lists_p p USING (query_id)),
sides AS (
  SELECT query_id, variant, p.keys AS p, g.keys AS g
  FROM (SELECT pairs.query_id, variant, row_idx, keys FROM pred JOIN pairs USING (query_id)) p FULL JOIN gold g USING (query_id, variant, row_idx)),
soft AS (
  SELECT query_id, variant,
         SUM(CASE WHEN p IS NULL OR g IS NULL THEN 0.0 ELSE len(list_filter(p, lambda x: list_contains(g, x))) / CAST(len(g) AS DOUBLE) END) AS hit,
         SUM(CASE WHEN g IS NULL THEN 1.0 WHEN p IS NULL THEN 0.0 ELSE len(list_filter(p, lambda x: NOT list_contains(g, x))) / CAST(len(g) AS DOUBLE) END) AS po,
         SUM(CASE WHEN g IS NULL THEN 0.0 WHEN p IS NULL THEN 1.0 ELSE len(list_filter(g, lambda x: NOT list_contains(p, x))) / CAST(len(g) AS DOUBLE) END) AS go
  FROM sides GROUP BY query_id, variant),
pair_w AS (SELECT p.query_id, g.variant, SUM(len(list_intersect(p.keys, g.keys))) AS c FROM pred p JOIN gold g USING (query_id) GROUP BY p.query_id, g.variant),
scores AS (
  SELECT ex.query_id, ex.variant, exo, exu,
         coalesce(2e0 * hit / nullif(2.0 * hit + po + go, 0), 0) AS sfo,
         CASE WHEN n = 0 THEN 0e0 ELSE 5e0 * coalesce(shared, 0) / (8 + pw) / greatest(n, m) END AS bfo,
         CASE WHEN n = 0 THEN 0e0 ELSE 5e0 * c / (8 + pw) / greatest(n, m) END AS bfu
  FROM ex JOIN soft USING (query_id, variant) JOIN size USING (query_id, variant) LEFT JOIN best USING (query_id, variant)
       LEFT JOIN pair_w USING (query_id, variant)),
picked AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exo DESC, variant) = 1),
outcomes AS (
  SELECT picked.*, difficulty, year <> '2001' AS success, year = '1995' AS gt_failed
  FROM picked JOIN (SELECT DISTINCT query_id, difficulty, year FROM base) USING (query_id))
"""


def _rounded(names):
    return [F.round(n, 6).alias(n) for n in names]


@add(
    "best_variant",
    _SCORES_SQL + "SELECT query_id, variant, " + ", ".join(f"round({m}, 6) AS {m}" for m in P.METRICS) + " FROM picked",
)
def best_variant(spark, folder):
    results = X.stored_months(spark, folder)
    return P.best_variant(P.score_results(results)).select("query_id", "variant", *_rounded(P.METRICS))


def _report_sql() -> str:
    columns = []
    for metric in P.METRICS:
        good = f"COUNT(*) FILTER (success AND {metric} >= 0.9999)"
        columns.append(f"{good} AS a_{metric}, round({good} / CAST(COUNT(*) AS DOUBLE), 6) AS rate_{metric}")
        columns.append(f"round(SUM(CASE WHEN success THEN {metric} ELSE 0 END) / COUNT(*), 6) AS mean_{metric}")
    return f"""SELECT CASE WHEN grouping(difficulty) = 1 THEN 'overall' ELSE difficulty END AS level, COUNT(*) AS n,
  COUNT(*) FILTER (success) AS c, round(COUNT(*) FILTER (success) / CAST(COUNT(*) AS DOUBLE), 6) AS compilable, {', '.join(columns)}
FROM outcomes GROUP BY GROUPING SETS ((difficulty), ())"""


@add("report_rollup", _SCORES_SQL + _report_sql())
def report_rollup(spark, folder):
    report = P.report_rollup(_outcomes(spark, folder))
    return report.select(*[F.round(c, 6).alias(c) if c.startswith(("rate", "mean", "comp")) else F.col(c) for c in report.columns])


@add("gt_failures", X.MONTHS_SQL + "SELECT DISTINCT query_id, 'GT execution failed: ' || difficulty AS error FROM base WHERE year = '1995'")
def gt_failures(spark, folder):
    base = X.months_base(spark, folder)
    outcomes = X.months_meta(base).withColumn(
        "gt_error", F.when(F.col("year") == "1995", F.concat(F.lit("GT execution failed: "), F.col("difficulty")))
    )
    return P.gt_failures(outcomes)


@add("failed_top10", X.MONTHS_SQL + "SELECT DISTINCT query_id, 'No prediction provided' AS pred_error FROM base WHERE year = '2001' ORDER BY query_id LIMIT 10")
def failed_top10(spark, folder):
    failed = F.col("year") == "2001"
    outcomes = X.months_meta(X.months_base(spark, folder)).select(
        "query_id", (~failed).alias("success"), F.when(failed, "No prediction provided").alias("pred_error")
    )
    return P.failed_top(outcomes)


@add(
    "score_table",
    _SCORES_SQL + ", r AS (SELECT CASE WHEN grouping(difficulty) = 1 THEN 'overall' ELSE difficulty END AS level, "
    + ", ".join(f"COUNT(*) FILTER (success AND {m} >= 0.9999) / CAST(COUNT(*) AS DOUBLE) AS {m}" for m in P.METRICS)
    + " FROM outcomes GROUP BY GROUPING SETS ((difficulty), ())), l AS (UNPIVOT r ON " + ", ".join(P.METRICS) + " INTO NAME metric VALUE rate)"
    + " SELECT metric, " + ", ".join(f"round(MAX(rate) FILTER (level = '{v}'), 6) AS {c}" for v, c in (("AFRICA", "africa"), ("ASIA", "asia"), ("overall", "overall")))
    + " FROM l GROUP BY metric",
)
def score_table(spark, folder):
    out = P.score_table(P.report_rollup(_outcomes(spark, folder)), ["AFRICA", "ASIA", "overall"])
    return out.select("metric", *[F.round(c, 6).alias(c.lower()) for c in ("AFRICA", "ASIA", "overall")])


@add(
    "classify_outcome",
    """
WITH e AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS query_id, o_orderpriority <> '1-URGENT' AS known,
         CASE WHEN o_orderstatus = 'P' THEN 'no such database' END AS database_error,
         CASE WHEN o_totalprice >= 50000 THEN 'SELECT 1' END AS pd_sql,
         CASE WHEN o_totalprice > 400000 THEN 'column not found' END AS run_error,
         c_acctbal > 0 AS gold_valid, CASE WHEN c_acctbal < -500 THEN 'GT execution failed: x' END AS gt_error
  FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (
  SELECT query_id, CASE WHEN pd_sql IS NULL THEN 'No prediction provided' WHEN NOT known THEN 'Query ID not found: ' || query_id
         WHEN database_error IS NOT NULL THEN 'DB resolution failed: ' || database_error WHEN run_error IS NOT NULL THEN run_error
         WHEN NOT gold_valid THEN coalesce(gt_error, 'No valid ground truth SQL') END AS pred_error FROM e)
SELECT query_id, pred_error IS NULL AS success, pred_error FROM o""",
)
def classify_outcome(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    entries = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("query_id"),
        (F.col("o_orderpriority") != "1-URGENT").alias("known"),
        F.when(F.col("o_orderstatus") == "P", "no such database").alias("database_error"),
        F.when(F.col("o_totalprice") >= 50000, "SELECT 1").alias("pd_sql"),
        F.when(F.col("o_totalprice") > 400000, "column not found").alias("run_error"),
        (F.col("c_acctbal") > 0).alias("gold_valid"),
        F.when(F.col("c_acctbal") < -500, "GT execution failed: x").alias("gt_error"),
    )
    return P.classify_outcome(entries).select("query_id", "success", "pred_error")


@add(
    "submission_join",
    """SELECT d.doc_id AS id, lang, CASE WHEN toxic = 1 THEN '' ELSE 'SELECT ' || quality END AS pd_sql
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def submission_join(spark, folder):
    questions = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "lang")
    submission = table(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") != 1, F.concat(F.lit("SELECT "), F.col("quality"))).alias("sql")
    )
    return P.submission_join(questions, submission)
