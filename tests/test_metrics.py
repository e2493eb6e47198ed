import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import bipartite as B
from ledgerlens.operators import exact as E
from ledgerlens.operators import report as P
from ledgerlens.operators import rows as R
from ledgerlens.operators import soft as S
from tests.helpers import best_free, best_ordered, expected, overlap, results, soft


def random_cases(rng, count, most=5):
    def rows(n):
        return [tuple(rng.choice([1, 2, 3, None]) for _ in range(2)) for _ in range(n)]

    return {f"q{k}": (rows(rng.randint(0, most)), [rows(rng.randint(0, most))]) for k in range(count)}


def test_all_metrics_against_brute_force(spark):
    cases = random_cases(random.Random(3), 80)
    rows, pairs = results(spark, cases, ["int", "int"])
    scores = {r["query_id"]: r for r in P.score_results(rows, pairs).collect()}
    assert len(scores) == len(cases)
    for query, (p, (g,)) in cases.items():
        got = [scores[query][m] for m in P.METRICS]
        assert got == pytest.approx(expected(p, g)), (query, p, g)
        assert all(0.0 <= v <= 1.0 + 1e-9 for v in got)
        assert scores[query]["bfu"] >= scores[query]["bfo"] - 1e-9
        assert scores[query]["exu"] == 0.0 or scores[query]["bfu"] == pytest.approx(1.0)


def test_dedup_scores_equal_scores_of_distinct_rows(spark):
    cases = random_cases(random.Random(5), 40)

    def ordered(rows):
        return list(dict.fromkeys(rows))

    def bags(rows):
        return list({tuple(sorted(r, key=str)): r for r in reversed(rows)}.values())[::-1]

    rows, pairs = results(spark, cases, ["int", "int"])
    scores = {r["query_id"]: r for r in P.score_results(rows, pairs, dedup=True).collect()}
    for query, (p, (g,)) in cases.items():
        got = scores[query]
        assert got["exo"] == float(ordered(p) == ordered(g))
        assert got["sfo"] == pytest.approx(soft(ordered(p), ordered(g), 1.0))
        assert got["exu"] == float({tuple(sorted(r, key=lambda x: (str(type(x)), str(x)))) for r in p} == {tuple(sorted(r, key=lambda x: (str(type(x)), str(x)))) for r in g})
        first = {}
        for r in p:
            first.setdefault(tuple(sorted(r, key=str)), r)
        first_g = {}
        for r in g:
            first_g.setdefault(tuple(sorted(r, key=str)), r)
        assert got["bfu"] == pytest.approx(expected(list(first.values()), list(first_g.values()))[4])


def test_assignment_reaches_the_best_overlap(spark):
    cases = random_cases(random.Random(11), 40)
    rows, pairs = results(spark, cases, ["int", "int"])
    best = {r["query_id"]: r["shared"] for r in B.align_unordered(R.pair_sides(rows, pairs)).collect()}
    sums, used = {}, set()
    for r in B.match_assignment(R.pair_sides(rows, pairs)).collect():
        p, (g,) = cases[r["query_id"]]
        if r["partner"] >= 0:
            assert (r["query_id"], r["partner"]) not in used
            used.add((r["query_id"], r["partner"]))
            sums[r["query_id"]] = sums.get(r["query_id"], 0) + overlap(p[r["row_idx"]], g[r["partner"]])
    assert {q: s for q, s in best.items() if s} == {q: s for q, s in sums.items() if s}


def test_documented_examples(spark):
    two = [(1, 2), (3, 4)]
    rows, pairs = results(spark, {"q": (two, [two])}, ["int", "int"])
    assert E.ex_match(rows, pairs).first()["score"] == 1.0
    assert B.bf_score(rows, pairs).first()["score"] == 1.0
    rows, pairs = results(spark, {"q": ([(1, 2)], [[(1, 3)]])}, ["int", "int"])
    assert S.soft_fbeta(rows, pairs).first()["score"] == pytest.approx(0.5)


def test_soft_membership_counts_repeats(spark):
    """(1, 1, 1) against (1, 2): three hits over width two."""
    frame = spark.sql("SELECT array('1', '1', '1') AS p, array('1', '2') AS g")
    got = frame.select(S.soft_row_match(F.col("p"), F.col("g")).alias("s")).first()["s"]
    assert (got["hit"], got["p_only"], got["g_only"]) == (1.5, 0.0, 0.5)


def test_unordered_soft_score_is_refused(spark):
    rows, pairs = results(spark, {"q": ([(1,)], [[(1,)]])}, ["int"])
    with pytest.raises(ValueError):
        S.soft_fbeta(rows, pairs, ordered=False)


def test_empty_prediction(spark):
    cases = {"one": ([], [[(1,)]]), "three": ([], [[(1,), (2,), (3,)]]), "none": ([], [[]])}
    rows, pairs = results(spark, cases, ["int"])
    plain = {r["query_id"]: r["score"] for r in B.bf_score(rows, pairs, ordered=True, dedup=False).collect()}
    legacy = {r["query_id"]: r["score"] for r in B.bf_score(rows, pairs, ordered=True, dedup=False, legacy_empty=True).collect()}
    assert plain == {"one": 0.0, "three": 0.0, "none": 1.0}
    assert legacy == {"one": 1.0, "three": pytest.approx(1 / 3), "none": 1.0}


def test_size_switches_no_metric(spark):
    p = [(i,) for i in range(1001)]
    g = [(i if i % 3 else -1,) for i in range(1001)]
    rows, pairs = results(spark, {"big": (p, [g]), "small": (p[:5], [g[:5]])}, ["int"])
    scores = {r["query_id"]: r for r in P.score_results(rows, pairs).collect()}
    assert scores["big"]["bfu"] == pytest.approx(667 / 1001)
    assert scores["small"]["bfu"] == pytest.approx(expected(p[:5], g[:5])[4])
    assert [r["query_id"] for r in P.large_result_flags(rows).collect()] == ["big", "big"]


def test_spread_pairs_score_as_much(spark):
    """The matching over many tasks and the one in a single task give equal sums, copies and one-sided rows included."""
    rng = random.Random(11)
    cases = random_cases(rng, 12, most=9)
    rows, pairs = results(spark, cases, ["int", "int"])
    sided = R.pair_sides(rows, pairs)
    for spread in (B.SPREAD, 0):
        got = {r["query_id"]: r["shared"] for r in B.align_unordered(sided, spread=spread).collect()}
        partner = {(r["query_id"], r["row_idx"]): r["partner"] for r in B.match_assignment(sided, spread=spread).collect()}
        for query, (p, (g,)) in cases.items():
            assert got.get(query, 0) == best_free(p, g), (query, p, g)
            mine = [partner[query, i] for i in range(len(p))]
            taken = [j for j in mine if j >= 0]
            assert len(set(taken)) == len(taken) and sum(overlap(p[i], g[j]) for i, j in enumerate(mine) if j >= 0) == best_free(p, g)


def test_mixed_widths(spark):
    schema = "query_id string, side string, variant int, row_idx bigint, a int, b int"
    wide = R.norm_cells(spark.createDataFrame([("q", "p", 0, 0, 1, 9)], schema), ["a", "b"])
    narrow = R.norm_cells(spark.createDataFrame([("q", "g", 0, 0, 1, 0)], schema), ["a"])
    score = P.score_results(wide.unionByName(narrow)).first()
    assert score["bfu"] == score["bfo"] == pytest.approx(5 * 1 / (4 * 1 + 2))
    assert score["exu"] == 0.0


def test_best_variant_keeps_the_first_of_equals(spark):
    same, other = [(1, 2)], [(2, 1)]
    cases = {"a": (same, [other, same]), "b": (same, [[(5, 6)], other])}
    rows, pairs = results(spark, cases, ["int", "int"])
    picked = {r["query_id"]: r for r in P.best_variant(P.score_results(rows, pairs)).collect()}
    assert (picked["a"]["variant"], picked["a"]["exo"]) == (1, 1.0)
    assert (picked["b"]["variant"], picked["b"]["bfu"]) == (0, 0.0)
    highest = {r["query_id"]: r for r in P.best_variant(P.score_results(rows, pairs), best="max").collect()}
    assert highest["b"]["bfu"] == 1.0


def test_report(spark):
    rows = [("a", "simple", True, 1.0, 1.0, 1.0, 1.0, 1.0), ("b", "simple", False, 0.0, 0.0, 0.0, 0.0, 0.0), ("c", None, True, 0.0, 1.0, 0.5, 0.5, 0.99995)]
    schema = "query_id string, difficulty string, success boolean, exo double, exu double, sfo double, bfo double, bfu double"
    report = {r["level"]: r for r in P.report_rollup(spark.createDataFrame(rows, schema)).collect()}
    assert set(report) == {"simple", "unknown", "overall"}
    assert (report["overall"]["n"], report["overall"]["c"], report["overall"]["a_bfu"]) == (3, 2, 2)
    assert report["simple"]["rate_exo"] == 0.5
    assert report["overall"]["mean_sfo"] == pytest.approx(0.5)


def test_one_hot_query_is_spread(spark):
    """A third and more of all rows belong to one query; order, copies and counts stay exact."""
    n = 150_000
    hot = spark.range(n).select(F.lit("hot").alias("query_id"), F.col("id").alias("row_idx"), (F.col("id") % 1000).cast("int").alias("v"))
    cold = spark.range(20_000).select(F.concat(F.lit("c"), (F.col("id") % 500)).alias("query_id"), F.floor(F.col("id") / 500).alias("row_idx"), F.col("id").cast("int").alias("v"))
    both = hot.unionByName(cold).withColumn("variant", F.lit(0))
    p = both.withColumn("side", F.lit("p"))
    g = both.withColumn("side", F.lit("g")).withColumn("v", F.when((F.col("query_id") == "hot") & (F.col("row_idx") == 77_777), -1).otherwise(F.col("v")))
    rows = R.norm_cells(p.unionByName(g), ["v"])
    scores = {r["query_id"]: r for r in P.score_results(rows).collect()}
    assert len(scores) == 501
    assert scores["hot"]["exo"] == 0.0 and scores["hot"]["exu"] == 0.0
    assert scores["hot"]["sfo"] == pytest.approx((n - 1) / n)
    assert all(s["exo"] == 1.0 and s["bfo"] == 1.0 and s["bfu"] == 1.0 for q, s in scores.items() if q != "hot")
    kept = R.dedup_rows(rows.where("query_id = 'hot' AND side = 'p'")).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in kept] == list(range(1000))
    assert kept[17]["cells"][0]["key"] == "n17"


def test_long_pairs_are_aligned_exactly(spark):
    """1,001 rows and more: nothing is dropped, and no other metric is taken."""
    g = [(i, i % 7) for i in range(1001)]
    p = g[1:] + [(-1, -1)]
    rows, pairs = results(spark, {"big": (p, [g]), "short": (p[:3], [g[:3]])}, ["int", "int"])
    sided = R.pair_sides(rows, pairs)
    shared = {f.__name__: {r["query_id"]: r["shared"] for r in f(sided).collect()} for f in (B.align_ordered, B.align_unordered)}
    assert shared == {"align_ordered": {"big": 2000, "short": 4}, "align_unordered": {"big": 2000, "short": 4}}
    for ordered in (True, False):
        scores = {r["query_id"]: r["score"] for r in B.bf_score(rows, pairs, ordered=ordered, dedup=False).collect()}
        assert scores == {"big": pytest.approx(1000 / 1001), "short": pytest.approx(2 / 3)}
    full = {r["query_id"]: r for r in P.score_results(rows, pairs).collect()}["big"]
    assert full["bfo"] == full["bfu"] == pytest.approx(1000 / 1001)
    weights = {r["row_idx"]: r["weights"] for r in B.pair_weights(rows, pairs).where("query_id = 'big'").collect()}
    assert len(weights) == 1001 and weights[17][18] == 1.0 and all(len(w) == 1001 for w in weights.values())
    partner = {r["row_idx"]: r["partner"] for r in B.match_assignment(sided).where("query_id = 'big'").collect()}
    assert [partner[i] for i in range(1001)] == [*range(1, 1001), -1]


def test_ordered_blocks_against_the_plain_recurrence(spark):
    rng = random.Random(5)
    cases = random_cases(rng, 30, most=11)
    rows, pairs = results(spark, cases, ["int", "int"])
    got = {r["query_id"]: r["shared"] for r in B.align_ordered(R.pair_sides(rows, pairs), block=2).collect()}
    assert len(got) > 20
    for query, shared in got.items():
        p, (g,) = cases[query]
        assert shared == best_ordered(p, g), (query, p, g)
