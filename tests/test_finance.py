"""Dense months, prior years and spans of months against plain Python."""

import datetime
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.operators import finance as A
from ledgerlens.plans.star import in_months


def test_dense_months(spark):
    rnd = random.Random(2)
    months = [f"{1999 + i // 12}{i % 12 + 1:02d}" for i in range(30)]
    held = {(m, k): Decimal(rnd.randrange(-500, 500)) for k in ("a", "b", None) for m in months[3:27] if rnd.random() < 0.4}
    frame = spark.createDataFrame([(m, k, v) for (m, k), v in held.items()], "period string, member string, amt decimal(28,4)")
    for bounds in ((months[0], months[-1]), None):
        span = months if bounds else months[months.index(min(m for m, _ in held)) : months.index(max(m for m, _ in held)) + 1]
        got = A.with_last_year_total(A.with_ytd(A.with_prior_year(A.dense(frame, ["member"], bounds=bounds), ["member"], ("amt",)), ["member"]), ["member"]).collect()
        assert len(got) == 3 * len(span)
        value = lambda m, k: held.get((m, k), 0) if m in span else None
        for r in got:
            m, k = r["period"], r["member"]
            before = f"{int(m[:4]) - 1}"
            assert r["amt"] == value(m, k) and r["amt_py"] == value(before + m[4:], k)
            assert r["ytd"] == sum(value(x, k) for x in span if x[:4] == m[:4] and x <= m)
            assert r["year_amt"] == (sum(value(x, k) for x in span if x[:4] == before) if before + "12" in span else None)
    assert A.dense(frame.limit(0), ["member"], bounds=("000102", "000101")).count() == 0
    assert A.dense(frame.limit(0), ["member"]).count() == 0


def test_year_before_skips_gaps(spark):
    rows = [("a", "1999", 1), ("a", "2000", 2), ("a", "2002", 4), ("b", "2000", 7)]
    got = A.with_year_before(spark.createDataFrame(rows, "member string, year string, amt int"), ["member"], "year", "amt", "before").collect()
    assert {(r["member"], r["year"]): r["before"] for r in got} == {("a", "1999"): None, ("a", "2000"): 1, ("a", "2002"): None, ("b", "2000"): None}


def test_spans_of_months(spark):
    days = [datetime.datetime(1999, 1, 1) + datetime.timedelta(days=i, seconds=86399 * (i % 2)) for i in range(800)]
    frame = spark.createDataFrame([(d,) for d in days], "d timestamp")
    for spans in ([("199911", "199912")], [("199902", "199902"), ("200001", "200011")], []):
        got = {r["m"] for r in frame.where(in_months(F.col("d"), spans)).select(F.date_format("d", "yyyyMM").alias("m")).collect()}
        assert got == {f"{d:%Y%m}" for d in days if any(a <= f"{d:%Y%m}" <= b for a, b in spans)}
        n = frame.where(in_months(F.col("d"), spans)).count()
        assert n == sum(any(a <= f"{d:%Y%m}" <= b for a, b in spans) for d in days)


def test_groups_of_groups(spark):
    bridge = [("a", "1"), ("a", "b"), ("b", "2"), ("b", "c"), ("c", "3"), ("c", "a"), ("d", "3"), ("d", "d"), ("e", "1"), ("e", "1")]
    got = A.expand_groups(spark.createDataFrame(bridge, "grp string, member string")).collect()
    assert sorted(map(tuple, got)) == [(g, m) for g in "abc" for m in "123"] + [("d", "3"), ("e", "1")]
    assert A.expand_groups(spark.createDataFrame([], "grp string, member string")).count() == 0


def test_numbers_by_rank(spark):
    from ledgerlens.operators.rows import rank_index

    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, 3]), rnd.randrange(2**50), i) for i in range(3000)]
    got = rank_index(spark.createDataFrame(rows, "a int, b bigint, i int").repartition(7), [F.col("a"), F.col("b"), F.col("i")]).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["row_idx"])] == [i for _, _, i in sorted(rows)]
    assert sorted(r["row_idx"] for r in got) == list(range(3000))
    assert rank_index(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


def test_growth_that_lasts(spark):
    rnd = random.Random(5)
    quarters = [f"{1999 + i // 4}Q{i % 4 + 1}" for i in range(11)]
    held = {m: [Decimal(rnd.choice([0, 1, 2])) * 10 ** rnd.choice([0, i // 2, i]) for i in range(11)] for m in range(200)}
    held[900], held[901] = [Decimal(2) ** i for i in range(11)], [Decimal(100) + i for i in range(11)]
    frame = spark.createDataFrame([(m, q, v) for m, vs in held.items() for q, v in zip(quarters, vs)], "member int, quarter string, amt decimal(28,4)")
    for at in (9, 3, 10):
        want = {}
        for m, vs in held.items():
            i = at
            while i > 0 and vs[i - 1] != 0 and (vs[i] - vs[i - 1]) / vs[i - 1] > Decimal("0.1"):
                i -= 1
            if at - i >= 3:
                want[m] = (quarters[i + 1], at - i, vs[i], vs[at])
        got = {r["member"]: (r["since"], r["n_quarters"], r["amt_before"], r["amt"]) for r in A.lasting_stars(frame, ["member"], quarters[at]).collect()}
        assert got == want and 900 in got and 901 not in got
    assert A.lasting_stars(frame, ["member"], "2001Q4").count() == 0  # beyond the data
    assert [A.closed_quarter(d) for d in ("2000-08-15", "2000-09-30", "2000-01-01", "2000-12-31")] == ["2000Q2", "2000Q3", "1999Q4", "2000Q4"]
    assert A.last_month("2000Q2") == "200006"


def test_forms_of_the_double_factor(spark):
    rows = [("a", "1999", 10, 4, 5, 1, 2), ("a", "2000", 20, 6, 7, 2, 3), ("b", "1999", 8, 0, 3, 0, 1), ("b", "2000", 9, 0, 4, 0, 1), ("c", "2000", 9, 9, 9, 9, 9)]
    names = ("rev_eq", "rev_sv", "cost_eq", "cost_sv", "tax")
    frame = spark.createDataFrame(rows, "member string, year string, " + ", ".join(f"{n} int" for n in names))
    years = A.two_years(A.factor_forms(frame, ["member", "year"]), ["form", "member"], "year", "2000")
    held = {(r["form"], r["member"]): tuple(int(r[c]) for c in ("rev", "rev_py", "cost", "cost_py")) for r in years.collect()}
    assert held == {
        ("total", "a"): (26, 14, 12, 8), ("sales", "a"): (26, 14, 9, 6), ("equipment", "a"): (20, 10, 7, 5), ("service", "a"): (6, 4, 2, 1),
        ("total", "b"): (9, 8, 5, 4), ("sales", "b"): (9, 8, 4, 3), ("equipment", "b"): (9, 8, 4, 3), ("service", "b"): (0, 0, 0, 0),
    }
    out = {(r["form"], r["member"]): r for r in A.double_factor(years, ["form"], "member").collect()}
    a = out["equipment", "a"]
    assert abs(a["structure"] - (20 / 29 - 10 / 18) * (0.5 - 10 / 18)) < 1e-12 and abs(a["margin"] - 20 / 29 * (13 / 20 - 0.5)) < 1e-12
    assert out["service", "b"]["compound"] is None
