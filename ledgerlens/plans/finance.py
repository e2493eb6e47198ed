"""Registered queries: financial analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators import finance as A
from ledgerlens.plans.registry import Registry
from ledgerlens.plans.star import FACT_SQL, MONEY, month_bounds, monthly, revenue
from ledgerlens.session import shared_dir, stage
from ledgerlens.sources.tables import table

registry = Registry()
add = registry.add

# Exchange rates of the test data, per US dollar.
RATES = {"USD": 1.0, "CNY": 7.0, "EUR": 0.9}

# Country and region groups by name.
REGION_GROUPS = {
    "G7": ("United States", "Canada", "Japan", "Germany", "France", "United Kingdom", "Italy"),
    "G20": (
        "United States", "Canada", "Brazil", "Argentina", "United Kingdom", "Germany", "France", "Italy", "Russia", "China",
        "Japan", "India", "South Korea", "Australia", "Saudi Arabia", "South Africa",
    ),
    "BRICS": ("Brazil", "Russia", "India", "China", "South Africa"),
    "Europe": ("Germany", "United Kingdom", "France", "Netherlands", "Ireland", "Denmark", "Finland", "Italy", "Russia"),
    "EU": ("Germany", "France", "Netherlands", "Ireland", "Denmark", "Finland", "Italy"),
    "Arab": ("Egypt", "Saudi Arabia", "United Arab Emirates"),
    "Commonwealth": ("United Kingdom", "Canada", "Australia", "India", "South Africa"),
    "East Asia": ("Japan", "South Korea", "India"),
    "China Coast": ("Guangdong", "Shanghai", "Tianjin"),
    "US West Coast": ("California", "Washington"),
}


def money(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


def change(a: str, b: str) -> str:
    return ratio(f"({a} - {b})", b)


def grouped(dims: str, extra: str = "") -> str:
    """Months per member, as a common table ``m``."""
    return FACT_SQL + f", m AS (SELECT period, {dims}, SUM(rev) AS amt{extra} FROM fact GROUP BY period, {dims})"


def spine_sql(dims: str) -> str:
    """``d``: every month of the range for every member, ``y``: with the year-to-date value."""
    return f"""
, months AS (SELECT strftime(unnest(generate_series(strptime(MIN(period), '%Y%m'), strptime(MAX(period), '%Y%m'), INTERVAL 1 MONTH)), '%Y%m') AS period FROM m),
d AS (SELECT period, {dims}, coalesce(amt, 0) AS amt FROM months CROSS JOIN (SELECT DISTINCT {dims} FROM m) LEFT JOIN m USING (period, {dims})),
y AS (SELECT *, SUM(amt) OVER (PARTITION BY {dims}, period[1:4] ORDER BY period) AS ytd FROM d)"""


_BEFORE = "strftime(strptime({p}, '%Y%m') - INTERVAL 1 YEAR, '%Y%m')"


def dense(spark, folder, dims):
    """Monthly revenue with all months of the fact table."""
    return A.dense(revenue(spark, folder, dims), dims, bounds=month_bounds(spark, folder))


def quarterly(spark, folder, dims):
    return A.quarterly(revenue(spark, folder, dims), dims, month_bounds(spark, folder))


# -- periods ---------------------------------------------------------------------------------


@add("ptd_monthly", FACT_SQL + "SELECT period, n_name, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact GROUP BY period, n_name")
def ptd_monthly(spark, folder):
    return revenue(spark, folder, ["n_name"]).select("period", "n_name", *money("amt"))


@add(
    "ytd_cumulative",
    grouped("c_custkey") + spine_sql("c_custkey") + "SELECT period, c_custkey, CAST(amt AS DOUBLE) AS amt, CAST(ytd AS DOUBLE) AS ytd FROM y",
)
def ytd_cumulative(spark, folder):
    months = dense(spark, folder, ["c_custkey"])
    return A.with_ytd(months, ["c_custkey"]).select("period", "c_custkey", *money("amt", "ytd"))


@add(
    "prior_year",
    grouped("p_name") + spine_sql("p_name")
    + f"""SELECT a.period, a.p_name, CAST(a.amt AS DOUBLE) AS amt, CAST(b.amt AS DOUBLE) AS amt_py, CAST(a.ytd AS DOUBLE) AS ytd, CAST(b.ytd AS DOUBLE) AS ytd_py
FROM y a LEFT JOIN y b ON a.p_name = b.p_name AND b.period = {_BEFORE.format(p='a.period')}""",
)
def prior_year(spark, folder):
    ytd = A.with_ytd(dense(spark, folder, ["p_name"]), ["p_name"])
    both = A.with_prior_year(ytd, ["p_name"], ("amt", "ytd"))
    return both.select("period", "p_name", *money("amt", "amt_py", "ytd", "ytd_py"))


@add(
    "quarterly_from_ytd",
    grouped("n_name") + spine_sql("n_name")
    + """SELECT n_name, period[1:4] || 'Q' || CAST(ceil(CAST(period[5:6] AS INTEGER) / 3.0) AS INTEGER) AS quarter, CAST(SUM(amt) AS DOUBLE) AS amt
FROM d GROUP BY ALL HAVING COUNT(*) = 3""",
)
def quarterly_from_ytd(spark, folder):
    return quarterly(spark, folder, ["n_name"]).select("n_name", "quarter", *money("amt"))


@add(
    "half_yearly",
    grouped("n_name") + spine_sql("n_name")
    + """SELECT n_name, period[1:4] AS year, CAST(CASE WHEN COUNT(*) >= 6 THEN SUM(amt) FILTER (period[5:6] <= '06') END AS DOUBLE) AS h1,
CAST(CASE WHEN COUNT(*) = 12 THEN SUM(amt) FILTER (period[5:6] > '06') END AS DOUBLE) AS h2 FROM d GROUP BY ALL""",
)
def half_yearly(spark, folder):
    halves = A.half_yearly(revenue(spark, folder, ["n_name"]), ["n_name"], month_bounds(spark, folder))
    return halves.select("n_name", "year", *money("h1", "h2"))


_ASKED = "strftime(o_orderdate + INTERVAL 18 MONTH, '%Y%m')"


@add(
    "period_guard",
    f"""WITH b AS (SELECT strftime(MIN(l_shipdate), '%Y%m') AS lo, strftime(MAX(l_shipdate), '%Y%m') AS hi FROM lineitem)
SELECT o_orderkey, {_ASKED} AS asked, CASE WHEN {_ASKED} < lo OR {_ASKED} > hi OR {_ASKED} > '200201' THEN 'Date out of range' END AS Message
FROM orders, b""",
)
def period_guard(spark, folder):
    data = table(spark, folder, "lineitem").select(F.date_format("l_shipdate", "yyyyMM").alias("period"))
    asked = table(spark, folder, "orders").select(
        "o_orderkey",
        F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 18), "yyyyMM").alias("asked"),
        F.lit("200201").alias("query_time"),
    )
    return A.period_guard(asked, data, query_time="query_time").select("o_orderkey", "asked", "Message")


@add(
    "query_time_cutoff",
    FACT_SQL + "SELECT c_custkey, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact WHERE period BETWEEN '199801' AND '199808' GROUP BY c_custkey",
)
def query_time_cutoff(spark, folder):
    first, last, now = "199801", "199812", "199808"
    months = A.cutoff(revenue(spark, folder, ["c_custkey"], [(first, min(last, now))]), first, last, now)
    return A.total(months, ["c_custkey"]).select("c_custkey", *money("amt"))


# -- currency, caliber, table shapes ---------------------------------------------------------


@add(
    "currency_convert",
    """
WITH o AS (
  SELECT l_orderkey, CASE WHEN bool_and(cr.r_name = 'ASIA' AND sr.r_name = 'ASIA') THEN 'CNY'
           WHEN bool_and(cr.r_name = 'EUROPE' AND sr.r_name = 'EUROPE') THEN 'EUR' ELSE 'USD' END AS currency,
         SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(3,2))) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
       JOIN region cr ON cn.n_regionkey = cr.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
       JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  GROUP BY l_orderkey)
SELECT l_orderkey, currency, round(CAST(amt AS DOUBLE) * CASE currency WHEN 'CNY' THEN 7e0 WHEN 'EUR' THEN 9e-1 ELSE 1e0 END, 4) AS amt FROM o""",
)
def currency_convert(spark, folder):
    regions = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    suppliers = (
        table(spark, folder, "supplier")
        .join(regions, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("r_name").alias("sold"))
    )
    customers = (
        table(spark, folder, "customer")
        .join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("r_name").alias("bought"))
    )
    value = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(3,2)")
    lines = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_suppkey", value.alias("value"))
        .groupBy("l_orderkey", "l_suppkey")
        .agg(F.sum("value").cast(MONEY).alias("value"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey")
        .agg(
            F.bool_and(F.col("sold") == "ASIA").alias("asia"),
            F.bool_and(F.col("sold") == "EUROPE").alias("europe"),
            F.sum("value").cast(MONEY).alias("value"),
        )
    )
    buyers = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "bought")
    asked = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(
        A.default_currency(F.col("asia") & (F.col("bought") == "ASIA"), F.col("europe") & (F.col("bought") == "EUROPE")).alias("currency"),
        F.sum("value").alias("amt"),
    )
    rates = spark.createDataFrame(list(RATES.items()), "currency string, rate double")
    return asked.join(F.broadcast(rates), "currency").select(
        "l_orderkey", "currency", F.round(F.col("amt").cast("double") * F.col("rate"), 4).alias("amt")
    )


_CALIBER_SQL = FACT_SQL + """, m AS (SELECT period, n_name, coalesce(SUM(rev) FILTER (eq), 0) AS eq, coalesce(SUM(rev) FILTER (NOT eq), 0) AS sv FROM fact GROUP BY period, n_name)"""


@add(
    "caliber_b",
    _CALIBER_SQL
    + """SELECT period, n_name, CAST(eq AS DOUBLE) AS eq_a, CAST(sv AS DOUBLE) AS sv_a, CAST(eq + CAST(sv AS DECIMAL(28,4)) * CAST(0.05 AS DECIMAL(3,2)) AS DOUBLE) AS eq_b,
CAST(sv - CAST(sv AS DECIMAL(28,4)) * CAST(0.05 AS DECIMAL(3,2)) AS DOUBLE) AS sv_b FROM m""",
)
def caliber_b(spark, folder):
    months = monthly(spark, folder, ["n_name"])
    equipment, service = A.caliber_b(F.col("rev_eq"), F.col("rev_sv"))
    return months.select(
        "period",
        "n_name",
        F.col("rev_eq").cast("double").alias("eq_a"),
        F.col("rev_sv").cast("double").alias("sv_a"),
        equipment.cast("double").alias("eq_b"),
        service.cast("double").alias("sv_b"),
    )


def _wide(spark, folder):
    months = monthly(spark, folder, ["n_name"])
    both, equipment = (F.col("rev_eq") + F.col("rev_sv")).cast(MONEY), F.col("rev_eq")
    yuan = F.lit(int(RATES["CNY"])).cast("decimal(3,0)")
    return months.select(
        "period",
        "n_name",
        both.cast("double").alias("amt_usd_a"),
        (both * yuan).cast("double").alias("amt_cny_a"),
        equipment.cast("double").alias("amt_usd_b"),
        (equipment * yuan).cast("double").alias("amt_cny_b"),
    )


_WIDE_SQL = _CALIBER_SQL + """, wide AS (SELECT period, n_name, CAST(eq + sv AS DOUBLE) AS amt_usd_a, CAST((eq + sv) * 7 AS DOUBLE) AS amt_cny_a,
  CAST(eq AS DOUBLE) AS amt_usd_b, CAST(eq * 7 AS DOUBLE) AS amt_cny_b FROM m)"""


@add(
    "wide_to_long",
    _WIDE_SQL
    + """SELECT period, n_name, 'USD' AS currency, 'A' AS caliber, amt_usd_a AS amt FROM wide UNION ALL SELECT period, n_name, 'CNY', 'A', amt_cny_a FROM wide
UNION ALL SELECT period, n_name, 'USD', 'B', amt_usd_b FROM wide UNION ALL SELECT period, n_name, 'CNY', 'B', amt_cny_b FROM wide""",
)
def wide_to_long(spark, folder):
    return A.wide_to_long(_wide(spark, folder), ["period", "n_name"])


@add("long_to_wide", _WIDE_SQL + "SELECT * FROM wide")
def long_to_wide(spark, folder):
    keys = ["period", "n_name"]
    return A.long_to_wide(A.wide_to_long(_wide(spark, folder), keys), keys, ["usd_a", "cny_a", "usd_b", "cny_b"])


@add(
    "view_income",
    FACT_SQL + "SELECT period, r_name, c_mktsegment, p_type, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact GROUP BY ALL",
)
def view_income(spark, folder):
    dims = ["r_name", "c_mktsegment", "p_type"]
    return revenue(spark, folder, dims).select("period", *dims, *money("amt"))


_PLAN_SQL = grouped("p_type, r_name") + spine_sql("p_type, r_name") + f""", yearly AS (
  SELECT p_type, r_name, period[1:4] AS year, SUM(amt) AS amt, COUNT(*) AS n FROM d GROUP BY ALL),
plan AS (
  SELECT y.period, y.p_type, y.r_name, y.amt, y.ytd, CAST(y.ytd AS DOUBLE) * 12 / CAST(y.period[5:6] AS INTEGER) AS forecast,
         CAST(u.amt AS DOUBLE) * 1.05 AS budget, CAST(b.amt AS DOUBLE) * 1.05 AS target
  FROM y LEFT JOIN yearly u ON u.p_type = y.p_type AND u.r_name = y.r_name AND CAST(u.year AS INTEGER) = CAST(y.period[1:4] AS INTEGER) - 1
         LEFT JOIN d b ON b.p_type = y.p_type AND b.r_name = y.r_name AND b.period = {_BEFORE.format(p='y.period')})
"""


def budget_view(spark, folder):
    """Amount, forecast, budget and target per month. Budget: last year's total times 1.05, repeated
    each month. Target: last year's month times 1.05. Forecast: the year as run so far."""
    dims = ["p_type", "r_name"]
    ytd = A.with_last_year_total(A.with_ytd(dense(spark, folder, dims), dims), dims)
    return A.with_prior_year(ytd, dims, ("amt",)).select(
        "period",
        *dims,
        "amt",
        "ytd",
        (F.col("ytd").cast("double") * 12 / A.month_of(F.col("period"))).alias("forecast"),
        (F.col("year_amt").cast("double") * 1.05).alias("budget"),
        (F.col("amt_py").cast("double") * 1.05).alias("target"),
    )


@add(
    "view_budget_forecast",
    _PLAN_SQL + "SELECT period, p_type, r_name, CAST(amt AS DOUBLE) AS amt, round(forecast, 3) AS forecast, round(budget, 3) AS budget, round(target, 3) AS target FROM plan",
)
def view_budget_forecast(spark, folder):
    rounded = [F.round(c, 3).alias(c) for c in ("forecast", "budget", "target")]
    return budget_view(spark, folder).select("period", "p_type", "r_name", *money("amt"), *rounded)


@add(
    "view_profit_loss",
    FACT_SQL + """SELECT period, r_name, c_mktsegment, p_type, CAST(SUM(rev) AS DOUBLE) AS revenue, CAST(SUM(cost) AS DOUBLE) AS cost, CAST(SUM(tax) AS DOUBLE) AS tax
FROM fact GROUP BY ALL""",
)
def view_profit_loss(spark, folder):
    dims = ["r_name", "c_mktsegment", "p_type"]
    months = monthly(spark, folder, dims, cost=True)
    return months.select(
        "period",
        *dims,
        (F.col("rev_eq") + F.col("rev_sv")).cast("double").alias("revenue"),
        (F.col("cost_eq") + F.col("cost_sv")).cast("double").alias("cost"),
        *money("tax"),
    )


@add(
    "view_sales_ledger",
    FACT_SQL + """SELECT l_orderkey, period, c_custkey, s_name, p_brand, CAST(rev AS DOUBLE) AS amt, eq FROM fact WHERE l_returnflag <> 'R'""",
)
def view_sales_ledger(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_returnflag <> 'R'").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        F.date_format("l_shipdate", "yyyyMM").alias("period"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(3,2)")).cast("double").alias("amt"),
        (F.col("l_linestatus") == "F").alias("eq"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "period", "c_custkey", "s_name", "p_brand", "amt", "eq")
    )


@add(
    "division_tables",
    FACT_SQL + "SELECT period, n_name, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact WHERE p_type = 'PROMO' GROUP BY ALL",
)
def division_tables(spark, folder):
    """One folder per division; reading a division prunes the others."""
    path = shared_dir(spark, "income")
    revenue(spark, folder, ["p_type", "n_name"]).write.partitionBy("p_type").parquet(path)
    return spark.read.parquet(path).where(F.col("p_type") == "PROMO").select("period", "n_name", *money("amt"))


@add(
    "all_division_tables",
    FACT_SQL + "SELECT p_type, period, n_name, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact GROUP BY ALL",
)
def all_division_tables(spark, folder):
    """The folders of all divisions, with their key."""
    path = shared_dir(spark, "income")
    revenue(spark, folder, ["p_type", "n_name"]).write.partitionBy("p_type").parquet(path)
    kept = spark.read.schema("period string, n_name string, amt decimal(28,4), p_type string").parquet(path)
    return kept.select("p_type", "period", "n_name", *money("amt"))


# -- members ---------------------------------------------------------------------------------


@add(
    "hierarchy_rollup",
    FACT_SQL + """SELECT r_name, n_name, year, CAST(grouping(r_name) * 2 + grouping(n_name) AS BIGINT) AS level, CAST(SUM(rev) AS DOUBLE) AS amt
FROM fact GROUP BY GROUPING SETS ((r_name, n_name, year), (r_name, year), (year))""",
)
def hierarchy_rollup(spark, folder):
    months = revenue(spark, folder, ["r_name", "n_name"]).withColumn("year", A.year_of(F.col("period")))
    sets = [["r_name", "n_name", "year"], ["r_name", "year"], ["year"]]
    level = F.grouping("r_name").cast("bigint") * 2 + F.grouping("n_name")
    return months.groupingSets(sets, "r_name", "n_name", "year").agg(
        level.cast("bigint").alias("level"), F.sum("amt").cast("double").alias("amt")
    )


def yearly(spark, folder, member):
    months = revenue(spark, folder, [member]).withColumn("year", A.year_of(F.col("period")))
    return A.total(months, [member, "year"])


def yearly_sql(member: str) -> str:
    return FACT_SQL + f", t AS (SELECT {member}, year, SUM(rev) AS amt FROM fact GROUP BY ALL)"


@add(
    "top_bottom_n",
    yearly_sql("c_custkey") + """, s AS (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY amt DESC, c_custkey) AS up, row_number() OVER (PARTITION BY year ORDER BY amt, c_custkey) AS down FROM t)
SELECT year, c_custkey, CAST(amt AS DOUBLE) AS amt, 'top' AS side, up AS place FROM s WHERE up <= 5
UNION ALL SELECT year, c_custkey, CAST(amt AS DOUBLE), 'bottom', down FROM s WHERE down <= 5""",
)
def top_bottom_n(spark, folder):
    out = A.top_bottom(stage(yearly(spark, folder, "c_custkey"), "yearly"), ["year"], "amt", ["c_custkey"], 5)
    return out.select("year", "c_custkey", *money("amt"), "side", "place")


@add(
    "rank_members",
    yearly_sql("c_custkey") + ", k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY amt DESC) AS rank FROM t) SELECT year, CAST(amt AS DOUBLE) AS amt, rank FROM k WHERE c_custkey = 7",
)
def rank_members(spark, folder):
    ranks = A.member_rank(stage(yearly(spark, folder, "c_custkey"), "yearly"), ["year"], F.col("c_custkey") == 7, "amt")
    return ranks.select("year", *money("amt"), "rank")


@add(
    "compare_members",
    FACT_SQL + """SELECT period, CAST(SUM(rev) FILTER (n_name = 'NATION_1') AS DOUBLE) AS nation_1, CAST(SUM(rev) FILTER (n_name = 'NATION_2') AS DOUBLE) AS nation_2
FROM fact WHERE n_name IN ('NATION_1', 'NATION_2') GROUP BY period""",
)
def compare_members(spark, folder):
    two = revenue(spark, folder, ["n_name"]).where(F.col("n_name").isin("NATION_1", "NATION_2"))
    wide = two.groupBy("period").pivot("n_name", ["NATION_1", "NATION_2"]).agg(F.sum("amt").cast("double"))
    return wide.select("period", F.col("NATION_1").alias("nation_1"), F.col("NATION_2").alias("nation_2"))


@add(
    "multi_hop",
    yearly_sql("c_custkey") + """, best AS (SELECT c_custkey FROM t GROUP BY c_custkey ORDER BY SUM(amt) DESC, c_custkey LIMIT 5)
SELECT c_custkey, year, CAST(amt AS DOUBLE) AS amt FROM t WHERE c_custkey IN (SELECT c_custkey FROM best)""",
)
def multi_hop(spark, folder):
    years = stage(yearly(spark, folder, "c_custkey"), "yearly")
    best = A.total(years, ["c_custkey"]).orderBy(F.desc("amt"), "c_custkey").limit(5)
    return years.join(best, "c_custkey", "left_semi").select("c_custkey", "year", *money("amt"))


@add(
    "time_trend",
    grouped("p_name, r_name") + spine_sql("p_name, r_name")
    + "SELECT p_name, r_name, period, CAST(amt AS DOUBLE) AS amt FROM d WHERE period BETWEEN '199601' AND '199812' ORDER BY p_name, r_name, period",
)
def time_trend(spark, folder):
    dims = ["p_name", "r_name"]
    months = dense(spark, folder, dims).where(F.col("period").between("199601", "199812"))
    return months.orderBy(*dims, "period").select(*dims, "period", *money("amt"))


@add(
    "growth_rates",
    grouped("n_name") + spine_sql("n_name") + f""", g AS (
  SELECT n_name, period, amt, lag(amt) OVER w AS one, lag(amt, 12) OVER w AS twelve,
         SUM(amt) OVER (PARTITION BY n_name ORDER BY period ROWS 2 PRECEDING) AS three FROM d WINDOW w AS (PARTITION BY n_name ORDER BY period)),
h AS (SELECT *, lag(three, 3) OVER (PARTITION BY n_name ORDER BY period) AS three_before FROM g)
SELECT n_name, period, {r6(change('amt', 'one'), 'mom')}, {r6(change('amt', 'twelve'), 'yoy')},
  CASE WHEN period[5:6] IN ('03', '06', '09', '12') THEN round({change('three', 'three_before')}, 6) END AS qoq FROM h""",
)
def growth_rates(spark, folder):
    months = dense(spark, folder, ["n_name"])
    order = Window.partitionBy("n_name").orderBy("period")
    quarter = months.withColumn("three", F.sum("amt").over(order.rowsBetween(-2, 0)))
    ends = A.month_of(F.col("period")).isin(3, 6, 9, 12)
    return quarter.select(
        "n_name",
        "period",
        F.round(A.growth(F.col("amt"), F.lag("amt").over(order)), 6).alias("mom"),
        F.round(A.growth(F.col("amt"), F.lag("amt", 12).over(order)), 6).alias("yoy"),
        F.when(ends, F.round(A.growth(F.col("three"), F.lag("three", 3).over(order)), 6)).alias("qoq"),
    )


_TWO_YEARS = "SUM(rev) FILTER (year = '2000') AS amt, SUM(rev) FILTER (year = '1999') AS amt_py"


@add(
    "breakdown",
    FACT_SQL + f""", t AS (SELECT CAST(c_custkey AS VARCHAR) AS member, coalesce(SUM(rev) FILTER (year = '2000'), 0) AS amt, coalesce(SUM(rev) FILTER (year = '1999'), 0) AS amt_py
  FROM fact WHERE year IN ('1999', '2000') GROUP BY 1),
u AS (SELECT member, 0 AS is_total, amt, amt_py FROM t UNION ALL SELECT 'Total', 1, SUM(amt), SUM(amt_py) FROM t)
SELECT member, is_total, CAST(amt AS DOUBLE) AS amt, CAST(amt_py AS DOUBLE) AS amt_py, {r6(ratio('amt', '(SELECT SUM(amt) FROM t)'), 'share')}, {r6(change('amt', 'amt_py'), 'yoy')} FROM u
ORDER BY is_total, yoy DESC NULLS LAST, member""",
)
def breakdown(spark, folder):
    years = revenue(spark, folder, ["c_custkey"], [("199901", "200012")]).withColumn("year", A.year_of(F.col("period")))
    zero = F.lit(0).cast(MONEY)
    wide = years.groupBy(F.col("c_custkey").cast("string").alias("member")).agg(
        F.sum(F.when(F.col("year") == "2000", F.col("amt")).otherwise(zero)).alias("amt"),
        F.sum(F.when(F.col("year") == "1999", F.col("amt")).otherwise(zero)).alias("amt_py"),
    )
    out = A.breakdown(stage(wide, "members"), "member")
    return out.select("member", "is_total", "amt", "amt_py", *six("share", "yoy"))


_MARGIN_SQL = FACT_SQL + """, t AS (SELECT {dims}, SUM(rev) AS rev, SUM(cost) + SUM(tax) AS expense, coalesce(SUM(rev) FILTER (eq), 0) AS rev_eq, coalesce(SUM(rev) FILTER (NOT eq), 0) AS rev_sv,
  coalesce(SUM(cost) FILTER (eq), 0) AS cost_eq, coalesce(SUM(cost) FILTER (NOT eq), 0) AS cost_sv FROM fact GROUP BY ALL)"""


def _margins(spark, folder, member):
    months = monthly(spark, folder, [member], cost=True).withColumn("year", A.year_of(F.col("period")))
    sums = A.total(months, [member, "year"], ("rev_eq", "rev_sv", "cost_eq", "cost_sv", "tax"))
    return sums.withColumn("rev", F.col("rev_eq") + F.col("rev_sv")).withColumn(
        "expense", F.col("cost_eq") + F.col("cost_sv") + F.col("tax")
    )


@add(
    "profit_margin",
    _MARGIN_SQL.format(dims="n_name, year")
    + f"SELECT n_name, year, CAST(rev - expense AS DOUBLE) AS profit, {r6(ratio('(rev - expense)', 'rev'), 'margin')}, CAST(rev_eq - cost_eq AS DOUBLE) AS equipment_profit, CAST(rev_sv - cost_sv AS DOUBLE) AS service_profit FROM t",
)
def profit_margin(spark, folder):
    sums = _margins(spark, folder, "n_name")
    profit = F.col("rev") - F.col("expense")
    return sums.select(
        "n_name",
        "year",
        profit.cast("double").alias("profit"),
        F.round(A.divide(profit, F.col("rev")), 6).alias("margin"),
        (F.col("rev_eq") - F.col("cost_eq")).cast("double").alias("equipment_profit"),
        (F.col("rev_sv") - F.col("cost_sv")).cast("double").alias("service_profit"),
    )


@add(
    "roi",
    _MARGIN_SQL.format(dims="n_name, year") + f""", k AS (
  SELECT n_name, year, round({ratio('(rev - expense)', 'expense')} * 100, 3) AS total_roi, round({ratio('(rev_eq - cost_eq)', 'cost_eq')} * 100, 3) AS equipment_roi,
         round({ratio('(rev - cost_eq - cost_sv)', '(cost_eq + cost_sv)')} * 100, 3) AS sales_roi FROM t)
SELECT n_name, year, total_roi, equipment_roi, sales_roi, round(total_roi - lag(total_roi) OVER (PARTITION BY n_name ORDER BY year), 3) AS change_pp FROM k""",
)
def roi(spark, folder):
    cost = F.col("cost_eq") + F.col("cost_sv")
    rates = _margins(spark, folder, "n_name").select(
        "n_name",
        "year",
        A.roi(F.col("rev"), F.col("expense")).alias("total_roi"),
        A.roi(F.col("rev_eq"), F.col("cost_eq")).alias("equipment_roi"),
        A.roi(F.col("rev"), cost).alias("sales_roi"),
    )
    order = Window.partitionBy("n_name").orderBy("year")
    return rates.withColumn("change_pp", F.round(F.col("total_roi") - F.lag("total_roi").over(order), 3))


@add(
    "budget_completion",
    _PLAN_SQL + f"SELECT p_type, r_name, period[1:4] AS year, {r6('CAST(MAX(ytd) AS DOUBLE) / nullif(MAX(budget), 0)', 'rate')} FROM plan GROUP BY ALL",
)
def budget_completion(spark, folder):
    plan = budget_view(spark, folder)
    rate = A.divide(F.max("ytd"), F.max("budget"))
    return plan.groupBy("p_type", "r_name", A.year_of(F.col("period")).alias("year")).agg(F.round(rate, 6).alias("rate"))


@add(
    "forecast_accuracy",
    _PLAN_SQL + """SELECT a.p_type, a.r_name, a.period, round(1 - abs(a.forecast - CAST(e.ytd AS DOUBLE)) / nullif(CAST(e.ytd AS DOUBLE), 0), 6) AS accuracy
FROM plan a JOIN plan e ON a.p_type = e.p_type AND a.r_name = e.r_name AND e.period = a.period[1:4] || '12'""",
)
def forecast_accuracy(spark, folder):
    whole_year = Window.partitionBy("p_type", "r_name", A.year_of(F.col("period")))
    december = F.max(F.when(A.month_of(F.col("period")) == 12, F.col("ytd"))).over(whole_year).cast("double")
    plan = budget_view(spark, folder).withColumn("actual", december).where("actual IS NOT NULL")
    accuracy = 1 - A.divide(F.abs(F.col("forecast") - F.col("actual")), F.col("actual"))
    return plan.select("p_type", "r_name", "period", F.round(accuracy, 6).alias("accuracy"))


@add(
    "target_attainment",
    _PLAN_SQL + "SELECT p_type, r_name, period, round(CAST(amt AS DOUBLE) / nullif(target, 0), 6) AS attainment FROM plan",
)
def target_attainment(spark, folder):
    return budget_view(spark, folder).select(
        "p_type", "r_name", "period", F.round(A.divide(F.col("amt"), F.col("target")), 6).alias("attainment")
    )


@add(
    "cagr",
    yearly_sql("c_custkey") + f"SELECT a.c_custkey, round(pow({ratio('b.amt', 'a.amt')}, 1.0 / 3) - 1, 6) AS cagr FROM t a JOIN t b ON a.c_custkey = b.c_custkey AND a.year = '1996' AND b.year = '1999'",
)
def cagr(spark, folder):
    months = revenue(spark, folder, ["c_custkey"], [("199601", "199612"), ("199901", "199912")])
    of = lambda year: F.sum(F.when(A.year_of(F.col("period")) == year, F.col("amt")))
    both = months.groupBy("c_custkey").agg(of("1996").alias("first"), of("1999").alias("last"))
    rate = F.pow(A.divide(F.col("last"), F.col("first")), F.lit(1.0 / 3)) - 1
    return both.where("first IS NOT NULL AND last IS NOT NULL").select("c_custkey", F.round(rate, 6).alias("cagr"))


# -- concentration and decomposition ---------------------------------------------------------


@add(
    "hhi",
    yearly_sql("n_name") + f", s AS (SELECT year, {ratio('amt', 'SUM(amt) OVER (PARTITION BY year)')} AS share FROM t) SELECT year, {r6('SUM(share * share)', 'concentration')}, round(SUM(share * share) * 10000, 3) AS hhi FROM s GROUP BY year",
)
def hhi(spark, folder):
    out = A.hhi(yearly(spark, folder, "n_name"), ["year"])
    return out.select("year", F.round("hhi", 6).alias("concentration"), F.round(F.col("hhi") * 10000, 3).alias("hhi"))


@add(
    "hhi_top_n",
    yearly_sql("c_custkey") + f""", s AS (SELECT year, {ratio('amt', 'SUM(amt) OVER (PARTITION BY year)')} AS share, row_number() OVER (PARTITION BY year ORDER BY amt DESC, c_custkey) AS place FROM t)
SELECT year, round(SUM(share * share) * 10000, 6) AS hhi FROM s WHERE place <= 10 GROUP BY year""",
)
def hhi_top_n(spark, folder):
    out = A.hhi_top(stage(yearly(spark, folder, "c_custkey"), "yearly"), ["year"], 10, ["c_custkey"])
    return out.select("year", F.round(F.col("hhi") * 10000, 6).alias("hhi"))


@add(
    "double_factor",
    _MARGIN_SQL.format(dims="r_name, n_name, year") + f""", k AS (
  SELECT a.r_name, a.n_name, a.rev, b.rev AS rev_py, a.expense AS cost, b.expense AS cost_py FROM t a JOIN t b ON a.n_name = b.n_name AND a.year = '2000' AND b.year = '1999'),
w AS (SELECT *, SUM(rev) OVER p AS tr, SUM(rev_py) OVER p AS trp, SUM(cost_py) OVER p AS tcp FROM k WINDOW p AS (PARTITION BY r_name)),
f AS (SELECT r_name, n_name, ({ratio('rev', 'tr')} - {ratio('rev_py', 'trp')}) * ({ratio('(rev_py - cost_py)', 'rev_py')} - {ratio('(trp - tcp)', 'trp')}) AS structure,
  {ratio('rev', 'tr')} * ({ratio('(rev - cost)', 'rev')} - {ratio('(rev_py - cost_py)', 'rev_py')}) AS margin FROM w)
SELECT r_name, n_name, {r6('structure', 'structure')}, {r6('margin', 'margin')}, {r6('structure + margin', 'compound')} FROM f ORDER BY r_name, compound DESC""",
)
def double_factor(spark, folder):
    months = monthly(spark, folder, ["r_name", "n_name"], cost=True, spans=[("199901", "200012")]).select(
        "r_name",
        "n_name",
        A.year_of(F.col("period")).alias("year"),
        (F.col("rev_eq") + F.col("rev_sv")).alias("rev"),
        (F.col("cost_eq") + F.col("cost_sv") + F.col("tax")).alias("cost"),
    )
    of = lambda name, year: F.sum(F.when(F.col("year") == year, F.col(name))).cast(MONEY)
    sums = [of(name, year).alias(f"{name}{end}") for name in ("rev", "cost") for year, end in (("2000", ""), ("1999", "_py"))]
    both = months.groupBy("r_name", "n_name").agg(*sums).where("rev IS NOT NULL AND rev_py IS NOT NULL")
    out = A.double_factor(stage(both, "years"), ["r_name"], "n_name")
    return out.select("r_name", "n_name", *six("structure", "margin", "compound"))


_FORMS_SQL = "UNION ALL ".join(
    f"SELECT '{form}' AS form, r_name, n_name, year, {rev} AS rev, {cost} AS cost FROM t "
    for form, rev, cost in (
        ("total", "rev", "expense"), ("sales", "rev", "cost_eq + cost_sv"), ("equipment", "rev_eq", "cost_eq"), ("service", "rev_sv", "cost_sv"),
    )
)


@add(
    "double_factor_forms",
    _MARGIN_SQL.format(dims="r_name, n_name, year") + f""", forms AS ({_FORMS_SQL}), k AS (
  SELECT a.form, a.r_name, a.n_name, a.rev, b.rev AS rev_py, a.cost, b.cost AS cost_py FROM forms a JOIN forms b ON a.form = b.form AND a.n_name = b.n_name AND a.year = '2000' AND b.year = '1999'),
w AS (SELECT *, SUM(rev) OVER p AS tr, SUM(rev_py) OVER p AS trp, SUM(cost_py) OVER p AS tcp FROM k WINDOW p AS (PARTITION BY form, r_name)),
f AS (SELECT form, r_name, n_name, ({ratio('rev', 'tr')} - {ratio('rev_py', 'trp')}) * ({ratio('(rev_py - cost_py)', 'rev_py')} - {ratio('(trp - tcp)', 'trp')}) AS structure,
  {ratio('rev', 'tr')} * ({ratio('(rev - cost)', 'rev')} - {ratio('(rev_py - cost_py)', 'rev_py')}) AS margin FROM w)
SELECT form, r_name, n_name, {r6('structure', 'structure')}, {r6('margin', 'margin')}, {r6('structure + margin', 'compound')} FROM f""",
)
def double_factor_forms(spark, folder):
    """Total, sales, equipment and service revenue decomposed from one scan of two years."""
    keys = ["r_name", "n_name"]
    months = monthly(spark, folder, keys, cost=True, spans=[("199901", "200012")]).withColumn("year", A.year_of(F.col("period")))
    years = A.total(months, [*keys, "year"], ("rev_eq", "rev_sv", "cost_eq", "cost_sv", "tax"))
    both = A.two_years(A.factor_forms(years, [*keys, "year"]), ["form", *keys], "year", "2000")
    out = A.double_factor(stage(both, "forms"), ["form", "r_name"], "n_name")
    return out.select("form", *keys, *six("structure", "margin", "compound"))


_QUARTERS_SQL = """, q AS (SELECT {dims}, period[1:4] || 'Q' || CAST(ceil(CAST(period[5:6] AS INTEGER) / 3.0) AS INTEGER) AS quarter, SUM(amt) AS amt FROM d GROUP BY ALL HAVING COUNT(*) = 3)"""


@add(
    "rolling_3q",
    grouped("n_name") + spine_sql("n_name") + _QUARTERS_SQL.format(dims="n_name") + """
SELECT n_name, quarter, round(CASE WHEN COUNT(*) OVER c = 3 THEN CAST(SUM(amt) OVER c AS DOUBLE) / 3 END, 3) AS centred,
       round(CASE WHEN COUNT(*) OVER t = 3 THEN CAST(SUM(amt) OVER t AS DOUBLE) / 3 END, 3) AS trailing
FROM q WINDOW c AS (PARTITION BY n_name ORDER BY quarter ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), t AS (PARTITION BY n_name ORDER BY quarter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def rolling_3q(spark, folder):
    quarters = quarterly(spark, folder, ["n_name"])
    return quarters.select(
        "n_name",
        "quarter",
        F.round(A.rolling_three(quarters, ["n_name"]), 3).alias("centred"),
        F.round(A.rolling_three(quarters, ["n_name"], trailing=True), 3).alias("trailing"),
    )


@add(
    "inflection_points",
    grouped("n_name") + spine_sql("n_name") + """, s AS (SELECT *, sign(amt - lag(amt) OVER (PARTITION BY n_name ORDER BY period)) AS move FROM d)
SELECT n_name, period, CAST(amt AS DOUBLE) AS amt, CASE WHEN move * lag(move) OVER (PARTITION BY n_name ORDER BY period) < 0 THEN 'Y' ELSE 'N' END AS inflection FROM s""",
)
def inflection_points(spark, folder):
    months = dense(spark, folder, ["n_name"])
    return A.with_inflection(months, ["n_name"]).select("n_name", "period", *money("amt"), "inflection")


@add(
    "star_products",
    grouped("p_name") + spine_sql("p_name") + _QUARTERS_SQL.format(dims="p_name") + f""", g AS (
  SELECT *, {change('amt', 'lag(amt) OVER (PARTITION BY p_name ORDER BY quarter)')} AS qoq FROM q),
s AS (SELECT *, MIN(qoq) OVER w AS low, COUNT(qoq) OVER w AS n FROM g WINDOW w AS (PARTITION BY p_name ORDER BY quarter ROWS 2 PRECEDING))
SELECT p_name, quarter, CAST(amt AS DOUBLE) AS amt, round(qoq, 6) AS qoq FROM s WHERE n = 3 AND low > 0.1""",
)
def star_products(spark, folder):
    quarters = quarterly(spark, folder, ["p_name"])
    return A.stars(quarters, ["p_name"]).select("p_name", "quarter", *money("amt"), *six("qoq"))


ASKED = "2000-08-15"


@add(
    "star_products_at",
    grouped("p_name, n_name") + spine_sql("p_name, n_name") + _QUARTERS_SQL.format(dims="p_name, n_name") + f""", g AS (
  SELECT *, row_number() OVER w AS place, {change('amt', 'lag(amt) OVER w')} AS qoq FROM q WHERE quarter <= '2000Q2' WINDOW w AS (PARTITION BY p_name, n_name ORDER BY quarter)),
b AS (SELECT p_name, n_name, MAX(place) AS place FROM g WHERE coalesce(qoq, 0) <= 0.1 GROUP BY ALL),
s AS (SELECT g.p_name, g.n_name, MIN(quarter) AS since, COUNT(*) AS n_quarters, MIN(b.place) AS place, MAX(amt) FILTER (quarter = '2000Q2') AS amt FROM g JOIN b ON g.p_name = b.p_name AND g.n_name = b.n_name AND g.place > b.place GROUP BY g.p_name, g.n_name)
SELECT s.p_name, s.n_name, since, n_quarters, CAST(g.amt AS DOUBLE) AS amt_before, CAST(s.amt AS DOUBLE) AS amt, {r6(change('s.amt', 'g.amt'), 'growth')}
FROM s JOIN g ON g.p_name = s.p_name AND g.n_name = s.n_name AND g.place = s.place WHERE n_quarters >= 3""",
)
def star_products_at(spark, folder):
    """Products of a nation whose growth lasts up to a day; months after it are not read."""
    last = A.closed_quarter(ASKED)
    bounds = (min(month_bounds(spark, folder)[0], A.last_month(last)), A.last_month(last))
    quarters = A.quarterly(revenue(spark, folder, ["p_name", "n_name"], [bounds]), ["p_name", "n_name"], bounds)
    return A.lasting_stars(quarters, ["p_name", "n_name"], last).select("p_name", "n_name", "since", "n_quarters", *money("amt_before", "amt"), *six("growth"))


def _yoy(spark, folder, member):
    years = A.with_year_before(yearly(spark, folder, member), [member], "year", "amt", "before")
    return years.where("before IS NOT NULL").withColumn("growth", A.growth(F.col("amt"), F.col("before")))


def _yoy_sql(member: str) -> str:
    return yearly_sql(member) + f", g AS (SELECT a.{member}, a.year, {change('a.amt', 'b.amt')} AS growth FROM t a JOIN t b ON a.{member} = b.{member} AND CAST(a.year AS INTEGER) = CAST(b.year AS INTEGER) + 1)"


@add("growth_volatility", _yoy_sql("c_custkey") + "SELECT c_custkey, round(stddev_samp(growth), 6) AS volatility FROM g GROUP BY c_custkey")
def growth_volatility(spark, folder):
    return _yoy(spark, folder, "c_custkey").groupBy("c_custkey").agg(F.round(F.stddev_samp("growth"), 6).alias("volatility"))


@add("decline_only", _yoy_sql("c_custkey") + "SELECT c_custkey, year, round(growth, 6) AS growth FROM g WHERE growth < 0")
def decline_only(spark, folder):
    return _yoy(spark, folder, "c_custkey").where(F.col("growth") < 0).select("c_custkey", "year", *six("growth"))


@add(
    "region_group_filter",
    FACT_SQL + """, members AS (SELECT 'G7' AS grp, n_name FROM nation WHERE n_nationkey < 7 UNION ALL SELECT 'BRICS', n_name FROM nation WHERE n_nationkey % 5 = 0)
SELECT grp, period, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact JOIN members USING (n_name) GROUP BY grp, period""",
)
def region_group_filter(spark, folder):
    nations = table(spark, folder, "nation")
    groups = nations.where("n_nationkey < 7").select(F.lit("G7").alias("grp"), "n_name").unionByName(
        nations.where("n_nationkey % 5 = 0").select(F.lit("BRICS").alias("grp"), "n_name")
    )
    return A.total(revenue(spark, folder, ["n_name"]).join(groups, "n_name"), ["grp", "period"]).select("grp", "period", *money("amt"))


@add(
    "fact_lookup",
    """SELECT DISTINCT o_custkey || '-' || strftime(o_orderdate, '%Y') AS contract, l_orderkey AS project FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#5' AND l_quantity > 40""",
)
def fact_lookup(spark, folder):
    parts = table(spark, folder, "part").where("p_brand = 'Brand#5'").select("p_partkey")
    lines = table(spark, folder, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_partkey")
    projects = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey").distinct()
    orders = table(spark, folder, "orders")
    contract = F.concat_ws("-", "o_custkey", F.date_format("o_orderdate", "yyyy"))
    return projects.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        contract.alias("contract"), F.col("l_orderkey").alias("project")
    )


# Groups of groups, and the nations of the test data that stand for the names: the k-th name is nation k, counted around.
NESTED_GROUPS = {"G7 and BRICS": ("G7", "BRICS"), "Three Groups": ("G7 and BRICS", "Arab", "Egypt")}
_NAMES = sorted({name for names in REGION_GROUPS.values() for name in names})
BRIDGE = [(g, m) for g, names in REGION_GROUPS.items() for m in (f"NATION_{_NAMES.index(n) % 25}" for n in names)]
BRIDGE += [(g, m if m in REGION_GROUPS or m in NESTED_GROUPS else f"NATION_{_NAMES.index(m) % 25}") for g, names in NESTED_GROUPS.items() for m in names]


@add(
    "region_groups",
    FACT_SQL.replace("WITH fact", "WITH RECURSIVE fact", 1) + f""", bridge(grp, member) AS (VALUES {', '.join(f"('{g}', '{m}')" for g, m in BRIDGE)}),
deep AS (SELECT grp, member FROM bridge UNION SELECT d.grp, b.member FROM deep d JOIN bridge b ON b.grp = d.member),
members AS (SELECT DISTINCT grp, member AS n_name FROM deep WHERE member NOT IN (SELECT grp FROM bridge))
SELECT grp, period, CAST(SUM(rev) AS DOUBLE) AS amt FROM fact JOIN members USING (n_name) GROUP BY grp, period""",
)
def region_groups(spark, folder):
    """All named groups and groups of groups; a nation counts once in each group that holds it."""
    members = A.expand_groups(spark.createDataFrame(BRIDGE, "grp string, member string")).withColumnRenamed("member", "n_name")
    return A.total(revenue(spark, folder, ["n_name"]).join(members, "n_name"), ["grp", "period"]).select("grp", "period", *money("amt"))
