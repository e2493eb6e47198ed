"""Registered queries: the relational features that the question corpora use."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans.registry import Registry
from ledgerlens.sources.tables import register_tables, table

registry = Registry()
add = registry.add


def t(spark, folder, name):
    return table(spark, folder, name)


def price(name: str):
    return F.col(name).cast("decimal(12,2)")


_PRICE = "CAST({} AS DECIMAL(12,2))"
PRICE = _PRICE.format("l_extendedprice")


@add(
    "project_filter",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE (o_orderstatus = 'F' AND o_totalprice > 1000 AND o_orderpriority <> '5-LOW') OR (o_totalprice <= 2000 AND o_orderdate IS NOT NULL)""",
)
def project_filter(spark, folder):
    big = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000) & (F.col("o_orderpriority") != "5-LOW")
    small = (F.col("o_totalprice") <= 2000) & F.col("o_orderdate").isNotNull()
    return t(spark, folder, "orders").where(big | small).select("o_orderkey", "o_custkey", "o_totalprice")


@add("in_list", "SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3)")
def in_list(spark, folder):
    lines = t(spark, folder, "lineitem")
    return lines.where(F.col("l_returnflag").isin("A", "R") & F.col("l_linenumber").isin(1, 3)).select("l_orderkey", "l_partkey", "l_returnflag")


@add("not_in_list", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'LARGE', 'SMALL')")
def not_in_list(spark, folder):
    return t(spark, folder, "part").where(~F.col("p_type").isin("PROMO", "LARGE", "SMALL")).select("p_partkey", "p_type")


@add("between_filter", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.05 AND l_quantity BETWEEN 10 AND 20")
def between_filter(spark, folder):
    lines = t(spark, folder, "lineitem")
    return lines.where(F.col("l_discount").between(0.03, 0.05) & F.col("l_quantity").between(10, 20)).select(
        "l_orderkey", "l_quantity", "l_discount"
    )


@add("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name LIKE 'small%'")
def like_filter(spark, folder):
    return t(spark, folder, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_name").like("small%")).select("p_partkey", "p_name")


@add("inner_equi_join", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def inner_equi_join(spark, folder):
    rich = t(spark, folder, "customer").where("c_acctbal > 5000").select("c_custkey", "c_name")
    orders = t(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(rich, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@add(
    "multi_join",
    f"""SELECT n_name, o_orderpriority, CAST(SUM({_PRICE.format('o_totalprice')}) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, o_orderpriority""",
)
def multi_join(spark, folder):
    by_customer = (
        t(spark, folder, "orders")
        .groupBy("o_custkey", "o_orderpriority")
        .agg(F.sum(price("o_totalprice")).cast("decimal(28,2)").alias("total"))
    )
    customers = t(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = t(spark, folder, "nation").select("n_nationkey", "n_name")
    return (
        by_customer.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name", "o_orderpriority")
        .agg(F.sum("total").cast("double").alias("total"))
    )


@add("anti_join_not_exists", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def anti_join_not_exists(spark, folder):
    open_orders = t(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    customers = t(spark, folder, "customer")
    return customers.join(open_orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@add(
    "semi_join_tuple_in",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, MAX(o_totalprice) FROM orders GROUP BY o_custkey)",
)
def semi_join_tuple_in(spark, folder):
    orders = t(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    best = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return orders.join(best, ["o_custkey", "o_totalprice"], "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@add("scalar_subquery", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice = (SELECT MAX(l_extendedprice) FROM lineitem)")
def scalar_subquery(spark, folder):
    lines = t(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    top = lines.agg(F.max("l_extendedprice").alias("top")).scalar()
    return lines.where(F.col("l_extendedprice") == top)


@add(
    "derived_table",
    "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) s GROUP BY n",
)
def derived_table(spark, folder):
    counts = t(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.groupBy("n").agg(F.count("*").alias("customers"))


_CTE = """WITH spend AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders GROUP BY o_custkey),
ranked AS (SELECT c_mktsegment, MAX(total) AS best, COUNT(*) AS n FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)
SELECT c_mktsegment, CAST(best AS DOUBLE) AS best, n FROM ranked"""


@add("cte_query", _CTE)
def cte_query(spark, folder):
    register_tables(spark, folder, ("orders", "customer"))
    return spark.sql(_CTE)


@add(
    "group_agg",
    f"""SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS total, round(CAST(SUM({PRICE}) AS DOUBLE) / COUNT(*), 4) AS mean,
MIN(l_quantity) AS low, MAX(l_quantity) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_agg(spark, folder):
    total = F.sum(price("l_extendedprice")).cast("double")
    return (
        t(spark, folder, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            total.alias("total"),
            F.round(total / F.count("*"), 4).alias("mean"),
            F.min("l_quantity").alias("low"),
            F.max("l_quantity").alias("high"),
        )
    )


@add("global_agg", f"SELECT COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS total, MAX(l_tax) AS high FROM lineitem WHERE l_discount > 0.02")
def global_agg(spark, folder):
    lines = t(spark, folder, "lineitem").where("l_discount > 0.02")
    return lines.agg(F.count("*").alias("n"), F.sum(price("l_extendedprice")).cast("double").alias("total"), F.max("l_tax").alias("high"))


@add("count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag ORDER BY COUNT(DISTINCT l_partkey) DESC, l_returnflag")
def count_distinct(spark, folder):
    counts = t(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"))
    return counts.orderBy(F.desc("parts"), "l_returnflag")


@add("having_filter", f"SELECT l_partkey, COUNT(*) AS n, CAST(SUM({PRICE}) AS DOUBLE) AS total FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 30 AND SUM({PRICE}) > 1000000")
def having_filter(spark, folder):
    sums = t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum(price("l_extendedprice")).alias("total"))
    return sums.where("n > 30 AND total > 1000000").select("l_partkey", "n", F.col("total").cast("double").alias("total"))


@add("distinct_rows", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_rows(spark, folder):
    return t(spark, folder, "orders").select("o_custkey", "o_orderpriority").distinct()


@add("group_by_expression", "SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS bucket, COUNT(*) AS n FROM orders GROUP BY bucket")
def group_by_expression(spark, folder):
    return t(spark, folder, "orders").groupBy(F.floor(F.col("o_totalprice") / 10000).alias("bucket")).agg(F.count("*").alias("n"))


@add("top_k", f"SELECT l_partkey FROM lineitem GROUP BY l_partkey ORDER BY SUM({PRICE}) DESC, l_partkey LIMIT 20")
def top_k(spark, folder):
    sums = t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum(price("l_extendedprice")).alias("total"))
    return sums.orderBy(F.desc("total"), "l_partkey").limit(20).select("l_partkey")


@add("multi_key_sort", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def multi_key_sort(spark, folder):
    orders = t(spark, folder, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey")
    return orders.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@add("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def limit_offset(spark, folder):
    orders = t(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@add("union_all", "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_all(spark, folder):
    buyers = t(spark, folder, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    sellers = t(spark, folder, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return buyers.unionByName(sellers)


@add("union_distinct", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT l_partkey FROM lineitem WHERE l_discount = 0.1")
def union_distinct(spark, folder):
    lines = t(spark, folder, "lineitem")
    many = lines.where("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return many.unionByName(lines.where(F.col("l_discount") == 0.1).select(F.col("l_partkey").alias("k"))).distinct()


@add(
    "case_when",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size,
CASE WHEN o_orderstatus = 'F' THEN 'done' END AS state FROM orders""",
)
def case_when(spark, folder):
    amount = F.col("o_totalprice")
    return t(spark, folder, "orders").select(
        "o_orderkey",
        F.when(amount > 300000, "large").when(amount > 100000, "middle").otherwise("small").alias("size"),
        F.when(F.col("o_orderstatus") == "F", "done").alias("state"),
    )


@add(
    "coalesce_null",
    "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, quality, 9) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def coalesce_null(spark, folder):
    labels = t(spark, folder, "labels")
    return t(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", "quality", F.lit(9)).alias("toxic")
    )


@add(
    "cast_value",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(floor(value) AS BIGINT) AS whole, TRY_CAST(event_type AS INTEGER) AS bad, CAST(user_id AS VARCHAR) AS user_text FROM events",
)
def cast_value(spark, folder):
    return t(spark, folder, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.floor("value").alias("whole"),
        F.expr("try_cast(event_type AS int)").alias("bad"),
        F.col("user_id").cast("string").alias("user_text"),
    )


@add(
    "window_agg",
    f"""WITH d AS (SELECT event_type, date_trunc('day', ts) AS day, COUNT(*) AS n FROM events GROUP BY ALL)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(n / CAST(SUM(n) OVER (PARTITION BY event_type) AS DOUBLE), 6) AS share,
CAST(SUM(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS running FROM d""",
)
def window_agg(spark, folder):
    days = t(spark, folder, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("event_type")
    running = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(
        "event_type",
        "day",
        "n",
        F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"),
        F.sum("n").over(running).alias("running"),
    )


@add(
    "rank_window",
    """WITH c AS (SELECT p_type, p_brand, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT p_type, p_brand, n, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rn FROM c WINDOW w AS (PARTITION BY p_type ORDER BY n DESC)""",
)
def rank_window(spark, folder):
    parts = t(spark, folder, "part").select("p_partkey", "p_type", "p_brand")
    by_part = t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    counts = by_part.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "p_brand").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("p_type").orderBy(F.desc("n"))
    return counts.select(
        "p_type",
        "p_brand",
        "n",
        F.rank().over(order).alias("r"),
        F.dense_rank().over(order).alias("dr"),
        F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("n"), "p_brand")).alias("rn"),
    )


@add(
    "lag_lead",
    """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY ALL)
SELECT event_type, day, n, lag(n) OVER w AS before, lead(n) OVER w AS after FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)""",
)
def lag_lead(spark, folder):
    days = t(spark, folder, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("event_type").orderBy("day")
    return days.select("event_type", "day", "n", F.lag("n").over(order).alias("before"), F.lead("n").over(order).alias("after"))


@add("string_lower", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer WHERE lower(c_mktsegment) = 'building'")
def string_lower(spark, folder):
    segment = F.lower("c_mktsegment")
    return t(spark, folder, "customer").where(segment == "building").select("c_custkey", segment.alias("segment"))


@add("hour_of_ts", "SELECT strftime(ts, '%H') AS hour, COUNT(*) AS n FROM events GROUP BY hour ORDER BY n DESC, hour")
def hour_of_ts(spark, folder):
    hours = t(spark, folder, "events").groupBy(F.date_format("ts", "HH").alias("hour")).agg(F.count("*").alias("n"))
    return hours.orderBy(F.desc("n"), "hour")


@add(
    "math_exprs",
    """SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity / 7) AS BIGINT) AS f, abs(l_discount - 0.05) AS a, round(pow(1 + l_tax, 3), 6) AS p,
l_extendedprice / nullif(l_tax * 100, 0) AS q, l_linenumber * 1.0e0 / 2 AS half FROM lineitem""",
)
def math_exprs(spark, folder):
    return t(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.floor(F.col("l_quantity") / 7).alias("f"),
        F.abs(F.col("l_discount") - 0.05).alias("a"),
        F.round(F.pow(1 + F.col("l_tax"), F.lit(3)), 6).alias("p"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_tax") * 100).alias("q"),
        (F.col("l_linenumber") * F.lit(1.0) / 2).alias("half"),
    )


@add("stddev_agg", "SELECT l_partkey, round(stddev_samp(l_quantity), 6) AS spread FROM lineitem GROUP BY l_partkey")
def stddev_agg(spark, folder):
    return t(spark, folder, "lineitem").groupBy("l_partkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("spread"))
