"""Result-table pairs derived from the star tables, in Spark and as SQL text.

MONTHS: one query per (nation, year); the expected table lists month and amount, a second variant
has the columns swapped. The prediction is damaged by nation: as it is, columns swapped, rows
reversed, one return flag left out of the sums, or an extra column and the last month missing.

PARTS: one query per part; rows are quantity, discount and tax of its lines. The prediction changes
the discount of some lines, leaves others out and reverses every fourth table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.operators import rows as R
from ledgerlens.session import stage
from ledgerlens.sources.tables import table


def months_base(spark: SparkSession, folder: str) -> DataFrame:
    """Month totals per nation."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.date_format("l_shipdate", "yyyyMM").alias("period"),
        price.alias("amt"),
        F.when(F.col("l_returnflag") != "R", price).otherwise(F.lit(0).cast("decimal(12,2)")).alias("amt_nr"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    by_nation = (
        lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("c_nationkey", "period")
        .agg(F.sum("amt").alias("amt"), F.sum("amt_nr").alias("amt_nr"), F.count("*").alias("n"))
    )
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    year = F.substring("period", 1, 4)
    whole = Window.partitionBy("query_id")
    return (
        by_nation.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws("-", "n_name", year).alias("query_id"),
            (F.col("n_nationkey") % 5).alias("kind"),
            F.col("r_name").alias("difficulty"),
            year.alias("year"),
            "period",
            F.col("amt").cast("double").alias("amt"),
            F.col("amt_nr").cast("double").alias("amt_nr"),
            "n",
        )
        .withColumn("idx", F.row_number().over(whole.orderBy("period")) - 1)
        .withColumn("m", F.count("*").over(whole))
    )


def months(base: DataFrame) -> DataFrame:
    """The result rows of both sides, in one pass over the month totals."""
    base = C.with_cells(base, ["period", "amt", "amt_nr", "n"])
    period, amount, part, extra = (F.col(c) for c in ("period", "amt", "amt_nr", "n"))
    index, kind = F.col("idx").cast("bigint"), F.col("kind")
    damaged = (
        F.when(kind == 1, F.array(amount, period))
        .when(kind == 3, F.array(period, part))
        .when(kind == 4, F.array(period, amount, extra))
        .otherwise(F.array(period, amount))
    )
    place = F.when(kind == 2, F.col("m") - 1 - index).otherwise(index)

    def row(side: str, variant: int, at: Column, cells: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), F.lit(variant).alias("variant"), at.alias("row_idx"), cells.alias("cells")
        )

    kept = (kind != 4) | (F.col("idx") < F.col("m") - 1)
    rows = F.array(
        row("g", 0, index, F.array(period, amount)),
        row("g", 1, index, F.array(amount, period)),
        F.when(kept, row("p", 0, place, damaged)),
    )
    return base.select("query_id", F.explode(rows).alias("r")).where("r IS NOT NULL").select("query_id", "r.*")


def months_meta(base: DataFrame) -> DataFrame:
    return base.select("query_id", "difficulty", "year").distinct()


def parts(spark: SparkSession, folder: str) -> DataFrame:
    place = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("query_id"),
        "l_partkey",
        "l_linenumber",
        place.alias("place"),
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        ((F.col("l_returnflag") == "R") & (F.col("l_orderkey") % 5 == 0)).alias("hit"),
    )
    ties = [F.col(c) for c in ("l_quantity", "l_discount", "l_tax", "l_returnflag")]
    turned = F.when(F.col("l_partkey") % 4 == 1, -F.col("place")).otherwise(F.col("place"))
    changed = F.when(F.col("hit"), F.col("l_discount") + 0.5).otherwise(F.col("l_discount"))
    kept = (F.col("l_linenumber") != 7) | (F.col("l_partkey") % 3 != 0)

    def row(side: str, place: Column, discount: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), place.alias("at"), discount.alias("discount"))

    rows = F.array(row("g", F.col("place"), F.col("l_discount")), F.when(kept, row("p", turned, changed)))
    # lines meet once, before they become rows of both sides
    hot = R.hot_keys(lines, ["query_id"])
    met = R.with_chunks(lines, F.col("place"), hot).repartition("query_id", "_chunk")
    both = met.select("*", F.explode(rows).alias("r")).where("r IS NOT NULL").select("*", "r.*").withColumn("variant", F.lit(0))
    numbered = R.dense_index(both.drop("r"), ["query_id", "side"], F.col("at"), ties, hot=hot)
    return R.norm_cells(numbered, ["l_quantity", "discount", "l_tax"])


def stored_months(spark: SparkSession, folder: str) -> DataFrame:
    """The result rows written once, as the rows of executed statements are."""
    return stage(months(months_base(spark, folder)), "results")


def stored_parts(spark: SparkSession, folder: str) -> DataFrame:
    return stage(parts(spark, folder), "results")


# -- the same as SQL -------------------------------------------------------------------------


def number_sql(x: str) -> str:
    r = f"round({x}, 3)"
    return f"'n' || CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE CAST({r} AS VARCHAR) END"


MONTHS_SQL = f"""
WITH base AS (
  SELECT n_name || '-' || strftime(l_shipdate, '%Y') AS query_id, n_nationkey % 5 AS kind, r_name AS difficulty,
         strftime(l_shipdate, '%Y') AS year, strftime(l_shipdate, '%Y%m') AS period,
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS amt,
         CAST(SUM(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS amt_nr,
         COUNT(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY period) - 1 AS idx,
         COUNT(*) OVER (PARTITION BY query_id) AS m,
         's' || period AS kp, {number_sql('amt')} AS ka, {number_sql('amt_nr')} AS kr, 'n' || CAST(n AS VARCHAR) AS kn
  FROM base),
gold AS (
  SELECT query_id, 0 AS variant, idx AS row_idx, [kp, ka] AS keys, [ka, kp] AS enc FROM keyed
  UNION ALL SELECT query_id, 1, idx, [ka, kp], [ka, kp] FROM keyed),
pred AS (
  SELECT query_id, CASE WHEN kind = 2 THEN m - 1 - idx ELSE idx END AS row_idx,
         CASE kind WHEN 1 THEN [ka, kp] WHEN 3 THEN [kp, kr] WHEN 4 THEN [kp, ka, kn] ELSE [kp, ka] END AS keys,
         CASE kind WHEN 3 THEN [kr, kp] WHEN 4 THEN [ka, kn, kp] ELSE [ka, kp] END AS enc
  FROM keyed WHERE kind <> 4 OR idx < m - 1),
pairs AS (SELECT DISTINCT query_id, variant FROM gold)
"""

PARTS_SQL = f"""
WITH lines AS (
  SELECT 'P' || l_partkey AS query_id, l_partkey, l_linenumber, l_orderkey * 8 + l_linenumber AS place,
         l_quantity, l_discount, l_tax, l_returnflag, l_returnflag = 'R' AND l_orderkey % 5 = 0 AS hit
  FROM lineitem),
gold_rows AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS row_idx,
         l_quantity AS a, l_discount AS b, l_tax AS c FROM lines),
pred_rows AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN l_partkey % 4 = 1 THEN -place ELSE place END,
           l_quantity, l_discount, l_tax, l_returnflag) - 1 AS row_idx,
         l_quantity AS a, CASE WHEN hit THEN l_discount + 0.5 ELSE l_discount END AS b, l_tax AS c
  FROM lines WHERE l_linenumber <> 7 OR l_partkey % 3 <> 0),
both_sides AS (SELECT 'g' AS side, * FROM gold_rows UNION ALL SELECT 'p', * FROM pred_rows),
keyed AS (
  SELECT side, query_id, row_idx, {number_sql('a')} AS ka, {number_sql('b')} AS kb, {number_sql('c')} AS kc FROM both_sides),
marked AS (
  SELECT side, query_id, row_idx, [ka, kb, kc] AS keys, list_sort([ka, kb, kc]) AS bag,
         [ka || '#1', kb || '#' || (1 + CAST(ka = kb AS INTEGER)), kc || '#' || (1 + CAST(ka = kc AS INTEGER) + CAST(kb = kc AS INTEGER))] AS marks
  FROM keyed),
gold AS (SELECT * FROM marked WHERE side = 'g'),
pred AS (SELECT * FROM marked WHERE side = 'p'),
sizes AS (
  SELECT query_id, COUNT(*) FILTER (side = 'p') AS n, COUNT(*) FILTER (side = 'g') AS m FROM marked GROUP BY query_id)
"""
