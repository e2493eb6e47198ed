"""Monthly measures of the star schema.

Only the tables of the asked dimensions are joined, with the columns they give; Spark broadcasts
those that are small and shuffles the others. A key that holds a large share of the lines makes a
skewed sort-merge join, which adaptive execution splits (on by default, see ``session``); after the
joins lines are summed before they are shuffled again. Amounts are decimals: sums do not depend on
the order in which partitions are merged, so a retried task changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import table

MONEY = "decimal(28,4)"
PRODUCT = ("p_type", "p_brand", "p_name")
CUSTOMER = ("c_mktsegment", "c_custkey")
REGION = ("r_name", "n_name")


def month_bounds(spark: SparkSession, folder: str) -> tuple[str, str]:
    """First and last month of the fact table, from its date column alone; no months where the table is empty."""
    dates = table(spark, folder, "lineitem").agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    found = dates.select(F.date_format("lo", "yyyyMM"), F.date_format("hi", "yyyyMM")).first()
    return (found[0], found[1]) if found[0] else ("000102", "000101")


def in_months(date: Column, spans: list[tuple[str, str]]) -> Column:
    """Dates in one of the spans of months (first and last included), as comparisons with literals that a scan can use."""
    out = F.lit(False)
    for first, last in spans:
        after = f"{int(last[:4]) + int(last[4:]) // 12}-{int(last[4:]) % 12 + 1:02d}-01"
        here = (date >= F.lit(f"{first[:4]}-{first[4:]}-01").cast("timestamp")) & (date < F.lit(after).cast("timestamp"))
        out = here if len(spans) == 1 else out | here
    return out


def monthly(spark: SparkSession, folder: str, dims: list[str], cost: bool = False, spans: list[tuple[str, str]] | None = None) -> DataFrame:
    """period, dims, rev_eq and rev_sv; with ``cost`` also cost_eq, cost_sv and tax. ``spans`` of months limit the lines that are read."""
    product = [d for d in dims if d in PRODUCT]
    customer = [d for d in dims if d in CUSTOMER]
    region = [d for d in dims if d in REGION]
    by_order, by_part = bool(customer or region), bool(product or cost)
    ids = ["l_orderkey"] * by_order + ["l_partkey"] * by_part + ["l_suppkey"] * ("s_name" in dims)
    values = [F.col("l_linestatus").alias("status"), F.col("l_extendedprice").cast("decimal(12,2)").alias("price")]
    values.append((1 - F.col("l_discount")).cast("decimal(3,2)").alias("kept"))
    if cost:
        values += [F.col("l_quantity").cast("decimal(6,2)").alias("quantity"), F.col("l_tax").cast("decimal(3,2)").alias("rate")]
    lines = table(spark, folder, "lineitem")
    if spans is not None:
        lines = lines.where(in_months(F.col("l_shipdate"), spans))
    out = lines.select(*ids, F.date_format("l_shipdate", "yyyyMM").alias("period"), *values)
    if by_part:
        unit = [F.col("p_retailprice").cast("decimal(10,2)").alias("unit")] if cost else []
        parts = table(spark, folder, "part").select("p_partkey", *product, *unit)
        out = out.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    if "s_name" in dims:
        suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
        out = out.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    if by_order:
        orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
        buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        if region:
            nations = (
                table(spark, folder, "nation")
                .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
                .select("n_nationkey", *region)
            )
            buyers = buyers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        buyers = buyers.select("c_custkey", *[d for d in customer if d != "c_custkey"], *region)
        owned = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        out = out.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    equipment = F.col("status") == "F"

    def parted(name: str, value) -> list:
        none = F.lit(0).cast("decimal(16,4)")
        return [
            F.sum(F.when(equipment, value).otherwise(none)).cast(MONEY).alias(f"{name}_eq"),
            F.sum(F.when(equipment, none).otherwise(value)).cast(MONEY).alias(f"{name}_sv"),
        ]

    sums = parted("rev", F.col("price") * F.col("kept"))
    if cost:
        sums += parted("cost", F.col("quantity") * F.col("unit"))
        sums.append(F.sum(F.col("price") * F.col("rate")).cast(MONEY).alias("tax"))
    return out.groupBy("period", *dims).agg(*sums)


def revenue(spark: SparkSession, folder: str, dims: list[str], spans: list[tuple[str, str]] | None = None) -> DataFrame:
    """period, dims, amt = equipment and service revenue."""
    return monthly(spark, folder, dims, spans=spans).select("period", *dims, (F.col("rev_eq") + F.col("rev_sv")).cast(MONEY).alias("amt"))


FACT_SQL = """
WITH fact AS (
  SELECT strftime(l_shipdate, '%Y%m') AS period, strftime(l_shipdate, '%Y') AS year,
         strftime(l_shipdate, '%Y') || 'Q' || quarter(l_shipdate) AS quarter,
         r_name, n_name, c_mktsegment, c_custkey, p_type, p_brand, p_name, s_name, l_orderkey, l_returnflag,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(3,2)) AS rev,
         CAST(l_quantity AS DECIMAL(12,2)) * CAST(p_retailprice AS DECIMAL(12,2)) AS cost,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(3,2)) AS tax, l_linestatus = 'F' AS eq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
"""
