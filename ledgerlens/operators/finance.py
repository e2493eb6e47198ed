"""Financial indicators on monthly frames ``(period 'YYYYMM', dims…, amt)``.

Inputs are sums per month and member. Windows run inside one member, over months or quarters; shares
and totals come from a second aggregation, never from a window over all members.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import stage

MONEY = "decimal(28,4)"
MESSAGE = "Date out of range"


def expand_groups(bridge: DataFrame) -> DataFrame:
    """``bridge(grp, member)`` to (grp, member) with members of members in place of groups; a member of two groups is in both.

    Each round puts the members of a group in its place, so their number is the depth of the nesting. A group that holds itself adds nothing new.
    """
    known = stage(bridge.select("grp", "member").distinct(), "groups")
    groups = known.select(F.col("grp").alias("member")).distinct()
    inner = known.select(F.col("grp").alias("member"), F.col("member").alias("below"))
    count = known.count()
    while True:
        more = known.join(inner, "member").select("grp", F.col("below").alias("member"))
        known = stage(known.unionByName(more).distinct(), "groups")
        before, count = count, known.count()
        if count == before:
            return known.join(groups, "member", "left_anti").select("grp", "member")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def growth(now: Column, before: Column) -> Column:
    return divide(now - before, before)


def day(period: Column) -> Column:
    return F.to_date(period, "yyyyMM")


def shift(period: Column, months: int) -> Column:
    return F.date_format(F.add_months(day(period), months), "yyyyMM")


def year_of(period: Column) -> Column:
    return F.substring(period, 1, 4)


def month_of(period: Column) -> Column:
    return F.substring(period, 5, 2).cast("int")


def quarter_of(period: Column) -> Column:
    return F.concat(year_of(period), F.lit("Q"), F.ceil(month_of(period) / 3).cast("string"))


def total(df: DataFrame, keys: list[str], columns: tuple[str, ...] = ("amt",)) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).cast(MONEY).alias(c) for c in columns])


Bounds = tuple[str, str] | None


def _ends(df: DataFrame, bounds: Bounds) -> tuple[Column, Column]:
    if bounds is not None:
        return F.lit(bounds[0]), F.lit(bounds[1])
    found = df.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    return found.select("lo").scalar(), found.select("hi").scalar()


def dense(df: DataFrame, dims: list[str], columns: tuple[str, ...] = ("amt",), bounds: Bounds = None) -> DataFrame:
    """Every month of the range for every member; months without rows carry 0. ``df`` has one row per month and member.

    A member's months are gathered in one map, at most one entry per month of the range, and read off month by month: the frame
    is worked out once and not joined with itself. Without ``bounds`` the range is asked of the frame, which works it out again.
    """
    lo, hi = _ends(df, bounds)
    months = F.when(lo <= hi, F.sequence(day(lo), day(hi), F.expr("interval 1 month")))
    entry = F.struct("period", F.struct(*columns).alias("held"))
    held = df.groupBy(*dims).agg(F.map_from_entries(F.collect_list(entry)).alias("_held"))
    spread = held.select(*dims, "_held", F.explode(months).alias("_day")).withColumn("period", F.date_format("_day", "yyyyMM"))
    value = F.try_element_at("_held", F.col("period"))
    return spread.select(*dims, "period", *[F.coalesce(value[c], F.lit(0).cast(MONEY)).cast(MONEY).alias(c) for c in columns])


def with_ytd(df: DataFrame, dims: list[str], column: str = "amt", out: str = "ytd") -> DataFrame:
    """Sum from January to the month, on a dense frame."""
    window = Window.partitionBy(*dims, year_of(F.col("period"))).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(column).over(window).cast(MONEY))


def with_prior_year(df: DataFrame, dims: list[str], columns: tuple[str, ...]) -> DataFrame:
    """The same columns one year earlier, as ``<name>_py``, on a dense frame; null before the range."""
    order = Window.partitionBy(*dims).orderBy("period")
    return df.select("*", *[F.lag(c, 12).over(order).alias(f"{c}_py") for c in columns])


def with_last_year_total(df: DataFrame, dims: list[str], ytd: str = "ytd", out: str = "year_amt") -> DataFrame:
    """The total of the year before: the year-to-date value of the last December before the month, on a dense frame."""
    before = Window.partitionBy(*dims).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    december = F.when(month_of(F.col("period")) == 12, F.col(ytd))
    return df.withColumn(out, F.last(december, ignorenulls=True).over(before))


def with_year_before(df: DataFrame, dims: list[str], year: str, value: str, out: str) -> DataFrame:
    """The value of the member one year earlier; null where that year has no row."""
    order = Window.partitionBy(*dims).orderBy(year)
    follows = F.lag(year).over(order).cast("int") == F.col(year).cast("int") - 1
    return df.withColumn(out, F.when(follows, F.lag(value).over(order)))


def quarterly(df: DataFrame, dims: list[str], bounds: Bounds = None) -> DataFrame:
    """Quarter amounts as differences of year-to-date values at quarter ends."""
    ends = with_ytd(dense(df, dims, bounds=bounds), dims).where(month_of(F.col("period")).isin(3, 6, 9, 12))
    inside = Window.partitionBy(*dims, year_of(F.col("period"))).orderBy("period")
    before = F.coalesce(F.lag("ytd").over(inside), F.lit(0).cast(MONEY))
    return ends.select(*dims, quarter_of(F.col("period")).alias("quarter"), (F.col("ytd") - before).cast(MONEY).alias("amt"))


def half_yearly(df: DataFrame, dims: list[str], bounds: Bounds = None) -> DataFrame:
    """H1 = ytd of June, H2 = ytd of December less ytd of June."""
    ytd = with_ytd(dense(df, dims, bounds=bounds), dims)
    year, month = year_of(F.col("period")), month_of(F.col("period"))
    june, december = (F.max(F.when(month == m, F.col("ytd"))) for m in (6, 12))
    wide = ytd.groupBy(*dims, year.alias("year")).agg(june.alias("june"), december.alias("december"))
    return wide.select(*dims, "year", F.col("june").alias("h1"), (F.col("december") - F.col("june")).alias("h2"))


def period_guard(asked: DataFrame, data: DataFrame, period: str = "asked", query_time: str | None = None) -> DataFrame:
    """Add Message: the fixed text where the asked month lies outside the data or after the query time."""
    bounds = data.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    outside = (F.col(period) < bounds.select("lo").scalar()) | (F.col(period) > bounds.select("hi").scalar())
    if query_time:
        outside = outside | (F.col(period) > F.col(query_time))
    return asked.withColumn("Message", F.when(outside, MESSAGE))


def cutoff(df: DataFrame, first: str, last: str, query_time: str) -> DataFrame:
    """Months from first to last, no later than the query time."""
    return df.where(F.col("period").between(first, min(last, query_time)))


def default_currency(inside_china: Column, inside_europe: Column) -> Column:
    """CNY if only China is asked for, EUR if only Europe, else USD."""
    return F.when(F.bool_and(inside_china), "CNY").when(F.bool_and(inside_europe), "EUR").otherwise("USD")


def caliber_b(equipment: Column, service: Column) -> tuple[Column, Column]:
    """Caliber B moves 5 % of service revenue to equipment revenue."""
    moved = service * F.lit("0.05").cast("decimal(3,2)")
    return (equipment + moved).cast("decimal(30,6)"), (service - moved).cast("decimal(30,6)")


def wide_to_long(df: DataFrame, keys: list[str], prefix: str = "amt") -> DataFrame:
    """Columns ``<prefix>_<currency>_<caliber>`` to rows (currency, caliber, amt)."""
    columns = [c for c in df.columns if c.startswith(f"{prefix}_")]
    long = df.unpivot(keys, columns, "_name", "amt")
    part = F.split("_name", "_")
    return long.select(*keys, F.upper(part[1]).alias("currency"), F.upper(part[2]).alias("caliber"), "amt")


def long_to_wide(df: DataFrame, keys: list[str], names: list[str], prefix: str = "amt") -> DataFrame:
    """Rows (currency, caliber, amt) to columns ``<prefix>_<currency>_<caliber>``; ``names`` as in usd_a."""
    keyed = df.withColumn("_name", F.lower(F.concat_ws("_", "currency", "caliber")))
    wide = keyed.groupBy(*keys).pivot("_name", names).agg(F.sum("amt"))
    return wide.select(*keys, *[F.col(n).alias(f"{prefix}_{n}") for n in names])


def top_bottom(df: DataFrame, by: list[str], value: str, ties: list[str], k: int) -> DataFrame:
    """The k best and k worst members, with their side and place."""
    best = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    worst = Window.partitionBy(*by).orderBy(F.asc(value), *ties)
    top = df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).withColumn("side", F.lit("top"))
    bottom = df.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def member_rank(df: DataFrame, by: list[str], member: Column, value: str) -> DataFrame:
    """Rank of one member: one more than the members above it, counted without a sort."""
    own = df.where(member).select(*by, F.col(value).alias("own"))
    return (
        df.join(own, by)
        .groupBy(*by, "own")
        .agg((F.count_if(F.col(value) > F.col("own")) + 1).alias("rank"))
        .withColumnRenamed("own", value)
    )


def breakdown(df: DataFrame, member: str, now: str = "amt", before: str = "amt_py") -> DataFrame:
    """Value, prior year, share and growth per member, growth first, the total in the last row."""
    sums = df.groupingSets([[member], []], member).agg(
        F.grouping(member).cast("int").alias("is_total"), F.sum(now).alias(now), F.sum(before).alias(before)
    )
    whole = df.agg(F.sum(now).alias("w")).select("w").scalar()
    return sums.select(
        F.when(F.col("is_total") == 1, "Total").otherwise(F.col(member)).alias(member),
        "is_total",
        F.col(now).cast("double").alias(now),
        F.col(before).cast("double").alias(before),
        divide(F.col(now), whole).alias("share"),
        growth(F.col(now), F.col(before)).alias("yoy"),
    ).orderBy("is_total", F.desc_nulls_last("yoy"), member)


def roi(income: Column, spent: Column) -> Column:
    """Return on investment in percent, three decimals."""
    return F.round(divide(income - spent, spent) * 100, 3)


def hhi(df: DataFrame, by: list[str], value: str = "amt") -> DataFrame:
    """Sum of squared shares: one aggregation, no window over the members."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg((F.sum(x * x) / F.pow(F.sum(F.col(value)).cast("double"), F.lit(2.0))).alias("hhi"))


def hhi_top(df: DataFrame, by: list[str], n: int, ties: list[str], value: str = "amt") -> DataFrame:
    """Squared shares of the whole, summed over the n largest members."""
    largest = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    top = df.withColumn("_place", F.row_number().over(largest)).where(F.col("_place") <= n)
    whole = df.groupBy(*by).agg(F.sum(value).alias("_whole"))
    share = divide(F.col(value), F.col("_whole"))
    return top.join(whole, by).groupBy(*by).agg(F.sum(share * share).alias("hhi"))


def double_factor(df: DataFrame, by: list[str], member: str) -> DataFrame:
    """Structure and margin factor per member. Reads rev, rev_py, cost, cost_py."""
    names = ("rev", "rev_py", "cost", "cost_py")
    whole = df.groupBy(*by).agg(*[F.sum(c).alias(f"t_{c}") for c in names])

    def margin(rev: str, cost: str) -> Column:
        return divide(F.col(rev) - F.col(cost), F.col(rev))

    joined = df.join(whole, by) if by else df.select("*", *[df.agg(F.sum(c).alias(c)).select(c).scalar().alias(f"t_{c}") for c in names])
    share, share_py = divide(F.col("rev"), F.col("t_rev")), divide(F.col("rev_py"), F.col("t_rev_py"))
    structure = (share - share_py) * (margin("rev_py", "cost_py") - margin("t_rev_py", "t_cost_py"))
    factor = share * (margin("rev", "cost") - margin("rev_py", "cost_py"))
    return joined.select(
        *by, member, structure.alias("structure"), factor.alias("margin"), (structure + factor).alias("compound")
    ).orderBy(*by, F.desc_nulls_last("compound"), member)


#: What each form of the double factor takes for revenue and cost; expense is cost and tax.
FACTOR_FORMS = {
    "total": ("rev_eq + rev_sv", "cost_eq + cost_sv + tax"),
    "sales": ("rev_eq + rev_sv", "cost_eq + cost_sv"),
    "equipment": ("rev_eq", "cost_eq"),
    "service": ("rev_sv", "cost_sv"),
}


def factor_forms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums rev_eq, rev_sv, cost_eq, cost_sv and tax to one row per form: form, keys, rev, cost. The sums are worked out once for all forms."""
    forms = F.array(
        *[
            F.struct(F.lit(form).alias("form"), F.expr(rev).cast(MONEY).alias("rev"), F.expr(cost).cast(MONEY).alias("cost"))
            for form, (rev, cost) in FACTOR_FORMS.items()
        ]
    )
    return df.select(*keys, F.inline(forms))


def two_years(df: DataFrame, keys: list[str], year: str, now: str, columns: tuple[str, ...] = ("rev", "cost")) -> DataFrame:
    """The columns of a year and, as ``<name>_py``, of the year before; members without rows in either year are left out."""
    sides = ((now, ""), (str(int(now) - 1), "_py"))
    sums = [F.sum(F.when(F.col(year) == y, F.col(c))).cast(MONEY).alias(f"{c}{end}") for c in columns for y, end in sides]
    here = [F.col(f"{columns[0]}{end}").isNotNull() for _, end in sides]
    return df.groupBy(*keys).agg(*sums).where(here[0] & here[1])


def rolling_three(df: DataFrame, dims: list[str], order: str = "quarter", trailing: bool = False) -> Column:
    """Average over three quarters, centred or trailing; null unless all three are there."""
    frame = (-2, 0) if trailing else (-1, 1)
    window = Window.partitionBy(*dims).orderBy(order).rowsBetween(*frame)
    return F.when(F.count("amt").over(window) == 3, F.sum("amt").over(window).cast("double") / 3)


def with_inflection(df: DataFrame, dims: list[str]) -> DataFrame:
    """'Y' where the direction differs from the direction before; equal values have none."""
    order = Window.partitionBy(*dims).orderBy("period")
    moved = df.withColumn("_move", F.signum(F.col("amt") - F.lag("amt").over(order)))
    changed = F.col("_move") * F.lag("_move").over(order) < 0
    return moved.withColumn("inflection", F.when(changed, "Y").otherwise("N")).drop("_move")


def stars(quarters: DataFrame, dims: list[str], above: float = 0.1, run: int = 3) -> DataFrame:
    """Quarters that end a run of at least ``run`` quarters, each growing by more than ``above``."""
    order = Window.partitionBy(*dims).orderBy("quarter")
    rates = quarters.withColumn("qoq", growth(F.col("amt"), F.lag("amt").over(order)))
    last = order.rowsBetween(1 - run, 0)
    return (
        rates.withColumn("_low", F.min("qoq").over(last))
        .withColumn("_known", F.count("qoq").over(last))
        .where((F.col("_known") == run) & (F.col("_low") > above))
        .drop("_low", "_known")
    )


def closed_quarter(day_asked: str) -> str:
    """The last quarter that is over on a day: 2000-08-15 asks for 2000Q2, 2000-09-30 for 2000Q3."""
    tomorrow = date.fromisoformat(day_asked) + timedelta(days=1)
    index = tomorrow.year * 4 + (tomorrow.month - 1) // 3 - 1
    return f"{index // 4}Q{index % 4 + 1}"


def last_month(quarter: str) -> str:
    return f"{quarter[:4]}{int(quarter[5]) * 3:02d}"


def quarter_number(quarter: Column) -> Column:
    return F.substring(quarter, 1, 4).cast("int") * 4 + F.substring(quarter, 6, 1).cast("int")


def lasting_stars(quarters: DataFrame, dims: list[str], last: str, above: float = 0.1, run: int = 3) -> DataFrame:
    """Members whose growth by more than ``above`` lasts up to the quarter ``last``, for at least ``run`` quarters.

    ``quarters`` are dense. The run is what follows the last quarter that did not grow so (the first quarter of all has no rate and
    counts as such), so one aggregation per member finds it: since, n_quarters, the amounts before and at its end, and the growth between.
    """
    order = Window.partitionBy(*dims).orderBy("quarter")
    rate = growth(F.col("amt"), F.lag("amt").over(order))
    rates = quarters.where(F.col("quarter") <= last).withColumn("_grew", F.coalesce(rate > above, F.lit(False)))
    base = F.max(F.when(~F.col("_grew"), F.struct("quarter", "amt")))
    found = rates.groupBy(*dims).agg(base.alias("_base"), F.max(F.struct("quarter", "amt")).alias("_end"))
    length = quarter_number(F.lit(last)) - quarter_number(F.col("_base.quarter"))
    since = quarter_number(F.col("_base.quarter"))  # quarters count from 1, so this number is the next quarter's from 0
    return found.where((F.col("_end.quarter") == last) & (length >= run)).select(
        *dims,
        F.concat(F.floor(since / 4).cast("string"), F.lit("Q"), (since % 4 + 1).cast("string")).alias("since"),
        length.alias("n_quarters"),
        F.col("_base.amt").alias("amt_before"),
        F.col("_end.amt").alias("amt"),
        growth(F.col("_end.amt"), F.col("_base.amt")).alias("growth"),
    )
