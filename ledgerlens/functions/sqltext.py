"""Tests on SQL text, by regular expression only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quoted text is kept, line and block comments go; any ORDER BY counts.
COMMENTS = r"""('[^']*'|"[^"]*")|--[^\n]*|/\*[\s\S]*?\*/"""
ORDER_BY = r"(?i)\border\s+by\b"

# The profiled SQL features and the text that shows them.
FEATURES = {
    "GROUP BY": r"(?i)\bgroup\s+by\b",
    "ORDER BY": ORDER_BY,
    "CASE WHEN": r"(?i)\bcase\s+when\b",
    "COALESCE": r"(?i)\bcoalesce\s*\(",
    "Subquery": r"(?i)\(\s*select\b",
    "OVER": r"(?i)\bover\s*\(",
    "LIMIT": r"(?i)\blimit\b",
    "WITH": r"(?i)^\s*with\b",
    "HAVING": r"(?i)\bhaving\b",
    "DISTINCT": r"(?i)\bdistinct\b",
    "JOIN": r"(?i)\bjoin\b",
    "CAST": r"(?i)\bcast\s*\(",
    "UNION": r"(?i)\bunion\b",
}
TABLE_NAME = r"(?i)\b(?:from|join)\s+([A-Za-z_][A-Za-z0-9_]*)"


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, COMMENTS, "$1")


def has_order_by(sql: Column) -> Column:
    return F.coalesce(strip_comments(sql).rlike(ORDER_BY), F.lit(False))


def features(sql: Column) -> Column:
    """Names of the features the statement shows."""
    shown = F.array(*[F.when(sql.rlike(pattern), F.lit(name)) for name, pattern in FEATURES.items()])
    return F.array_compact(shown)


# The tokens of a statement, quoted text and quoted names whole; words that end the tables of a FROM clause.
TOKENS = r"""'[^']*'|"[^"]*"|`[^`]*`|[A-Za-z_][A-Za-z0-9_$]*|[0-9]+|[^\s]"""
AFTER_TABLES = ("where", "group", "order", "having", "limit", "offset", "qualify", "window", "fetch")
SET_WORDS = ("union", "except", "intersect")
TABLE_PREFIXES = ("lateral", "only")


def table_names(sql: Column) -> Column:
    """The tables a statement without comments reads, in lower case, without qualifiers; names of WITH parts are none.

    One fold over the tokens. The state holds, per open parenthesis, what may come next: ``open`` (no SELECT yet), ``select``,
    ``expect`` (a table), ``named`` (just after one), ``dot``, ``after`` (its alias or condition), ``with`` and ``part`` (a WITH list).
    """
    text = F.array().cast("array<string>")
    start = F.struct(F.array(F.lit("open")).alias("modes"), text.alias("names"), text.alias("parts"), F.lit("").alias("before"))

    def read(state: Column, token: Column) -> Column:
        modes, names, parts, low = state["modes"], state["names"], state["parts"], F.lower(token)
        depth = F.size(modes)
        mode = F.element_at(modes, -1)
        outer = F.slice(modes, 1, depth - 1)
        plain = low.rlike("^[a-z_]")
        quoted = low.rlike('^["`]')
        name = F.when(quoted, F.substring(low, F.lit(2), F.length(low) - 2)).otherwise(low)
        named = plain | quoted
        expects = (mode == "expect") & named & ~low.isin("select", "with", "values", *TABLE_PREFIXES)
        to_tables = (low == "join") | ((low == "from") & ~mode.isin("open", "with", "part") & (state["before"] != "distinct"))
        after = (
            F.when(mode.isin("expect", "dot") & (expects | (named & (mode == "dot"))), "named")
            .when((low == "with") & mode.isin("open", "expect"), "with")
            .when((mode == "with") & named & (low != "recursive"), "part")
            .when((mode == "part") & (low == ","), "with")
            .when(low == "select", "select")
            .when(low.isin(*SET_WORDS) & (mode != "part"), "open")
            .when(to_tables, "expect")
            .when((mode == "expect") & low.isin(*TABLE_PREFIXES), "expect")
            .when(mode.isin("named", "after") & (low == ","), "expect")
            .when((mode == "named") & (low == "."), "dot")
            .when(mode.isin("named", "after") & low.isin(*AFTER_TABLES), "select")
            .when(mode == "named", "after")
            .otherwise(mode)
        )
        inner = F.when(mode == "expect", "expect").otherwise("open")
        kept = F.when(mode == "expect", "after").when(mode == "named", "after").otherwise(mode)
        new_modes = (
            F.when(token == "(", F.concat(outer, F.array(kept, inner)))
            .when((token == ")") & (depth > 1), outer)
            .otherwise(F.concat(outer, F.array(after)))
        )
        called = (mode == "named") & (token == "(")  # a table function, not a table
        new_names = (
            F.when(expects, F.concat(names, F.array(name)))
            .when((mode == "dot") & named, F.concat(F.slice(names, 1, F.size(names) - 1), F.array(name)))
            .when(called, F.slice(names, 1, F.size(names) - 1))
            .otherwise(names)
        )
        new_parts = F.when((mode == "with") & named & (low != "recursive"), F.concat(parts, F.array(name))).otherwise(parts)
        return F.struct(new_modes.alias("modes"), new_names.alias("names"), new_parts.alias("parts"), low.alias("before"))

    tokens = F.regexp_extract_all(sql, F.lit(TOKENS), F.lit(0))
    return F.aggregate(tokens, start, read, lambda state: F.array_except(state["names"], state["parts"]))
