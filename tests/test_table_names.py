"""Tables that a statement reads."""

from pyspark.sql import functions as F

from ledgerlens.functions import sqltext as S

CASES = {
    "SELECT * FROM a, b AS x, s.c WHERE a.k IN (1, 2) ORDER BY p, q": {"a", "b", "c"},
    'SELECT "from z", \'from y\' FROM "T one" JOIN `u` ON "T one".k = u.k, db.sch."W"': {"t one", "u", "w"},
    "WITH n AS (SELECT k FROM base), m(k) AS (SELECT * FROM n) SELECT * FROM n JOIN m USING (k, l) JOIN other o ON o.k = m.k": {"base", "other"},
    "WITH RECURSIVE r AS (SELECT 1 UNION ALL SELECT k + 1 FROM r, step) SELECT * FROM r": {"step"},
    "SELECT EXTRACT(YEAR FROM d), a IS NOT DISTINCT FROM b, (SELECT max(k) FROM inner_t) FROM t WHERE k IN (SELECT k FROM deep)": {"inner_t", "t", "deep"},
    "SELECT * FROM (SELECT k, l FROM x) s, y LEFT JOIN (p JOIN q ON p.k = q.k) ON y.k = p.k": {"x", "y", "p", "q"},
    "SELECT * FROM range(10) r, LATERAL (SELECT 1 FROM z) l, t": {"z", "t"},
    "SELECT a FROM x UNION SELECT b, c FROM y GROUP BY b, c": {"x", "y"},
    "SELECT '" + "it''s from x, " * 20_000 + "' FROM t": {"t"},
    "select 1": set(),
    "": set(),
}


def test_table_names(spark):
    rows = spark.createDataFrame([(sql,) for sql in CASES], "sql string").select("sql", S.table_names(F.col("sql")).alias("names")).collect()
    assert {r["sql"]: set(r["names"]) for r in rows} == CASES
    assert spark.createDataFrame([(None,)], "sql string").select(S.table_names(F.col("sql"))).first()[0] is None
