import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import cells as C
from ledgerlens.operators import exact as E
from ledgerlens.operators import rows as R
from tests.helpers import results


def test_rounding_is_that_of_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.0625, 0.1875, -0.0625, 1.0005, 2.0005, 2.0015, -1.0005, 2.675, 1e300, -0.0004, float("inf"), 2.0**42 + 0.123]
    values += [rng.uniform(-100, 100) for _ in range(3000)] + [rng.randint(-(10**7), 10**7) / 2000 for _ in range(5000)]
    values += [rng.randint(-(10**9), 10**9) / 16 for _ in range(3000)]
    frame = spark.createDataFrame([(v, v) for v in values], "x double, y double")
    for digits in (0, 2, 3, 6):
        got = C.with_rounded(frame, ["y"], digits).collect()
        assert all(y == round(x, digits) for x, y in got)


def keys(spark, values, dtype):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = C.with_cells(frame, ["v"], F.col("i").cast("string")).orderBy("i").collect()
    return [(r["v"]["tag"], r["v"]["key"]) for r in rows]


def test_numbers_share_one_key_space(spark):
    one = {keys(spark, [v], t)[0][1] for v, t in ((1, "int"), (1.0, "double"), (True, "boolean"), (decimal.Decimal("1.000"), "decimal(9,3)"))}
    assert one == {"n1"}
    assert keys(spark, [0.0, -0.0], "double")[0][1] == keys(spark, [0.0, -0.0], "double")[1][1] == "n0"
    assert keys(spark, [12345678.125], "double") == [("f", "n12345678.125")]
    assert keys(spark, ["1"], "string") == [("s", "s1")]
    assert keys(spark, [2**60], "bigint")[0][1] == keys(spark, [float(2**60)], "double")[0][1]


def test_null_equals_null_and_nan_equals_nothing(spark):
    assert keys(spark, [None], "int")[0][1] == keys(spark, [None], "string")[0][1] == "z"
    nan = [k for _, k in keys(spark, [float("nan"), float("nan")], "double")]
    assert nan[0] != nan[1]


def test_date_is_not_timestamp(spark):
    day = keys(spark, [datetime.date(2024, 1, 2)], "date")[0]
    moment = keys(spark, [datetime.datetime(2024, 1, 2)], "timestamp_ntz")[0]
    assert day[0] < moment[0] and day[1] != moment[1]


def test_nested_cells_are_rejected(spark):
    frame = spark.createDataFrame([([1],)], "v array<int>")
    with pytest.raises(TypeError):
        C.with_cells(frame, ["v"])


def test_type_sorted_rows(spark):
    """(1.0, 2) and (1, 2.0) hold the same values but sort by type first."""
    ids = spark.createDataFrame([("a", "p", 0, 0, 1.0, 2), ("a", "g", 0, 0, 2.0, 1)], "query_id string, side string, variant int, row_idx bigint, x double, y int")
    rows = R.norm_cells(ids, ["x", "y"])
    bags = {tuple(r[0]) for r in rows.select(C.bag_keys(F.col("cells"))).collect()}
    encoded = {tuple(r[0]) for r in rows.select(C.encoded_keys(F.col("cells"))).collect()}
    assert len(bags) == 1 and len(encoded) == 2
    assert E.ex_multiset(rows).first()["score"] == 0.0


def test_occurrence_numbers(spark):
    row = spark.sql("SELECT array('b', 'a', 'b', 'a', 'a') AS a").select(C.counted_keys(F.col("a"))).first()[0]
    assert [(c["key"], c["ord"]) for c in row] == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]


def test_dense_index_across_chunks(spark):
    frame = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7).alias("o"))
    got = R.dense_index(frame, ["k"], F.col("o"), bits=6).orderBy("k", "o").collect()
    for k in (0, 1):
        assert [r["row_idx"] for r in got if r["k"] == k] == list(range(2500))


def test_nan_rows_never_match(spark):
    rows, pairs = results(spark, {"q": ([(float("nan"),)], [[(float("nan"),)]])}, ["double"])
    assert E.ex_ordered(rows, pairs, dedup=False).first()["score"] == 0.0


def test_common_keys_add_no_chunk_sizes(spark):
    """Only a key of more than a chunk of rows is cut; orders far apart cut no other."""
    cold = spark.range(3000).select((F.col("id") % 100).alias("k"), (F.col("id") * 1_000_003 - 10**9).alias("o"))
    hot = spark.range(500).select(F.lit(7).cast("bigint").alias("k"), (F.col("id") * 50 + 3).alias("o"))
    none = spark.range(90).select(F.lit(None).cast("bigint").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") * 9).alias("o"))
    frame = cold.unionByName(hot).unionByName(none)
    assert sorted(r["k"] for r in R.hot_keys(frame, ["k"], 6).collect() if r["k"] is not None) == [7]
    assert [r["n"] for r in R.with_chunks(frame, F.col("o"), R.hot_keys(frame, ["k"], 6), 6).groupBy("k").agg(F.countDistinct("_chunk").alias("n")).where("k = 5").collect()] == [1]
    got = R.dense_index(frame, ["k"], F.col("o"), bits=6).orderBy("k", "o").collect()
    of = lambda k: [r["row_idx"] for r in got if r["k"] == k]
    assert of(7) == list(range(530)) and of(None) == list(range(45, 90)) and all(of(k) == list(range(30)) for k in (0, 50, 99))


@pytest.mark.parametrize("how", ["ordered", "bag"])
def test_dedup_shuffles_a_row_once(spark, how):
    """Hot tables aside, rows move once: by their table, not by content and again by place."""
    rows = R.norm_cells(spark.createDataFrame([("q", "p", 0, i, i % 3, 1) for i in (4, 9, 2, 7)], "query_id string, side string, variant int, row_idx bigint, a int, b int"), ["a", "b"])
    kept = R.dedup_rows(rows, how)
    assert [(r["row_idx"], r["cells"][0]["key"]) for r in kept.orderBy("row_idx").collect()] == [(0, "n2"), (1, "n1"), (2, "n0")]
    lines = kept._jdf.queryExecution().executedPlan().toString().splitlines()
    top = next(i for i, line in enumerate(lines) if "Union" in line)
    indent = lines[top + 1].index(":- ")
    end = next(i for i, line in enumerate(lines[top:], top) if line[indent:].startswith("+- "))
    few = "\n".join(lines[top:end])  # the tables that are not hot; the second exchange counts the rows of a table
    assert few.count("Exchange hashpartitioning") == 2 and few.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in few
