"""The shape of physical plans."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES = entry.queries()


def plan(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name",
    ["hhi_top_n", "breakdown", "double_factor", "prior_year", "multi_hop", "ex_match", "align_unordered", "sql_feature_census", "unify_kaggle", "resolve_synonyms"],
)
def test_no_pairing_of_everything(spark, name):
    text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scan_reads_the_needed_columns_and_filters_early(spark):
    text = plan(QUERIES["fact_lookup"](spark, f"{DATA}/sf0.001"))
    assert "GreaterThan(l_quantity,40.0)" in text and "EqualTo(p_brand,Brand#5)" in text
    assert "l_extendedprice" not in text and "p_retailprice" not in text


def test_top_k_sorts_no_more_than_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["top_k"](spark, f"{DATA}/sf0.001"))
    assert "WindowGroupLimit" in plan(QUERIES["top_bottom_n"](spark, f"{DATA}/sf0.001"))


def test_division_prunes_folders(spark):
    text = plan(QUERIES["division_tables"](spark, f"{DATA}/sf0.001"))
    assert "PartitionFilters: [isnotnull(p_type" in text


def test_python_runs_only_in_alignments(spark):
    for name in ("ex_match", "soft_fbeta", "row_fbeta", "norm_cells", "sql_feature_census"):
        text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
        assert "MapInArrow" not in text and "ArrowEvalPython" not in text
    assert "MapInArrow" in plan(QUERIES["align_unordered"](spark, f"{DATA}/sf0.001"))


ONE_SCAN = [
    "ytd_cumulative", "prior_year", "quarterly_from_ytd", "half_yearly", "query_time_cutoff", "view_budget_forecast", "budget_completion", "forecast_accuracy", "target_attainment",
    "time_trend", "growth_rates", "rolling_3q", "inflection_points", "star_products", "cagr", "growth_volatility", "decline_only", "star_products_at",
]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_the_fact_table_is_scanned_once(spark, name):
    text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert text.count("lineitem.parquet") == 1


@pytest.mark.parametrize("name, first", [("query_time_cutoff", "1998-01-01"), ("cagr", "1996-01-01"), ("star_products_at", "1995-01-01")])
def test_months_are_pushed_to_the_scan(spark, name, first):
    text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line and "l_shipdate" in line)
    assert f"GreaterThanOrEqual(l_shipdate,{first}" in pushed and "LessThan(l_shipdate," in pushed


def test_two_years_are_summed_before_they_are_read_twice(spark):
    """The members' sums are staged: what is left of the plan reads no fact table."""
    for name in ("double_factor", "double_factor_forms", "breakdown", "top_bottom_n", "rank_members", "multi_hop", "hhi_top_n"):
        assert "lineitem.parquet" not in plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
