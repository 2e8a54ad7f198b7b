"""Shape of the physical plans."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.aggregates import top_per_group
from tidemark.sources.files import read_table


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(entry.queries()["a01_parquet_scan"](spark, sf))
    assert "GreaterThan(l_quantity,45.0)" in text and "EqualTo(l_returnflag,R)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {f.split(":")[0] for f in schema.split(",")} == {"l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"}


def test_flagship_reads_only_what_it_needs(spark, sf):
    text = plan(entry.entry(spark))
    assert "l_tax" not in " ".join(re.findall(r"ReadSchema: (.*)", text))
    assert "TakeOrderedAndProject" in text


def test_top_k_limits_before_the_shuffle(spark, sf):
    df = top_per_group(read_table(spark, f"{sf}/lineitem.parquet"), ["l_suppkey"], [F.desc("l_extendedprice")], 3)
    text = plan(df)
    assert text.index("Partial") and "WindowGroupLimit" in text


@pytest.mark.parametrize("name", [
    "flagship_trader_profit", "d14_position_netting", "c06_asof_nearest", "c14_interval_lookup", "c05_lifecycle_grid", "e06_bounded_fill",
    "i17_pricing_grid", "i41_feature_table", "i42_book_replay", "j10_roc_auc", "b16_quantile_bins", "n04_trade_rules", "g07_coverage_intersection",
])
def test_no_cross_product(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
