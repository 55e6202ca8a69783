"""Physical plans: what must and must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloudtally import runtime
from cloudtally.operators import features, gold, silver
from cloudtally.operators.series import top_rows
from cloudtally.plans import fixtures as fx

LAZY = [
    "rolling_lag", "lagged_zscore", "idle_days", "business_features", "telemetry_clean", "telemetry_daily", "gold",
    "instance_match", "daily_series", "supervised", "chrono_split", "rate_lookup", "pricing_silver", "spec_lookup",
    "incident_fuse", "feature_upsert", "savings_confidence",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_and_no_global_window(spark, tiny, name):
    text = plan(entry.queries()[name](spark, tiny))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Window.*\n.*Sort.*\n.*Exchange SinglePartition", text)
    assert "PythonUDF" not in text and "MapInPandas" not in text


def test_windowed_features_share_one_shuffle(spark, tiny):
    base = spark.createDataFrame(
        [], "organization_id string, resource_id string, date date, cost double, cpu_avg_pct double, memory_avg_pct double"
    )
    assert plan(features.engineer(base)).count("Exchange hashpartitioning") == 1


def test_scan_reads_only_what_is_used(spark, tiny):
    text = plan(features.time_features(fx.billing(spark, tiny).select("organization_id", "resource_id", "date")))
    scan = next(l for l in text.splitlines() if "l_suppkey" in l and "ReadSchema" in l)
    assert "l_extendedprice" not in scan.split("ReadSchema")[1]


def test_filters_reach_the_scan(spark, tiny):
    text = plan(fx.table(spark, tiny, "lineitem").filter(F.col("l_suppkey") == 3).select("l_quantity"))
    assert "EqualTo(l_suppkey,3)" in text


def test_top_rows_prune_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    assert plan(top_rows(df, ["g"], [F.desc("id")], 2)).count("WindowGroupLimit") == 2


def test_spec_matching_needs_no_join(spark):
    df = spark.createDataFrame([], "vm_id string, cpu_cores double, ram_gb double")
    assert "Join" not in plan(gold.match_instances(df))


def test_keep_first_is_an_aggregate(spark):
    df = spark.createDataFrame([], "k string, v int, o int")
    text = plan(silver.keep_first(df, ["k"], ["o"]))
    assert "Window" not in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["telemetry_clean", "naive_eval", "rolling_lag", "lagged_zscore"])
def test_no_frame_is_walked_again_for_every_row(spark, tiny, name):
    frames = plan(entry.queries()[name](spark, tiny))
    assert not re.search(r"specifiedwindowframe\(RowFrame, (currentrow\$\(\)|-?\d+), unboundedfollowing", frames)


def test_line_items_are_dealt_out_before_they_are_summed_and_never_sent_to_all_tasks(spark, tiny):
    text = plan(fx.billing(spark, tiny))
    assert "BuildLeft" not in text  # the dimensions are sent, whatever the sizes that Spark expects
    before, below = text.split("Exchange hashpartitioning(l_suppkey", 1)
    assert "HashAggregate" in before and "HashAggregate" not in below  # no task sums a whole row group of a file


def test_no_task_holds_the_rows_of_a_file_while_it_deals_them_out(spark, tiny):
    few = int(spark.sparkContext.getConf().get(runtime.STREAMED, "200"))
    spark.conf.set(runtime.INITIAL, str(few))
    try:
        text = plan(fx.billing(spark, tiny))
    finally:
        runtime.size_shuffles(spark, None)
    dealt_out = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", text)]
    assert dealt_out == [runtime.FINER * few, few]  # the last is the one that reads the file


def test_both_levels_of_daily_series_read_one_shuffle_of_resources(spark, tiny):
    series = features.daily_series(fx.billing(spark, tiny))
    assert series.count() > 0 and len(series.collect()) == series.count()
    final = plan(series).split("== Initial Plan ==")[0]
    of_resources = [l for l in final.splitlines() if "Exchange hashpartitioning" in l and "resource_id" in l.split("Exchange hashpartitioning(")[1].split(")")[0]]
    assert [("ReusedExchange" in l) for l in of_resources] == [False, True]
    assert "Aggregate" not in final.split(of_resources[0])[1].split("Exchange hashpartitioning(l_suppkey")[0].split("Join")[0]
