import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloudtally.functions import numeric, skew, text
from cloudtally.sources.csv_upload import map_headers


def one(spark, expr, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(expr.alias("x")).first().x


def test_half_up_ties_and_extremes(spark):
    rows = [(2.675,), (1.005,), (-2.675,), (0.125,), (2.6749,), (1e17,), (None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "v double").select(numeric.half_up(F.col("v"), 2).alias("x"))
    got = [r.x for r in df.collect()]
    assert got[:7] == [2.68, 1.01, -2.68, 0.13, 2.67, 1e17, None] and math.isnan(got[7])


def test_clamp_keeps_null_and_clips(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (7.0,), (None,)], "v double")
    got = [r.x for r in df.select(numeric.clamp(F.col("v"), 0.0, 1.0).alias("x")).collect()]
    assert got == [0.0, 0.5, 1.0, None]


def test_growth_edge_cases(spark):
    df = spark.createDataFrame(
        [(1.0, None), (None, 1.0), (0.0, 0.0), (5.0, 0.0), (3.0, 2.0)], "cur double, prev double"
    )
    cols = [numeric.pct_change(F.col("cur"), F.col("prev"), k).alias(n) for k, n in ((False, "a"), (True, "b"))]
    got = df.select(*cols).collect()
    assert [r.a for r in got] == [0.0, 0.0, 0.0, 0.0, 0.5]
    assert [r.b for r in got] == [0.0, 0.0, 0.0, math.inf, 0.5]


def test_constant_dimension_scales_to_zero(spark):
    assert one(spark, numeric.scaled(F.col("v"), F.lit(3.0), F.lit(3.0)), v=3.0) == 0.0


def test_region_and_os(spark):
    assert one(spark, text.zone_to_region(F.col("v")), v=" us-east-1b ") == "us-east-1"
    assert one(spark, text.zone_to_region(F.col("v")), v="ap-southeast-2") == "ap-southeast-2"
    assert one(spark, text.os_family(F.col("v")), v="Red Hat Enterprise Linux") == "rhel"
    assert one(spark, text.os_family(F.col("v")), v=" BSD ") == "bsd"


def test_header_map_first_alias_wins():
    got = map_headers(["UsageStartDate", "ProductName", "LineItemResourceId", "UnblendedCost"])
    assert got.found == {
        "date": "UsageStartDate",
        "service": "ProductName",
        "resource_id": "LineItemResourceId",
        "cost": "UnblendedCost",
    }
    assert not got.missing_required and "cpu_avg_pct" in got.missing_optional
    assert map_headers(["date", "cost"]).missing_required == ["service", "resource_id"]


def test_exact_quantiles_and_running_counts(spark):
    random.seed(3)
    data = [("a", float(random.randint(0, 50))) for _ in range(2000)] + [("b", random.random()) for _ in range(777)]
    counts = spark.createDataFrame(data, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    running = skew.running_counts(counts, ["k"], "v", ["n"])
    probs = [0.0, 0.1, 0.5, 0.97, 1.0]
    got = {r.k: r.quantiles for r in skew.quantile_from_counts(running, ["k"], "v", "n", probs).collect()}
    for key in "ab":
        assert np.allclose(got[key], np.quantile([v for k, v in data if k == key], probs))
    last = running.groupBy("k").agg(F.max("cum_n").alias("c"), F.max("all_n").alias("a")).collect()
    assert {(r.k, r.c, r.a) for r in last} == {("a", 2000, 2000), ("b", 777, 777)}


def test_hashed_rank_is_row_number_by_md5(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), F.col("id").cast("string").alias("i"))
    from pyspark.sql import Window

    plain = F.row_number().over(Window.partitionBy("g").orderBy(F.md5("i"))).cast("long")
    got = skew.hashed_rank(df, ["g"], F.col("i")).withColumn("plain", plain)
    assert got.filter("position != plain").count() == 0
    assert got.filter("g").select("group_rows").distinct().first()[0] == 1667


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    # key 0 owns a third of the rows and is salted, the others are not
    big = spark.range(3000).select(
        F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("v")
    )
    other = spark.range(0, 35).select((F.col("id") * 2).alias("k"), (F.col("id") * 10).alias("w"))
    got = skew.spread_join(big, other, ["k"], how, min_rows=500, salts=7)
    want = big.join(other, "k", how)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(
        map(tuple, want.collect()), key=repr
    )


def test_sized_join_takes_the_spread_path_beyond_the_limit(spark):
    big = spark.range(200).select((F.col("id") % 20).alias("k"), "id")
    summary = big.groupBy("k").agg(F.sum("id").alias("s"))
    a = skew.sized_join(big, summary, ["k"])
    b = skew.sized_join(big, summary, ["k"], max_rows=3)
    assert "BroadcastHashJoin" in a._jdf.queryExecution().toString()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


@settings(max_examples=8, deadline=None)
@given(values=st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30))
def test_half_up_stays_within_half_a_unit(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", numeric.half_up(F.col("v"), 2).alias("x"))
    assert all(abs(r.v - r.x) <= 0.005 + 1e-6 for r in df.collect())


def test_sql_functions_agree_with_the_columns(spark):
    from cloudtally.functions import sql
    from cloudtally.operators import anomaly, waste

    sql.register(spark)
    df = spark.createDataFrame(
        [("us-east-1b", "SUSE Linux", 75.0), (" eu-west-1 ", None, 44.9), ("x", " BSD ", 18.0)], "z string, o string, s double"
    )
    both = df.select(
        (F.expr("zone_to_region(z)") == text.zone_to_region(F.col("z"))).alias("a"),
        (F.expr("os_family(o)") == text.os_family(F.col("o"))).alias("b"),
        (F.expr("waste_bucket(s)") == waste.bucket(F.col("s"))).alias("c"),
        (F.expr("incident_severity(s)") == anomaly.severity(F.col("s"))).alias("d"),
    )
    assert all(all(r) for r in both.collect())
