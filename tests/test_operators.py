import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.operators import (
    advice, anomaly, drift, evaluate, features, gold, metrics, quality, registry, retrieve, silver, waste,
)
from cloudtally.operators.series import back, in_order, latest_rows, positions, with_lookback
from cloudtally.plans import fixtures as fx

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def series(spark, rows, columns="organization_id string, resource_id string, date date, cost double"):
    return spark.createDataFrame(rows, columns)


# --- quality -----------------------------------------------------------------------------------
def test_each_rule_names_its_rows(spark):
    rows = [
        (11, day(40), "db-7", 3.25, 12.0, 61.0, "eu-west-3"),
        (12, day(40), "db-8", 0.0, 100.0, 0.0, None),
        (13, day(41), "db-7", -0.01, 100.01, 61.0, "eu-west-3"),
        (14, None, "db-9", 7.0, -0.5, -3.0, "eu-west-3"),
    ]
    df = spark.createDataFrame(
        rows, "row_id int, date date, resource_id string, cost double, cpu_avg_pct double, memory_avg_pct double, region string"
    )
    found = quality.failures(df, require_region=True)
    by_row = {}
    for r in found.collect():
        by_row.setdefault(r.row_id, set()).add(r.rule)
    assert by_row == {12: {"missing_region"}, 13: {"negative_price", "impossible_cpu_value"}, 14: {"missing_timestamp", "impossible_cpu_value", "negative_memory"}}
    first = quality.summary(df, found).first()
    assert (first.total_rows, first.total_failures) == (4, 6)
    logged = quality.audit_records(found, "csv_upload").groupBy("severity").count().collect()
    assert sum(r["count"] for r in logged) == 6


def test_missing_dates_count_as_equal_and_nan_is_missing(spark):
    df = spark.createDataFrame(
        [(1, None, "r", float("nan")), (2, None, "r", 1.0), (3, DAY, "r", 1.0)],
        "row_id int, date date, resource_id string, cpu_avg_pct double",
    )
    rules = [(r.row_id, r.rule) for r in quality.failures(df).collect()]
    assert sorted(rules) == [
        (1, "duplicated_resource_id"), (1, "missing_timestamp"),
        (2, "duplicated_resource_id"), (2, "missing_timestamp"),
    ]


def test_required_columns_are_checked_while_planning(spark):
    with pytest.raises(ValueError, match="resource_id"):
        quality.require(spark.range(1), ["id", "resource_id"])


def test_min_rows_gate_and_filters(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert {r.k for r in quality.with_enough_rows(df, ["k"], 2).collect()} == {"a"}
    assert quality.only(df, k="b", v=None).count() == 1


# --- series --------------------------------------------------------------------------------------
def test_stretches_equal_the_plain_window(spark):
    rng = np.random.default_rng(5)
    rows = [
        ("o", f"r{int(k)}", day(int(n)), float(c))
        for k in range(3)
        for n, c in zip(rng.permutation(400)[:300], rng.random(300).round(4))
    ]
    df = series(spark, rows)

    def build(w):
        return {"s": F.sum("cost").over(w.rowsBetween(-6, 0)), "l": F.lag("cost", 7).over(w)}

    plain = with_lookback(df, build, lookback=7)
    cut = with_lookback(df, build, lookback=7, one_row_per_day=False, stretch_rows=16)
    a = {(r.resource_id, r.date): (round(r.s, 9), r.l) for r in plain.collect()}
    b = {(r.resource_id, r.date): (round(r.s, 9), r.l) for r in cut.collect()}
    assert a == b and len(a) == 900


def test_positions_number_repeated_and_missing_days(spark):
    rows = [("o", "r", day(i % 5), float(i)) for i in range(60)] + [("o", "r", None, float(i)) for i in range(7)]
    got = positions(series(spark, rows), ["organization_id", "resource_id"]).collect()
    assert sorted(r.position for r in got) == list(range(1, 68))
    dated = [r for r in got if r.date]
    assert all(a.date <= b.date for a, b in zip(sorted(dated, key=lambda r: r.position), sorted(dated, key=lambda r: r.position)[1:]))
    assert min(r.position for r in got if r.date is None) == 61


def test_latest_rows_with_and_without_ties(spark):
    rows = [("o", "r", day(1), 1.0), ("o", "r", day(2), 2.0), ("o", "r", day(2), 3.0), ("o", "q", day(1), 4.0)]
    df = series(spark, rows)
    assert latest_rows(df, ["resource_id"], keep_ties=True).count() == 3
    assert latest_rows(df, ["resource_id"]).count() == 2


def test_growth_of_single_row_zero_and_repeats(spark):
    rows = [("o", "a", day(0), 5.0), ("o", "b", day(0), 0.0), ("o", "b", day(1), 4.0), ("o", "b", day(2), 6.0)]
    for one in (True, False):
        got = {(r.resource_id, r.runtime_days): r.cost_growth_rate for r in features.growth(series(spark, rows), one_row_per_day=one).collect()}
        assert got == {("a", 1): 0.0, ("b", 1): 0.0, ("b", 2): 0.0, ("b", 3): 0.5}


def test_zscore_matches_pandas(spark):
    rng = np.random.default_rng(1)
    rows = [("o", k, day(i), float(v)) for k in "ab" for i, v in enumerate(rng.normal(100, 5, 80).round(3))]
    rows += [("o", "flat", day(i), 7.0) for i in range(60)]
    got = features.lagged_zscore(series(spark, rows), ["cost"]).toPandas().sort_values(["resource_id", "date"])
    pdf = pd.DataFrame(rows, columns=["o", "resource_id", "date", "cost"]).sort_values(["resource_id", "date"])
    lag = pdf.groupby("resource_id")["cost"].shift(7)
    base = lag.groupby(pdf["resource_id"])
    mean = base.transform(lambda s: s.rolling(30, min_periods=5).mean())
    std = base.transform(lambda s: s.rolling(30, min_periods=5).std()).replace(0, np.nan)
    want = ((pdf["cost"] - mean) / std).fillna(0.0).clip(-10, 10)
    flat = (pdf["resource_id"] == "flat").to_numpy()
    assert np.allclose(got["cost_zscore"].to_numpy()[~flat], want.to_numpy()[~flat])
    assert (got["cost_zscore"].to_numpy()[flat] == 0).all()


def test_supervised_does_not_leak_the_current_day(spark):
    daily = spark.createDataFrame([("s", day(i), float(i)) for i in range(10)], "service string, date date, cost double")
    rows = {r.date: r for r in features.supervised(daily).collect()}
    assert rows[day(0)].rolling_avg_7d is None and rows[day(9)].rolling_avg_7d == 5.0
    leaky = {r.date: r for r in features.supervised(daily, include_current=True).collect()}
    assert leaky[day(0)].rolling_avg_7d == 0.0 and leaky[day(9)].rolling_avg_7d == 6.0


def test_engineer_is_the_same_on_both_paths(spark, tiny):
    base = fx.billing(spark, tiny).filter("organization_id = 'org-1'")
    a = features.engineer(base).select("resource_id", "date", "rolling_avg_cost_7d", "lag_cost_7d", "runtime_days", "resource_age_days")
    b = features.engineer(base, one_row_per_day=False).select(*a.columns)

    def rounded(df):
        return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.na.fill(-1).collect())

    assert rounded(a) == rounded(b)


# --- waste and anomalies ------------------------------------------------------------------------------
def test_weights_without_utilisation():
    w = waste.weights_for(["cost_growth_rate", "anomaly_history_count"])
    assert w == pytest.approx({"growth": 2 / 3, "history": 1 / 3})
    assert waste.weights_for(["cost"]) == {}


def test_waste_score_without_cpu(spark):
    df = spark.createDataFrame(
        [("o", "r", day(0), 0.0, 1), ("o", "r", day(1), 1.0, 0)],
        "organization_id string, resource_id string, date date, cost_growth_rate double, anomaly_history_count int",
    )
    got = {r.date: (r.waste_score, r.bucket) for r in waste.waste_score(df).collect()}
    assert got == {day(0): (33.33, "Underutilized"), day(1): (66.67, "Idle")}


def test_waste_score_works_out_its_windows_once(spark, tiny):
    scored = waste.waste_score(features.growth(fx.billing(spark, tiny)))
    assert "Window" not in scored._jdf.queryExecution().executedPlan().toString()


def test_incident_score_renormalises_and_bands(spark):
    df = spark.createDataFrame([(100.0, None), (40.0, 20.0)], "anomaly_score_cost double, anomaly_score_disk_io double")
    got = [(r.incident_score, r.severity) for r in anomaly.fuse(df).collect()]
    assert got == [(70.0, "critical"), (34.0, "high")]


def test_overlapping_label_windows_count_once(spark):
    w = spark.createDataFrame(
        [("o", "r", day(0), day(3)), ("o", "r", day(2), day(5)), ("o", "q", day(4), day(1)), ("p", "r", day(6), day(6))],
        "organization_id string, resource_id string, start_date date, end_date date",
    )
    assert evaluate.labelled_days(w).count() == 7
    rows = [("o", "r", day(5), 1.0), ("o", "r", day(6), 1.0), ("p", "r", day(6), 1.0)]
    marked = evaluate.mark_truth(series(spark, rows), w)
    assert {(r.organization_id, r.date): r.is_true_anomaly for r in marked.collect()} == {("o", day(5)): True, ("o", day(6)): False, ("p", day(6)): True}
    counts = anomaly.history_counts(series(spark, rows), w).collect()
    assert {(r.organization_id, r.anomaly_history_count) for r in counts} == {("o", 2), ("p", 1)}


def test_long_windows_take_few_cells(spark):
    rng = random.Random(5)
    spans = [(rng.randint(-400, 9000), rng.choice([0, 1, 2, 6, 7, 365, 3650, 40_000, -1])) for _ in range(300)]
    w = spark.createDataFrame(
        [("o", f"r{k % 40}", day(a), day(a + n)) for k, (a, n) in enumerate(spans)], "organization_id string, resource_id string, start_date date, end_date date"
    )
    for r in evaluate.window_cells(w).collect():
        n = (r.end_date - r.start_date).days + 1
        assert len(r.cells) == 0 if n <= 0 else 1 <= len(r.cells) <= max(2 * math.log2(n), 1)
        assert sum(1 << (c >> 40) for c in r.cells) == max(n, 0)
    rows = [("o", f"r{rng.randrange(42)}", day(rng.randint(-500, 50_000)), 1.0) for _ in range(2000)]
    marked = evaluate.mark_truth(series(spark, rows), w).collect()
    held = {}
    for k, (a, n) in enumerate(spans):
        held.setdefault(f"r{k % 40}", []).append((day(a), day(a + n)))
    assert len(marked) == 2000
    assert all(r.is_true_anomaly == any(a <= r.date <= b for a, b in held.get(r.resource_id, ())) for r in marked)


def test_matching_against_a_long_list(spark):
    from cloudtally.operators import gold

    rng = random.Random(6)
    specs = [(k, f"t{k}", float(2 ** rng.randint(0, 7)), rng.choice([0.5, 2.0, 7.5, 16.0, 64.0, 500.0]) * rng.choice([1, 1.25])) for k in range(400)]
    machines = [(k, rng.choice([None, 0.0, 1.0, 3.0, 20.0, 5000.0]), rng.choice([None, 0.0, 1.0, 5.0, 18.75, 40.0, 1e6])) for k in range(300)]
    listed = spark.createDataFrame(specs, "spec_order long, instance_type string, vcpu double, ram_gb double")
    asked = spark.createDataFrame(machines, "vm_id long, cpu_cores double, ram_gb double")
    out = gold.match_instances(asked, specs=listed)
    assert "CartesianProduct" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        if r.cpu_cores is None or r.ram_gb is None:
            assert r.matched_instance_type is None and r.distance is None
            continue
        c, m = r.cpu_cores, r.ram_gb
        fits = [s for s in specs if 0.4 <= s[2] / max(c, 0.01) <= 2.5 and 0.4 <= s[3] / max(m, 0.01) <= 2.5] or specs
        best = min((0.5 * abs(s[2] - c) / max(s[2], c, 1) + 0.5 * abs(s[3] - m) / max(s[3], m, 1), s[0], s[1]) for s in fits)
        assert r.distance == pytest.approx(best[0], abs=1e-4)
        assert r.matched_instance_type == (best[2] if math.exp(-3 * best[0]) >= 0.55 else None)
    none = gold.match_instances(asked.limit(3), specs=listed.limit(0))
    assert none.columns == out.columns and none.count() == 3


def test_types_stay_rows_in_a_long_list(spark):
    from cloudtally.operators import gold

    rng = random.Random(7)
    specs = [(k, f"t{k}", rng.randint(1, 20) / 2, rng.randint(0, 60) / 3) for k in range(900)]
    listed = spark.createDataFrame(specs, "spec_order long, instance_type string, vcpu double, ram_gb double")
    asked = spark.createDataFrame([(k, 1.0 + k % 30, rng.randint(0, 90) / 7) for k in range(200)], "vm_id long, cpu_cores double, ram_gb double")
    sent = gold.nearest_specs(asked, listed)
    assert "collect_list" not in sent._jdf.queryExecution().toString()
    split = gold.nearest_specs(asked, listed, max_rows=10, share=20)
    want = {(c, m): min((0.5 * abs(s[2] - c) / max(s[2], c, 1) + 0.5 * abs(s[3] - m) / max(s[3], m, 1), s[0]) for s in
                        [s for s in specs if 0.4 <= s[2] / c <= 2.5 and 0.4 <= s[3] / max(m, 0.01) <= 2.5] or specs)
            for _, c, m in asked.collect()}
    for out in (sent, split):
        got = {(r.cpu_cores, r.ram_gb): (r._best.distance, r._best.spec_order) for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


# --- silver and gold --------------------------------------------------------------------------------------
def telemetry(spark, rows):
    full = []
    for i, (vm, ts, cpu, mem) in enumerate(rows):
        full.append((vm, ts, 4, 1000.0, cpu, cpu, 4096.0, mem, 1.0, 1.0, 1.0, 1.0, 0, i))
    cols = ", ".join(f"{m} {'int' if m == 'cpu_cores' else 'double'}" for m in silver.METRICS)
    return spark.createDataFrame(full, f"vm_id string, ts timestamp, {cols}, src int, event_id int")


def test_fill_crosses_hours_and_drops_what_has_nothing(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", t, None, 1024.0), ("a", t + dt.timedelta(hours=3), 5.0, 1024.0), ("a", t + dt.timedelta(hours=9), None, 1024.0),
        ("a", t + dt.timedelta(days=40), None, 1024.0), ("empty", t, None, 1024.0),
    ]
    got = silver.clean(telemetry(spark, rows)).orderBy("ts").collect()
    assert [r.cpu_usage_percent for r in got] == [5.0, 5.0, 5.0, 5.0]
    steps = {r.step: (r.row_count, r.dropped) for r in silver.manifest(telemetry(spark, rows)).collect()}
    assert steps["handle_missing_values"] == (4, 1) and steps["resample_daily"] == (2, None)


def test_first_duplicate_is_kept(spark):
    t = dt.datetime(2024, 1, 1)
    got = silver.clean(telemetry(spark, [("a", t, 1.0, 1.0), ("a", t, 2.0, 1.0)])).collect()
    assert [r.cpu_usage_percent for r in got] == [1.0]


def test_matching_ties_range_and_review(spark):
    df = spark.createDataFrame(
        [("tie", 2.0, 8.0), ("huge", 500.0, 4000.0), ("exact", 8.0, 61.0)], "vm_id string, cpu_cores double, ram_gb double"
    )
    got = {r.vm_id: r for r in gold.match_instances(df).collect()}
    assert got["tie"].matched_instance_type == "t3.large" and got["tie"].confidence == 1.0
    assert got["huge"].needs_manual_review and got["huge"].matched_instance_type is None
    assert got["exact"].matched_instance_type == "r4.2xlarge"


def test_rate_tiers_fall_back(spark):
    df = spark.createDataFrame(
        [("M5.large", "spot", 2.0), ("m5.large", "prediction", 9.0), ("c5.large", "other", 3.0), ("zz", "spot", 1.0)],
        "instance_type string, pricing_type string, hourly_rate double",
    )
    assert {(r.instance_type, r.hourly_rate, r.rate_source) for r in gold.rates(df).collect()} == {
        ("m5.large", 2.0, "spot"), ("c5.large", 3.0, "mixed"), ("zz", 1.0, "spot"),
    }


# --- advice ----------------------------------------------------------------------------------------------------
def scored_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "organization_id string, resource_id string, bucket string, instance_type string, cost double, "
        "cpu_avg_pct double, memory_avg_pct double, runtime_days int",
    )


def test_recommendations(spark):
    df = scored_rows(
        spark,
        [
            ("o", "idle", "Idle", None, 24.0, 3.4, 50.0, 12),
            ("o", "small", "Underutilized", "m5.xlarge", 48.0, 25.0, 10.0, 5),
            ("o", "none", "Underutilized", "t3.nano", 48.0, 25.0, 10.0, 5),
            ("o", "fine", "Healthy", "m5.xlarge", 48.0, 90.0, 90.0, 5),
        ],
    )
    got = {r.resource_id: r for r in advice.recommend(df).collect()}
    assert set(got) == {"idle", "small"}
    assert got["idle"].action == "Terminate idle" and got["idle"].estimated_savings == 720.0
    assert got["idle"].reason == "CPU averaged 3% over 12 days (Idle)" and got["idle"].confidence == 69.5
    assert got["idle"].impact_score == 500.4 and got["idle"].impact_tier == "High"
    assert got["small"].action == "Downsize small from m5.xlarge to m5.large"
    assert got["small"].estimated_savings == 720.0
    assert got["small"].reason == "memory utilization averaged 10% over 5 days (Underutilized)"
    rates = spark.createDataFrame([("m5.xlarge", 3.0), ("m5.large", 2.5)], "instance_type string, hourly_rate double")
    listed = {r.resource_id: r.estimated_savings for r in advice.recommend(df, rates).collect()}
    assert listed == {"idle": 720.0, "small": 360.0}


def test_scenario_steps_build_on_each_other(spark):
    billing = spark.createDataFrame(
        [("o", "a", day(0), 10.0, None), ("o", "a", day(1), 10.0, 12.0), ("o", "b", day(1), 5.0, 24.0)],
        "organization_id string, resource_id string, date date, cost double, usage_hours double",
    )
    actions = spark.createDataFrame(
        [("o", 1, "a", "resize", 1.0, 0), ("o", 1, "a", "terminate", None, 1), ("o", 1, "b", "resize", None, 2), ("o", 1, "x", "terminate", None, 3)],
        "organization_id string, scenario_id int, resource_id string, action_type string, new_hourly_rate double, action_order int",
    )
    log = {(r.resource_id, r.action_type): r for r in advice.scenario_log(billing, actions).collect()}
    assert (log["a", "resize"].cost_before, log["a", "resize"].cost_after) == (20.0, 36.0)
    assert (log["a", "terminate"].cost_before, log["a", "terminate"].cost_after) == (36.0, 0.0)
    assert not log["b", "resize"].applied and "required" in log["b", "resize"].note
    assert "not found" in log["x", "terminate"].note
    out = advice.scenarios(billing, actions).first()
    assert (out.current_monthly_cost, out.projected_monthly_cost, out.savings) == (375.0, 75.0, 300.0)


def test_new_service_shows_no_increase(spark):
    df = spark.createDataFrame(
        [("o", "old", day(0), 1.0), ("o", "old", day(60), 4.0), ("o", "new", day(60), 9.0)],
        "organization_id string, service string, date date, cost double",
    )
    got = {r.service: r.increase for r in metrics.service_delta(df).collect()}
    assert got == {"old": 3.0, "new": 0.0}


def test_status_updates_ignore_unknown_values(spark):
    recs = spark.createDataFrame([("1", "open"), ("2", "open"), ("3", "open")], "recommendation_id string, status string")
    ups = spark.createDataFrame([("1", "accepted", 2), ("1", "dismissed", 1), ("2", "gone", 1), ("9", "open", 1), ("3", "accepted", 1), ("3", "open", 2)], "recommendation_id string, new_status string, updated_at int")
    assert sorted(map(tuple, advice.set_status(recs, ups).collect())) == [("1", "accepted"), ("2", "open"), ("3", "open")]


# --- drift ---------------------------------------------------------------------------------------------------------
def test_drift_against_numpy(spark):
    rng = np.random.default_rng(0)
    old, new = rng.normal(50, 10, 3000), rng.normal(65, 12, 800)
    rows = [("o", True, float(v), 1.0) for v in old] + [("o", False, float(v), 1.0) for v in new]
    df = spark.createDataFrame(rows, "organization_id string, is_train boolean, cost double, flat double")
    report = {r.feature: r for r in drift.drift_report(df, ["cost", "flat"]).collect()}
    edges = np.unique(np.quantile(old, np.linspace(0, 1, 11)))
    t, n = np.histogram(old, edges)[0], np.histogram(new, edges)[0]
    t, n = np.clip(t / t.sum(), 1e-4, None), np.clip(n / n.sum(), 1e-4, None)
    assert report["cost"].psi == pytest.approx(np.sum((n - t) * np.log(n / t)), abs=1e-4)
    every = np.sort(np.concatenate([old, new]))
    d = np.abs(np.searchsorted(np.sort(old), every, "right") / 3000 - np.searchsorted(np.sort(new), every, "right") / 800).max()
    assert report["cost"].ks_statistic == pytest.approx(d, abs=1e-4)
    assert report["cost"].psi_drift_detected and report["cost"].ks_drift_detected
    assert report["flat"].psi == 0.0 and report["flat"].ks_pvalue == 1.0


def test_split_keeps_exactly_the_share(spark):
    rows = [("o", f"r{i % 50}", day(i // 50), 1.0) for i in range(1003)]
    got = drift.split_by_time(series(spark, rows))
    assert got.filter("is_train").count() == 802
    old = got.filter("is_train").agg(F.max("date")).first()[0]
    assert got.filter("not is_train").agg(F.min("date")).first()[0] >= old


def test_stratified_split_shares(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("bucket"), "id")
    got = evaluate.stratified_split(df, "bucket", ["id"]).filter("is_test").groupBy("bucket").count()
    assert {tuple(r) for r in got.collect()} == {("big", 180), ("small", 20)}


def test_empty_classes_score_zero(spark):
    m = spark.createDataFrame([("a", "a", 8), ("b", "a", 2)], "actual string, predicted string, n int")
    r = evaluate.classification_report(m).first()
    assert (r.accuracy, r.precision_macro, r.recall_macro, r.labels) == (0.8, 0.4, 0.5, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_days_give_one_order_on_both_paths(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [("o", f"r{k % 2}", dt.date(2024, 1, 1 + k // 6), float(v)) for k, v in enumerate(rng.permutation(60))]
    rng.shuffle(rows)
    rows = [(o, r, d.item() if hasattr(d, "item") else d, float(c)) for o, r, d, c in rows]
    df = spark.createDataFrame(rows, "organization_id string, resource_id string, date date, cost double").repartition(3)
    made = []
    for plain in (True, False):
        out = features.rolling_lag(features.growth(df, one_row_per_day=plain), one_row_per_day=plain)
        made.append({(r.resource_id, r.date, r.cost): (r.runtime_days, r.lag_cost_1d, r.cost_growth_rate) for r in out.collect()})
    assert made[0] == made[1] and len(made[0]) == 60


# --- retrieval, registry ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("query_bytes", [1 << 20, 400])
def test_top_k_matches_brute_force_however_many_queries(spark, query_bytes):
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(200, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id int, embedding array<double>")
    asked = df.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    corpus = df.filter("vec_id >= 20")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.top_k(asked, corpus, query_bytes=query_bytes).collect()}
    for q in range(20):
        best = 20 + np.argsort(-(vec[20:] @ vec[q]))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == best.tolist()


@pytest.mark.parametrize(
    "question, intent, extra",
    [
        ("Why did my bill increase?", "bill_increase_explanation", {}),
        ("Which instances should I terminate?", "termination_candidates", {}),
        ("Show idle resources in us-east-1", "idle_resources", {"region": "us-east-1"}),
        ("Compare last month vs this month", "period_comparison", {}),
        ("Which VM had the highest network usage?", "highest_metric_resource", {"metric": "network"}),
        ("Forecast EC2 cost for next week", "forecast_request", {"service": "EC2"}),
        ("EC2 hello", "general_question", {}),
    ],
)
def test_intents(spark, question, intent, extra):
    r = retrieve.tag_questions(spark.createDataFrame([(question,)], "question string")).first()
    assert r.intent == intent
    assert {k: r[k] for k in ("region", "service", "metric") if r[k]} == extra


def test_registry_has_one_active_version_per_type(spark, tiny):
    out = registry.promote(fx.registry(spark, tiny), "anomaly", "v1")
    assert [r.version for r in out.filter("is_active and model_type = 'anomaly'").collect()] == ["v1"]
    assert registry.train_gate(out).first().models_exist
    without = out.filter("model_type != 'anomaly'")
    assert [r.model_type for r in registry.missing_types(without).collect()] == ["anomaly"]


def test_series_length_decides_the_window(spark):
    from cloudtally.operators.series import fits_plain_window

    df = series(spark, [("o", "r", day(i), 1.0) for i in range(20)])
    assert fits_plain_window(df) and not fits_plain_window(df, limit=19)


def test_lists_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 8)) + rng.integers(0, 5, (700, 1))
    x[5] = x[6] = x[7]
    corpus = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    asked = corpus.filter("vec_id % 20 = 0 or vec_id = 5").selectExpr("vec_id as query_id", "embedding")
    lists = retrieve.build_lists(corpus, retrieve.fit_centres(corpus, n_lists=23))
    assert lists.sizes.sum() == 700
    want = sorted(map(tuple, retrieve.top_k(asked, corpus, k=5).collect()))
    for size in (retrieve.QUERY_BYTES, 900):
        assert sorted(map(tuple, retrieve.search_lists(asked, lists, k=5, probes=1, query_bytes=size).collect())) == want
    probes = retrieve.calibrate(asked, lists, k=5)
    assert 1 <= probes <= 23
    some = retrieve.search_lists(asked, lists, k=5, probes=probes, exact=False)
    assert retrieve.recall(some, retrieve.top_k(asked, corpus, k=5)).first().recall >= 0.9
    assert retrieve.search_lists(asked.limit(0), lists).count() == 0
    none = retrieve.build_lists(corpus.limit(0), retrieve.fit_centres(corpus.limit(0)))
    assert retrieve.search_lists(asked, none).count() == 0


def test_recall_of_calibrated_lists(spark):
    from cloudtally.plans.catalog import QUERIES

    r = QUERIES["ann_recall"](spark, "/root/testdata/sf0.1").first()
    assert r.recall >= 0.9 and r.n_exact > 0


def test_sweep_reads_every_threshold_off_one_curve(spark):
    rng = random.Random(3)
    rows = [("o" if k % 3 else "p", f"r{k % 9}", day(k % 40), float(rng.choice([1, 2, 5, 5, 9, 30, 77.5]))) for k in range(400)]
    df = series(spark, rows, "organization_id string, resource_id string, date date, incident_score double")
    w = spark.createDataFrame([("o", f"r{k}", day(3 * k), day(3 * k + 9)) for k in range(6)], "organization_id string, resource_id string, start_date date, end_date date")
    sweep = {(r.organization_id, r.percentile): r for r in evaluate.anomaly_sweep(df, w).collect()}
    assert len(sweep) == 40
    for p in (80, 91, 97, 99):
        one = {r.organization_id: r for r in evaluate.anomaly_evaluation(df, w, percentile=p / 100).collect()}
        for org, r in one.items():
            s = sweep[org, p]
            assert s.score_threshold == pytest.approx(r.score_threshold)
            for c in ("true_positives", "false_positives", "false_negatives", "true_negatives", "precision", "recall", "f1"):
                assert s[c] == r[c], (org, p, c)
    best = {r.organization_id: r.f1 for r in evaluate.best_percentile(evaluate.anomaly_sweep(df, w)).collect()}
    assert best == {o: max(s.f1 for (q, _), s in sweep.items() if q == o) for o in ("o", "p")}


@pytest.mark.parametrize("one_row_per_day", [True, False])
def test_zscore_frames_equal_those_of_spark_across_batches(spark, one_row_per_day):
    rng = np.random.default_rng(3)
    odd = {5: None, 40: None, 41: float("nan"), 90: float("inf"), 130: 1e12}
    rows = [("o", f"r{k}", day(i), odd.get(i, float(v)) if k == 1 else float(v)) for k in range(4) for i, v in enumerate(rng.normal(100, 5, 150))]
    df = series(spark, rows)
    w = back(in_order(df, ["organization_id", "resource_id"]), 30, -7)
    std, avg = F.stddev_samp("cost").over(w), F.avg("cost").over(w)
    want = df.select("resource_id", "date", F.when((F.count("cost").over(w) >= 5) & (std > 0), (F.col("cost") - avg) / std).alias("raw"))
    want = want.select("resource_id", "date", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.coalesce("raw", F.lit(0.0)))).alias("z"))
    want = {(r.resource_id, r.date): r.z for r in want.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        found = features.lagged_zscore(df, ["cost"], one_row_per_day=one_row_per_day)
        got = {(r.resource_id, r.date): r.cost_zscore for r in found.collect()}
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == 600
    assert "stddev" not in text  # no sliding frame is summed again for every row


def test_daily_series_counts_a_resource_of_two_services_once_and_expands_nothing(spark):
    rows = [("o", day(0), "a", "r", 0.1), ("o", day(0), "a", "r", 0.2), ("o", day(0), "b", "r", 1.0), ("o", day(0), "b", None, 5.0), (None, day(1), "a", "q", 2.0), ("o", None, "a", "r", 9.0), ("o", day(0), None, "r", 9.0)]
    out = features.daily_series(spark.createDataFrame(rows, "organization_id string, date date, service string, resource_id string, cost double"))
    got = {(r.organization_id, r.date, r.level, r.service): (r.cost, r.active_resource_count) for r in out.collect()}
    assert got == {
        ("o", day(0), "org_total", None): (6.3, 1), ("o", day(0), "per_service", "a"): (0.3, 1), ("o", day(0), "per_service", "b"): (6.0, 1),
        (None, day(1), "org_total", None): (2.0, 1), (None, day(1), "per_service", "a"): (2.0, 1),
    }
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_task_has_a_bounded_share_of_files_and_shuffles(spark):
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"):
        assert int(spark.conf.get(key).removesuffix("m")) <= 16
