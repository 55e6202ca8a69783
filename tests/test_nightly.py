from pyspark.sql import functions as F

from cloudtally.plans import fixtures as fx
from cloudtally.plans import nightly
from cloudtally.runtime import durable


def test_nightly_run_end_to_end(spark, tiny, tmp_path):
    featured = nightly.canonical(fx.billing(spark, tiny))
    registry, windows = fx.registry(spark, tiny), fx.label_windows(spark, tiny)
    models, registered = nightly.train_and_register(featured, registry, "v99", "2025-01-01", 3, 2, 5, windows)
    active = {r.model_type: r for r in registered.filter("is_active").collect()}
    assert {k: r.version for k, r in active.items()} == {k: "v99" for k in ("waste_classifier", "forecast", "anomaly")}
    assert 0 < active["waste_classifier"].evaluation_metrics["f1_macro"] <= 1
    assert active["forecast"].evaluation_metrics["mape"] > 0 and 0 <= active["anomaly"].evaluation_metrics["f1"] <= 1
    taken = spark.createDataFrame([], "organization_id string, resource_id string, status string")
    cited = spark.createDataFrame([("org-0", "vm-1", "Rightsize first", "c-7")], "organization_id string, resource_id string, title string, chunk_id string")
    results = nightly.infer(featured, models, taken, fx.rates(spark, tiny), cited)
    for _ in range(2):  # a second run of the same day changes nothing
        nightly.save(results, str(tmp_path), "2024-02-01", "v1")
    stored = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in results}
    assert stored["waste_classifications"].count() == results["waste_classifications"].count() > 0
    newest = featured.groupBy("organization_id").agg(F.max("date").alias("date"))
    late = stored["waste_classifications"].join(newest, ["organization_id", "date"], "left_anti")
    assert late.count() == 0
    assert stored["waste_classifications"].filter("shap_top_features is null").count() == 0
    assert stored["forecast_results"].filter("ci_lower > forecast or forecast > ci_upper").count() == 0
    recs = durable(stored["recommendations"])
    again = nightly.infer(featured, models, recs)["recommendations"]
    assert again.join(recs, "resource_id", "left_semi").count() == 0


def test_weekly_drift_decides_per_tenant(spark, tiny):
    state = spark.createDataFrame(
        [(f"org-{i}", None, None, 7 if i == 0 else 1, i == 1) for i in range(5)],
        "organization_id string, current_mape double, baseline_mape double, days_since_last_training int, manual_trigger boolean",
    )
    report, decisions = nightly.weekly_drift(fx.billing(spark, tiny), state)
    assert report.count() == 15
    got = {r.organization_id: r for r in decisions.collect()}
    assert got["org-0"].should_retrain and any("Weekly" in x for x in got["org-0"].reasons)
    assert any("Manual" in x for x in got["org-1"].reasons)
