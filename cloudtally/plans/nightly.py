"""The daily and weekly jobs for all tenants at once.

Tenants are a key, not a loop: each stage is one Spark job over every tenant, and stages hand
over stored tables. Only the newest day of each tenant is appended to the result tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.skew import sized_join
from cloudtally.operators import advice, anomaly, drift, evaluate, features, metrics, quality, waste
from cloudtally.operators import registry as models_registry
from cloudtally.operators.models import attribution, forecast, isolation, waste_classifier
from cloudtally.operators.series import SERIES, fits_plain_window
from cloudtally.runtime import durable
from cloudtally.sources import store

TENANT = ["organization_id"]
KEYS = [*SERIES, "date"]
MIN_INFERENCE_ROWS, MIN_DRIFT_ROWS = 30, 60


@dataclass(frozen=True)
class Models:
    """Everything inference needs; trained by ``train``, one set for all tenants."""

    classifier: object
    forecaster: object
    forest: DataFrame


def canonical(billing: DataFrame) -> DataFrame:
    """Feature table of the tenants with enough rows, stored because every stage reads it."""
    ready = quality.with_enough_rows(billing.filter(F.col("date").isNotNull()), TENANT, MIN_INFERENCE_ROWS)
    # a stored table keeps one row per day; one that does not is cut into stretches instead
    return durable(features.engineer(ready, one_row_per_day=fits_plain_window(ready)))


def train(featured: DataFrame, trees: int = 200, rounds: int = 150, forest_trees: int = 150) -> Models:
    plain = fits_plain_window(featured)
    scored = durable(waste.waste_score(featured, one_row_per_day=plain).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    series = durable(forecast.series_rows(features.daily_series(featured)))
    z = durable(features.lagged_zscore(featured, one_row_per_day=plain))
    return Models(
        waste_classifier.fit(scored, trees=trees),
        forecast.fit(series, rounds=rounds),
        durable(isolation.fit(z, KEYS, trees=forest_trees)),
    )


def train_and_register(
    featured: DataFrame,
    registry: DataFrame,
    version: str,
    training_date: str,
    trees: int = 200,
    rounds: int = 150,
    forest_trees: int = 150,
    windows: DataFrame | None = None,
) -> tuple[Models, DataFrame]:
    """Train on the earlier or stratified 80 %, evaluate on the rest, register and promote.

    Returns the models and the registry with an active entry for each of them, whose metrics are the
    hold-out figures: accuracy and macro F1 of the classifier, MAPE of the forecaster against
    yesterday's cost, and, with labelled ``windows``, F1 of the anomaly scores.
    """
    plain = fits_plain_window(featured)
    scored = durable(waste.waste_score(featured, one_row_per_day=plain).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))
    classifier, report = waste_classifier.train_and_evaluate(scored, trees=trees)
    series = durable(forecast.series_rows(features.daily_series(featured)))
    forecaster = forecast.fit(series, rounds=rounds)
    errors = forecast.evaluation(forecast.predict(forecaster, series)).agg(
        F.avg("model_mape").alias("mape"), F.avg("persistence_mape").alias("naive")
    )
    z = durable(features.lagged_zscore(featured, one_row_per_day=plain))
    forest = durable(isolation.fit(z, KEYS, trees=forest_trees))
    found = None
    if windows is not None:
        found = evaluate.anomaly_evaluation(durable(isolation.detect(z, forest, KEYS)), windows).agg(F.avg("f1").alias("f1")).first()
    r, e = report.first(), errors.first()
    figures = {
        "waste_classifier": {"accuracy": r.accuracy, "f1_macro": r.f1_macro},
        "forecast": {"mape": e.mape, "error_reduction_pct": (e.naive - e.mape) / e.naive * 100 if e.naive else 0.0},
        "anomaly": {"f1": found.f1} if found else {},
    }
    entry = [(kind, version, training_date, {k: float(v) for k, v in m.items()}, False) for kind, m in figures.items()]
    rows = featured.sparkSession.createDataFrame(
        entry, "model_type string, version string, training_date string, evaluation_metrics map<string,double>, is_active boolean"
    ).withColumn("training_date", F.col("training_date").cast(registry.schema["training_date"].dataType))
    out = models_registry.register(registry, rows)
    for kind in figures:
        out = models_registry.promote(out, kind, version)
    return Models(classifier, forecaster, forest), out


def infer(
    featured: DataFrame,
    models: Models,
    open_recommendations: DataFrame,
    rates: DataFrame | None = None,
    cited: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Result tables of one run. A tenant's newest day only; forecasts are one row per series.

    ``rates`` (see ``gold.rates``) price the recommendations; ``cited`` is the best guidance
    passage per tenant and resource (title, chunk_id).
    """
    newest = metrics.newest_dates(featured).withColumnRenamed("_last", "date")

    def today(df):
        return sized_join(df, newest, [*TENANT, "date"], "left_semi")

    series = durable(forecast.series_rows(features.daily_series(featured)))
    predicted = durable(forecast.predict(models.forecaster, series))
    forecasts = forecast.latest(predicted)

    plain = fits_plain_window(featured)
    z = durable(features.lagged_zscore(featured, one_row_per_day=plain))
    anomalies = durable(today(isolation.detect(z, models.forest, KEYS)))

    scored = durable(today(waste.waste_score(featured, one_row_per_day=plain)))
    judged = waste_classifier.predict(models.classifier, scored)
    reasons = attribution.top_contributions(
        attribution.contributions(
            models.classifier, scored, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, KEYS
        )
    ).select(*KEYS, F.col("output").alias("bucket"), F.col("top_features").alias("shap_top_features"))
    classified = durable(judged.join(reasons, [*KEYS, "bucket"], "left"))

    # confidence inputs come from this run: classifier, incident score and forecast band
    width = (F.col("ci_upper") - F.col("ci_lower")) / F.greatest(F.col("forecast"), F.lit(1.0))
    sure = forecasts.filter(F.col("level") == "per_service").select(
        *TENANT, "service", F.greatest(F.lit(0.0), 1 - width).alias("forecast_confidence")
    )
    full = classified.join(anomalies.select(*KEYS, "incident_score"), KEYS, "left")
    full = sized_join(full, sure, [*TENANT, "service"]) if "service" in full.columns else full
    recommendations = advice.recommend(advice.without_open(full, open_recommendations), rates)
    if cited is not None:
        recommendations = advice.with_citation(recommendations, cited)
    return {
        "forecast_results": forecasts,
        "anomalies": anomalies.withColumn("is_ground_truth_eval", F.lit(False)),
        "incident_scores": anomaly.incident_daily(anomalies),
        "waste_classifications": classified.select(
            *KEYS, "waste_score", "bucket", "predicted_bucket", "classifier_confidence", "shap_top_features"
        ),
        "recommendations": recommendations.withColumn("status", F.lit("open")),
    }


def save(results: dict[str, DataFrame], folder: str, run_date: str, model_version: str) -> None:
    """Write one run; running the same day again replaces that day's partition."""
    for name, df in results.items():
        stamped = df.withColumns(
            {"model_version": F.lit(model_version), "run_date": F.lit(run_date).cast("date")}
        )
        store.write_partitions(stamped, f"{folder}/{name}", ["run_date"])


def weekly_drift(billing: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drift report, retraining decisions) for the tenants with enough rows."""
    ready = quality.with_enough_rows(billing.filter(F.col("date").isNotNull()), TENANT, MIN_DRIFT_ROWS)
    report = durable(drift.drift_report(drift.split_by_time(durable(ready))))
    return report, drift.retraining_policy(report, state)
