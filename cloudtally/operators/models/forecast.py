"""Daily cost forecasts with a calibrated band, one pooled model for every series.

Labels and cost features are standardised per series, so one boosted model each for the median (absolute
loss) and for the two tails (pinball loss, ``quantile_boost``) serves all tenants and services. A day's band is its
own three quantiles put in order. It is then widened, never narrowed, by what its series shows: an
order statistic of the misses on calibration days that the tails were not fitted on, and the
percentiles of the median's training residuals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from weakref import WeakKeyDictionary

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudtally.functions.numeric import half_up
from cloudtally.operators import evaluate, features
from cloudtally.operators.models import attribution, quantile_boost
from cloudtally.operators.series import by_day
from cloudtally.runtime import durable

LEAST_TRAINING_DAYS = 8  # eight of ten days, the least a series must have
SERIES_KEY = ("organization_id", "level", "service_key")
COST_FEATURES = ("rolling_avg_7d", "rolling_avg_30d", "lag_1d", "lag_7d")
TAILS = (0.05, 0.95)
LEVEL = 0.9  # share of days that a band should hold
FITTED_SHARE = 0.8  # of a series' training days; the later ones calibrate its band
INPUTS = ("day_of_week", "day_of_month", *COST_FEATURES, "active_resource_count")


def series_rows(daily: DataFrame, include_current: bool = False) -> DataFrame:
    """Supervised rows with the chronological 80 % marked; a tenant's total has service key ''."""
    keyed = daily.withColumn("service_key", F.coalesce("service", F.lit("")))
    sup = features.supervised(keyed, SERIES_KEY, include_current)
    return evaluate.chronological_split(sup, SERIES_KEY)


def standardised(rows: DataFrame) -> DataFrame:
    """Features and label in units of their series' training mean and spread.

    The statistics are one row per series. A series with fewer than ``LEAST_TRAINING_DAYS`` training
    days is left out of the model and of its forecasts; ``left_out`` lists those.
    """
    stats = (
        rows.filter("is_train")
        .groupBy(*SERIES_KEY)
        .agg(F.avg("cost").alias("_mean"), F.stddev_samp("cost").alias("_std"), F.count("*").alias("_n"))
        .filter(F.col("_n") >= LEAST_TRAINING_DAYS)
        .withColumn("_std", F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0)))
        .drop("_n")
    )
    joined = mark_calibration(rows).join(stats, list(SERIES_KEY))
    unit = {c: (F.coalesce(F.col(c), F.col("_mean")) - F.col("_mean")) / F.col("_std") for c in COST_FEATURES}
    named = joined.withColumns({f"_x_{c}": e for c, e in unit.items()}).withColumns(
        {
            f"_x_{c}": F.col(c).cast("double")
            for c in ("day_of_week", "day_of_month", "active_resource_count")
        }
    )
    out = named.withColumn("label", (F.col("cost") - F.col("_mean")) / F.col("_std"))
    inputs = [f"_x_{c}" for c in INPUTS]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out).drop(*inputs)


def mark_calibration(rows: DataFrame) -> DataFrame:
    """Mark each series' later training days, from which the width of its band is learnt."""
    n = F.count_if("is_train").over(Window.partitionBy(*SERIES_KEY))
    fitted = F.floor(n * F.lit(FITTED_SHARE).cast("decimal(9,6)"))
    return rows.withColumn("is_calibration", F.col("is_train") & (F.row_number().over(by_day(SERIES_KEY)) > fitted))


def left_out(rows: DataFrame) -> DataFrame:
    """Series too short for a forecast, with their numbers of days and training days."""
    days = rows.groupBy(*SERIES_KEY).agg(F.count("*").alias("n_days"), F.count_if("is_train").alias("n_train_days"))
    return days.filter(F.col("n_train_days") < LEAST_TRAINING_DAYS)


@dataclass
class Forecaster:
    """The median model and the models of the tails."""

    middle: GBTRegressionModel
    tails: list[quantile_boost.QuantileModel] = field(default_factory=list)


_ASSEMBLED: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()


def assembled(rows: DataFrame) -> DataFrame:
    """``standardised`` rows, stored once for fitting, prediction and explanation."""
    if rows not in _ASSEMBLED:
        _ASSEMBLED[rows] = durable(standardised(rows))
    return _ASSEMBLED[rows]


def fit(rows: DataFrame, rounds: int = 150, depth: int = 4, seed: int = 42, tail_rounds: int | None = None) -> Forecaster:
    """Fit the median and both tails; the tails take a tenth of ``rounds``, in larger steps, unless told otherwise."""
    train = assembled(rows).filter("is_train").select("features", "label", "is_calibration")
    train = durable(quantile_boost.compact(train, train.count()))
    trees = GBTRegressor(
        lossType="absolute", maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed
    )
    middle = trees.fit(train.select("features", "label"))
    own = train.filter(~F.col("is_calibration"))
    more = tail_rounds if tail_rounds is not None else max(1, rounds // 10)
    return Forecaster(middle, [quantile_boost.fit(own, p, rounds=more, seed=seed) for p in TAILS])


def predict(model: Forecaster, rows: DataFrame) -> DataFrame:
    """Forecast with ``ci_lower <= forecast <= ci_upper`` for every row, and the three quantiles it comes from."""
    money = lambda c: c * F.col("_std") + F.col("_mean")
    made = model.middle.transform(assembled(rows)).select(
        *rows.columns,
        "is_calibration",
        money(quantile_boost.predicted(model.tails[0])).alias("q_low"),
        money(F.col("prediction")).alias("q_mid"),
        money(quantile_boost.predicted(model.tails[1])).alias("q_high"),
    )
    return with_interval(durable(made)).drop("is_calibration")  # read for the widening and for the rows


def with_interval(made: DataFrame, level: float = LEVEL) -> DataFrame:
    """Add ``forecast``, ``ci_lower`` and ``ci_upper`` to rows with ``q_low``, ``q_mid`` and ``q_high``.

    The three quantiles are put in order first. On a series' ``is_calibration`` days (n of them) the
    ceil((n + 1) ``level``)-th smallest distance outside the two outer ones, or the largest if there are too few
    days, is added on both sides. A series has one row per day, so its distances fit in one buffer.
    """
    three = F.array_sort(F.array("q_low", "q_mid", "q_high"))
    ordered = made.withColumns({"_low": three[0], "forecast": three[1], "_high": three[2]})
    miss = F.greatest(F.col("_low") - F.col("cost"), F.col("cost") - F.col("_high"))
    rank = F.ceil((F.size("_misses") + 1) * F.lit(level).cast("decimal(9,6)"))
    wider = (
        ordered.groupBy(*SERIES_KEY)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("is_calibration"), miss))).alias("_misses"),
            F.percentile(F.when(F.col("is_train"), F.col("cost") - F.col("forecast")), F.array(F.lit(0.02), F.lit(0.98))).alias("_band"),
        )
        .select(
            *SERIES_KEY,
            "_band",
            F.greatest(F.lit(0.0), F.get("_misses", (F.least(rank, F.size("_misses")) - 1).cast("int"))).alias("_wider"),
        )
    )
    low, high = F.col("forecast") + F.get("_band", F.lit(0)), F.col("forecast") + F.get("_band", F.lit(1))
    return ordered.join(wider, list(SERIES_KEY)).select(
        *made.columns,
        "forecast",
        F.least(F.col("_low") - F.col("_wider"), low).alias("ci_lower"),
        F.greatest(F.col("_high") + F.col("_wider"), high).alias("ci_upper"),
    )


def coverage(predicted: DataFrame) -> DataFrame:
    """Held-out days per tenant and level, and the percentages of them below each quantile and inside the band."""
    share = lambda cond: half_up(F.avg(cond.cast("double")) * 100, 2)
    cost = F.col("cost")
    return (
        predicted.filter(~F.col("is_train"))
        .groupBy("organization_id", "level")
        .agg(
            F.count("*").alias("n_test_rows"),
            *[share(cost <= F.col(c)).alias(f"below_{c}_pct") for c in ("q_low", "q_mid", "q_high")],
            share(cost.between(F.col("ci_lower"), F.col("ci_upper"))).alias("inside_pct"),
            half_up(F.avg(F.col("ci_upper") - F.col("ci_lower")), 4).alias("mean_width"),
        )
    )


def inputs(rows: DataFrame, ident: Sequence[str]) -> DataFrame:
    """The model's inputs as columns, behind those that identify a row."""
    x = vector_to_array("features")
    return assembled(rows).select(*ident, *[x[i].alias(c) for i, c in enumerate(INPUTS)])


def explain(model: Forecaster, rows: DataFrame) -> DataFrame:
    """What each input adds to a row's median forecast, in money; base plus contributions is that forecast."""
    ident = [*SERIES_KEY, "date", "_mean", "_std"]
    named = inputs(rows, ident)
    return in_money(attribution.contributions(model.middle, named, INPUTS, ["cost"], ident, classifier=False))


def in_money(explained: DataFrame) -> DataFrame:
    """Contributions in units of a series' spread, scaled back by its ``_mean`` and ``_std``."""
    money = lambda c: F.col(c) * F.col("_std") + F.col("_mean")
    return explained.select(
        *SERIES_KEY,
        "date",
        money("base_value").alias("base_value"),
        money("prediction").alias("prediction"),
        F.transform_values("contributions", lambda _, v: v * F.col("_std")).alias("contributions"),
    )


def with_band(made: DataFrame) -> DataFrame:
    """Add ``ci_lower`` and ``ci_upper`` to rows that have a forecast but no quantiles.

    The band is the 2nd to 98th percentile of the series' training residuals; a series has at
    most one row per day, so its exact percentiles fit in one aggregation buffer.
    """
    band = (
        made.filter("is_train")
        .groupBy(*SERIES_KEY)
        .agg(F.percentile(F.col("cost") - F.col("forecast"), F.array(F.lit(0.02), F.lit(0.98))).alias("_band"))
    )
    low = F.col("forecast") + F.get("_band", F.lit(0))
    high = F.col("forecast") + F.get("_band", F.lit(1))
    return made.join(band, list(SERIES_KEY)).select(
        *[c for c in made.columns if c not in ("service_key", "forecast")],
        "service_key",
        "forecast",
        F.least("forecast", low).alias("ci_lower"),
        F.greatest("forecast", high).alias("ci_upper"),
    )


def latest(predicted: DataFrame, keys: Sequence[str] = SERIES_KEY) -> DataFrame:
    """The forecast of each series' last day, in stored form."""
    best = F.max_by(F.struct("date", "service", "forecast", "ci_lower", "ci_upper", "lag_1d"), "date")
    return predicted.groupBy(*keys).agg(best.alias("p")).select(
        "organization_id",
        "level",
        "p.service",
        F.col("p.date").alias("forecast_date"),
        "p.forecast",
        "p.ci_lower",
        "p.ci_upper",
        F.col("p.lag_1d").alias("naive_baseline"),
    )


def evaluation(predicted: DataFrame) -> DataFrame:
    """Model against yesterday's cost on the held-out rows of each series."""
    # a missing lag takes the next known one, as in the naive evaluation
    ahead = Window.partitionBy(*SERIES_KEY).orderBy(F.desc_nulls_first("date")).rowsBetween(Window.unboundedPreceding, 0)
    naive = F.col("_naive")
    return (
        predicted.filter(~F.col("is_train"))
        .withColumn("_naive", F.last("lag_1d", ignorenulls=True).over(ahead))
        .groupBy(*SERIES_KEY)
        .agg(
            F.count("*").alias("n_test_rows"),
            *evaluate.error_aggs(F.col("cost"), F.col("forecast"), "model_"),
            *evaluate.error_aggs(F.col("cost"), naive, "persistence_"),
        )
        .withColumn(
            "error_reduction_pct",
            evaluate.error_reduction(F.col("persistence_mape"), F.col("model_mape")),
        )
    )
