"""Splits, thresholds and quality figures for scores, classes and forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.functions.numeric import half_up, no_nan
from cloudtally.functions.skew import hashed_rank, quantile_from_counts, running_counts, sized_join
from cloudtally.operators.series import by_day
from cloudtally.runtime import durable

TENANT = ("organization_id",)


# --- splits -------------------------------------------------------------------------------------
def chronological_split(daily: DataFrame, keys: Sequence[str] = ("service",), share: float = 0.8) -> DataFrame:
    """First ``int(n * share)`` days of each daily series are training rows."""
    w = by_day(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    cut = F.floor(n * F.lit(share).cast("decimal(9,6)"))
    return daily.withColumn("is_train", F.row_number().over(w) <= cut)


def stratified_split(
    df: DataFrame, label: str, ident: Sequence[str], test_share: float = 0.2
) -> DataFrame:
    """Hold out the same share of every label, chosen by the hash order of the row's identity."""
    code = F.concat_ws("|", *[F.col(c).cast("string") for c in ident])
    ranked = hashed_rank(df, [label], code)
    held = F.floor(F.col("group_rows") * F.lit(test_share).cast("decimal(9,6)"))
    return ranked.withColumn("is_test", F.col("position") <= held).drop("position", "group_rows")


# --- anomaly scores against labelled windows ----------------------------------------------------
def labelled_days(windows: DataFrame, key: str = "resource_id", tenant: Sequence[str] = TENANT) -> DataFrame:
    """One row per (tenant, resource, day) inside any labelled window; overlaps count once."""
    days = F.explode(F.sequence(F.col("start_date"), F.col("end_date")))
    return windows.filter(F.col("start_date") <= F.col("end_date")).select(
        *[t for t in tenant if t in windows.columns], key, days.alias("date")
    ).distinct()


LEVELS = 20  # the largest cell has 2^20 days, more than dates can tell


def _day(c: str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def _cell(level: int, index: Column) -> Column:
    return F.shiftleft(F.lit(level).cast("long"), 40) + index.cast("long")


def window_cells(windows: DataFrame, key: str = "resource_id", tenant: Sequence[str] = TENANT) -> DataFrame:
    """Each window as the fewest cells of 1, 2, 4, ... days that begin at multiples of their size.

    On every level at most one cell at each end of the window is left over for it, so a window of n days takes at
    most 2 log2(n) cells, however long. Windows without days have none.
    """
    first, behind = _day("start_date"), _day("end_date") + 1
    ends = []
    for level in range(LEVELS):
        low, high = F.shiftright(first + ((1 << level) - 1), level), F.shiftright(behind, level)
        ends += [F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), _cell(level, low)), F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), _cell(level, high - 1))]
    low, high = F.shiftright(first + ((1 << LEVELS) - 1), LEVELS), F.shiftright(behind, LEVELS)
    top = F.when(low < high, F.transform(F.sequence(low, high - 1), lambda i: _cell(LEVELS, i)))
    cells = F.concat(F.array_compact(F.array(*ends)), F.coalesce(top, F.array().cast("array<bigint>")))
    return windows.select(*[t for t in tenant if t in windows.columns], key, "start_date", "end_date", cells.alias("cells"))


def mark_truth(
    df: DataFrame, windows: DataFrame, key: str = "resource_id", tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Whether each row's date lies in a window of its (tenant, resource); both tables carry the tenant or neither.

    A date lies in one cell of each size, so the interval test asks whether any of these is among the cells of
    the resource's windows. The windows' table is one row per resource and no row is multiplied; equal cells of overlapping
    windows count once, so a resource has at most as many cells as there are of them on the calendar.
    """
    own = [t for t in tenant if t in df.columns or t in windows.columns]
    each = window_cells(windows, key, own).select(*own, key, F.explode("cells").alias("_cell")).distinct()
    truth = each.groupBy(*own, key).agg(F.collect_list("_cell").alias("_cells"))
    day = _day("date")
    around = F.array(*[_cell(level, F.shiftright(day, level)) for level in range(LEVELS + 1)])
    return sized_join(df, truth, [*own, key]).withColumn(
        "is_true_anomaly", F.coalesce(F.arrays_overlap("_cells", around), F.lit(False))
    ).drop("_cells")


def exact_quantile(
    df: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = TENANT
) -> DataFrame:
    """Linearly interpolated quantiles per key, exact for any number of rows."""
    counts = (
        df.filter(no_nan(F.col(column)).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count("*").alias("n"))
    )
    running = running_counts(counts, keys, column, ["n"])
    return quantile_from_counts(running, keys, column, "n", probs)


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def anomaly_evaluation(
    scored: DataFrame,
    windows: DataFrame,
    threshold: float | None = None,
    percentile: float = fv.ANOMALY_PERCENTILE,
    tenant: Sequence[str] = TENANT,
) -> DataFrame:
    """Confusion counts, precision, recall and F1 per tenant at a score threshold."""
    tenant = list(tenant)
    if threshold is None:
        limits = exact_quantile(scored, "incident_score", [percentile], tenant).select(
            *tenant, F.get("quantiles", F.lit(0)).alias("score_threshold")
        )
        scored = sized_join(scored, limits, tenant)
    else:
        scored = scored.withColumn("score_threshold", F.lit(float(threshold)))
    t, p = F.col("is_true_anomaly"), F.col("incident_score") >= F.col("score_threshold")
    counts = (
        mark_truth(scored, windows)
        .groupBy(*tenant)
        .agg(
            F.max("score_threshold").alias("score_threshold"),
            F.count_if(t & p).alias("true_positives"),
            F.count_if(~t & p).alias("false_positives"),
            F.count_if(t & ~p).alias("false_negatives"),
            F.count_if(~t & ~p).alias("true_negatives"),
        )
    )
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    precision, recall = _div(tp, tp + fp), _div(tp, tp + fn)
    return counts.withColumns(
        {
            "precision": half_up(precision, 4),
            "recall": half_up(recall, 4),
            "f1": half_up(_div(2 * precision * recall, precision + recall), 4),
        }
    )


SWEPT = tuple(range(80, 100))


def anomaly_sweep(
    scored: DataFrame, windows: DataFrame, percentiles: Sequence[int] = SWEPT, tenant: Sequence[str] = TENANT
) -> DataFrame:
    """Confusion counts, precision, recall and F1 per tenant for thresholds at several percentiles of its scores.

    Scores are counted once, with those on true days beside them; running totals over the ordered scores hold
    the confusion of every threshold there is. Each percentile reads its counts off them, so the
    number of percentiles does not change the number of passes. Rows without a score count nowhere.
    """
    tenant, chosen = list(tenant), list(percentiles)
    marked = mark_truth(scored.filter(no_nan(F.col("incident_score")).isNotNull()), windows)
    counts = marked.groupBy(*tenant, "incident_score").agg(F.count("*").alias("n"), F.count_if("is_true_anomaly").alias("hits"))
    curve = durable(running_counts(counts, tenant, "incident_score", ["n", "hits"]))
    limits = quantile_from_counts(curve, tenant, "incident_score", "n", [p / 100 for p in chosen])
    at = sized_join(curve, limits, tenant)
    below = lambda i, c: F.max(F.when(F.col("incident_score") < F.col("quantiles")[i], F.col(c)))
    one = lambda i, p: F.struct(
        F.lit(p).alias("percentile"),
        F.max(F.col("quantiles")[i]).alias("score_threshold"),
        F.coalesce(below(i, "cum_n"), F.lit(0)).alias("below"),
        F.coalesce(below(i, "cum_hits"), F.lit(0)).alias("missed"),
    )
    whole = at.groupBy(*tenant).agg(
        F.max("all_n").alias("rows"), F.max("all_hits").alias("true_rows"), F.array(*[one(i, p) for i, p in enumerate(chosen)]).alias("swept")
    )
    each = whole.select(*tenant, "rows", "true_rows", F.explode("swept").alias("s")).select(*tenant, "rows", "true_rows", "s.*")
    tp = F.col("true_rows") - F.col("missed")
    fp = F.col("rows") - F.col("below") - tp
    precision, recall = _div(tp, tp + fp), _div(tp, F.col("true_rows"))
    return each.select(
        *tenant,
        "percentile",
        "score_threshold",
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        F.col("missed").alias("false_negatives"),
        (F.col("below") - F.col("missed")).alias("true_negatives"),
        half_up(precision, 4).alias("precision"),
        half_up(recall, 4).alias("recall"),
        half_up(_div(2 * precision * recall, precision + recall), 4).alias("f1"),
    )


def best_percentile(sweep: DataFrame, tenant: Sequence[str] = TENANT) -> DataFrame:
    """The row of the best F1 per tenant; of equal ones that of the highest percentile."""
    rest = [c for c in sweep.columns if c not in tenant]
    best = F.max_by(F.struct(*rest), F.struct("f1", "percentile"))
    return sweep.groupBy(*tenant).agg(best.alias("b")).select(*tenant, "b.*")


# --- classes ---------------------------------------------------------------------------------------
def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def classification_report(matrix: DataFrame) -> DataFrame:
    """Accuracy and macro precision, recall and F1 from a confusion table (labels x labels rows).

    Labels are the union of actual and predicted ones; an empty class scores 0.
    """
    n, hit = F.col("n"), F.col("actual") == F.col("predicted")
    as_actual = matrix.select(
        F.col("actual").alias("label"), n.alias("support"), F.lit(0).alias("claimed"),
        F.when(hit, n).otherwise(0).alias("hits"),
    )
    as_predicted = matrix.select(
        F.col("predicted").alias("label"), F.lit(0).alias("support"), n.alias("claimed"),
        F.lit(0).alias("hits"),
    )
    per_label = (
        as_actual.unionByName(as_predicted)
        .groupBy("label")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))
    )
    precision, recall = _div(F.col("hits"), F.col("claimed")), _div(F.col("hits"), F.col("support"))
    return per_label.agg(
        half_up(F.sum("hits") / F.sum("support"), 4).alias("accuracy"),
        half_up(F.avg(precision), 4).alias("precision_macro"),
        half_up(F.avg(recall), 4).alias("recall_macro"),
        half_up(F.avg(_div(2 * precision * recall, precision + recall)), 4).alias("f1_macro"),
        F.count("*").alias("labels"),
    )


# --- forecasts -----------------------------------------------------------------------------------------
def error_aggs(actual: Column, predicted: Column, prefix: str = "") -> list[Column]:
    """MAE, RMSE and MAPE as aggregates; a zero actual counts as 1e-6 in the MAPE."""
    miss = actual - predicted
    safe = F.when(actual == 0, F.lit(1e-6)).otherwise(actual)
    return [
        half_up(F.avg(F.abs(miss)), 4).alias(f"{prefix}mae"),
        half_up(F.sqrt(F.avg(miss * miss)), 4).alias(f"{prefix}rmse"),
        half_up(F.avg(F.abs(miss / safe)) * 100, 4).alias(f"{prefix}mape"),
    ]


def error_reduction(naive: Column, model: Column) -> Column:
    """How much lower the model's MAPE is, in percent of the naive one."""
    return half_up(F.coalesce((naive - model) / F.nullif(naive, F.lit(0.0)) * 100, F.lit(0.0)), 2)


def naive_evaluation(supervised: DataFrame, keys: Sequence[str] = ("service",), share: float = 0.8) -> DataFrame:
    """Yesterday and same-day-last-week as forecasts over the held-out tail of each series.

    A gap at the start of the tail takes the next known value, as the baselines always did.
    """
    held = chronological_split(supervised, keys, share).filter(~F.col("is_train"))
    # the next known value is the last one in reverse order, which costs one step per row
    ahead = (
        Window.partitionBy(*keys)
        .orderBy(F.desc_nulls_first("date"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    known = held.withColumns(
        {c: F.last(c, ignorenulls=True).over(ahead) for c in ("lag_1d", "lag_7d")}
    )
    cost = F.col("cost")
    return (
        known.groupBy(*keys)
        .agg(
            F.count("*").alias("n_test_rows"),
            *error_aggs(cost, F.col("lag_1d"), "persistence_"),
            *error_aggs(cost, F.col("lag_7d"), "last_week_"),
        )
        .withColumn(
            "last_week_vs_persistence_pct",
            error_reduction(F.col("persistence_mape"), F.col("last_week_mape")),
        )
    )
