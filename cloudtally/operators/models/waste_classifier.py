"""Random forest on raw features, next to (never on) the waste score."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.operators import evaluate
from cloudtally.operators.models import attribution, random_forest
from cloudtally.operators.series import SERIES
from cloudtally.runtime import durable

LABELS = ("Critical Waste", "Healthy", "Idle", "Underutilized")
FEATURES = fv.CLASSIFIER_FEATURES
TREE_ROWS = 500_000_000  # rows times trees that a task works through at each level
LEAST_TREES = 16  # in a task, for any number of rows


def vectors(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    filled = df.withColumns(
        {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    )
    out = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(filled)
    return out.drop(*[f"_f_{c}" for c in features])


def fit(
    scored: DataFrame, trees: int = 200, depth: int = 8, seed: int = 42
) -> RandomForestClassificationModel:
    """Fit with balanced class weights; all trees are grown on all rows, which are read twice.

    Rows without a bucket teach nothing and are left out. Only what the trees read is kept.
    """
    index = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("bucket")) - 1
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    train = scored.filter(F.col("bucket").isNotNull()).select(*filled, index.alias("label"))
    return random_forest.fit(train, FEATURES, "label", len(LABELS), trees, depth, seed, group_sizes)


def group_sizes(rows: int, trees: int) -> list[int]:
    """How many trees a task grows on so many (distinct) rows, in groups that differ by one at most."""
    at_once = max(LEAST_TREES, TREE_ROWS // max(rows, 1))
    groups = -(-trees // at_once)
    return [trees // groups + (k < trees % groups) for k in range(groups)]


def predict(model: RandomForestClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``predicted_bucket`` and the probability behind it: what the model's own transform gives, for many rows at once."""
    leaves = random_forest.Leaves(attribution.node_table(model).toArrow(), len(FEATURES))
    sent = df.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("struct<place int, confidence double>")
    def judged(x: pd.DataFrame) -> pd.DataFrame:
        p = sent.value.probability(x.to_numpy("float64"))
        return pd.DataFrame({"place": p.argmax(axis=1).astype("int32"), "confidence": p.max(axis=1)})

    names = F.array(*[F.lit(x) for x in LABELS])
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    return (
        df.withColumn("_judged", judged(F.struct(*filled)))
        .withColumn("predicted_bucket", F.element_at(names, F.col("_judged.place") + 1))
        .withColumn("classifier_confidence", F.col("_judged.confidence"))
        .drop("_judged")
    )


def train_and_evaluate(
    scored: DataFrame, trees: int = 200, depth: int = 8
) -> tuple[RandomForestClassificationModel, DataFrame]:
    """Model fitted on the stratified 80 %, and its report on the held-out 20 %."""
    # read by the counts, by every pass of the fit and by the evaluation
    split = durable(evaluate.stratified_split(scored, "bucket", [*SERIES, "date"]))
    model = fit(split.filter(~F.col("is_test")), trees, depth)
    held = predict(model, split.filter("is_test"))
    return model, evaluate.classification_report(evaluate.confusion(held, "bucket", "predicted_bucket"))
