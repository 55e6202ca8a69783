"""Stochastic models are held to invariants, not to numbers."""

import datetime as dt
import math
from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cloudtally import fixed_values as fv
from cloudtally.operators import features
from cloudtally.operators.models import attribution, forecast, isolation, quantile_boost, random_forest, waste_classifier
from cloudtally.operators.series import SERIES, latest_rows
from cloudtally.plans import fixtures as fx
from cloudtally.runtime import durable

KEYS = [*SERIES, "date"]


@pytest.fixture(scope="module")
def scored(spark, tiny):
    return durable(fx.scored(spark, tiny).select(*KEYS, "bucket", *fv.CLASSIFIER_FEATURES))


@pytest.fixture(scope="module")
def forest(scored):
    return waste_classifier.fit(scored, trees=5, depth=5)


def test_classifier_beats_the_majority_class(scored):
    _, report = waste_classifier.train_and_evaluate(scored, trees=20)
    r = report.first()
    counts = [x["count"] for x in scored.groupBy("bucket").count().collect()]
    assert r.accuracy > max(counts) / sum(counts) and 0 < r.f1_macro <= 1


def test_a_forest_grown_in_groups_is_one_forest(scored, monkeypatch):
    assert waste_classifier.group_sizes(500_000, 200) == [200]
    assert waste_classifier.group_sizes(3_200_000, 200) == [100, 100]
    for rows in (32_000_000, 10**10):
        sizes = waste_classifier.group_sizes(rows, 200)
        assert sum(sizes) == 200 and max(sizes) <= 16 and min(sizes) > 1
    n = scored.count()
    monkeypatch.setattr(waste_classifier, "LEAST_TREES", 2)
    monkeypatch.setattr(waste_classifier, "TREE_ROWS", 3 * n)
    model = waste_classifier.fit(scored, trees=7, depth=4)
    assert model.getNumTrees == 7 and len({t.toDebugString for t in model.trees}) == 7
    rows = latest_rows(scored, SERIES).limit(20)
    seen = model.transform(waste_classifier.vectors(rows)).select(*KEYS, vector_to_array("probability").alias("p"))
    told = {tuple(r[:3]): r.p for r in seen.collect()}
    explained = attribution.contributions(model, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, KEYS)
    for r in explained.collect():
        assert r.prediction == pytest.approx(told[tuple(r[:3])][waste_classifier.LABELS.index(r.output)], abs=1e-9)


def _block(rng, rows, bins, labels, many=5):
    """Cells with their bins, labels and counts, and the block that holds them."""
    cell = np.unique(np.column_stack([rng.integers(0, n, rows) for n in [*bins, labels]]), axis=0)
    n = np.sort(np.concatenate([np.ones(len(cell) - many, dtype=np.int64), rng.integers(2, 90, many)]))
    codes = [reduce(lambda code, f: code * bins[f] + cell[:, f], own[1:], cell[:, own[0]]) for own in random_forest.triples(bins)]
    row = {"block": 3, "label": cell[:, -1].astype(np.int32).tobytes(), "n": n.tobytes()}
    return cell, n, random_forest.Block(row | {f"t{k}": c.astype(np.int32).tobytes() for k, c in enumerate(codes)}, bins, labels)


@pytest.mark.parametrize("bins", [[7, 4, 5, 3, 6, 2], [5, 4, 6], [3, 2, 4, 5, 2]])
def test_counts_of_open_nodes_are_those_of_a_walk(bins, monkeypatch):
    monkeypatch.setattr(random_forest, "CHUNK", 100)
    rng = np.random.default_rng(len(bins))
    cell, n, block = _block(rng, 900, bins, 3)
    draws = block.drawn(42, 5)
    assert (draws == block.drawn(42, 5)).all() and (draws != block.drawn(42, 6)).any() and draws.sum() != n.sum()
    boxes = [(np.zeros(len(bins), dtype=int), np.array(bins))]
    while len(boxes) < 100:  # more nodes than a mask has bits
        low, high = boxes.pop(int(rng.integers(len(boxes))))
        f = int(rng.integers(len(bins)))
        if high[f] - low[f] < 2:
            boxes.append((low, high))
            if all((h - l).max() < 2 for l, h in boxes):
                break
            continue
        mid = int(rng.integers(low[f] + 1, high[f]))
        boxes += [(low, np.where(np.arange(len(bins)) == f, mid, high)), (np.where(np.arange(len(bins)) == f, mid, low), high)]
    boxes = boxes[3:]  # some cells lie in leaves
    tree = random_forest.Open(list(range(len(boxes))), np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]), 42, 5)
    got = block.counts(tree, draws)
    for k, (low, high) in enumerate(boxes):
        inside = ((cell[:, :-1] >= low) & (cell[:, :-1] < high)).all(axis=1)
        for j, f in enumerate(tree.tried[k]):
            want = np.zeros(got.shape[2:])
            np.add.at(want, (cell[inside, f], cell[inside, -1]), draws[inside])
            assert (got[k, j] == want).all()


def test_a_cell_draws_what_its_rows_would():
    rng = np.random.default_rng(1)
    _, n, block = _block(rng, 60_000, [32, 32, 32, 32], 2, many=2_000)
    draws = np.array([block.drawn(42, t) for t in range(30)])
    assert draws.shape[1] == len(n) and (draws == draws.round()).all()
    for own in (n == 1, n > 1):  # mean and variance are the number of rows
        assert abs(((draws - n) ** 2)[:, own].mean() / n[own].mean() - 1) < 0.05 and abs(draws[:, own].mean() / n[own].mean() - 1) < 0.02
    share = [(draws[:, n == 1] == k).mean() for k in range(4)]
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(4)], atol=0.002)


def test_the_cut_chosen_is_the_best_of_all():
    rng = np.random.default_rng(6)
    counts, weights = rng.integers(0, 9, (40, 2, 5, 3)), np.array([0.5, 1.0, 3.0])
    counts[:, 1] = 0
    for k in range(40):  # the same draws by another feature
        for c in range(3):
            counts[k, 1, :, c] = rng.multinomial(counts[k, 0, :, c].sum(), [0.2] * 5)
    counts[7], counts[7, :, 2] = 0, (3, 1, 4)  # nothing to cut

    def gini(x):
        w = x * weights
        return 1 - ((w / w.sum()) ** 2).sum(), w.sum()

    place, cut, gain, lower, upper = random_forest.choose(counts, weights)
    for k in range(40):
        best = -1.0
        for f in range(2):
            for j in range(4):
                a, b = counts[k, f, : j + 1].sum(0), counts[k, f, j + 1 :].sum(0)
                if a.sum() and b.sum():
                    whole, mass = gini(a + b)
                    best = max(best, whole - sum(i * m / mass for i, m in (gini(a), gini(b))))
        if k == 7:
            assert place[k] == -1 and (lower[k] == counts[k, 0].sum(0)).all() and not upper[k].any()
            continue
        assert gain[k] == pytest.approx(best)
        assert (lower[k] == counts[k, place[k], : cut[k] + 1].sum(0)).all() and (upper[k] == counts[k, place[k], cut[k] + 1 :].sum(0)).all()


def test_what_is_not_a_number_makes_no_cut():
    values, counts = random_forest.summary(np.array([2.0, np.nan, 1.0, np.nan, 2.0]))
    assert values.tolist() == [1.0, 2.0] and counts.tolist() == [1.0, 2.0]
    values, counts = random_forest.summary(np.concatenate([np.arange(100.0), [np.nan]]), np.full(101, 3.0))
    assert values.max() == 99 and counts.sum() == pytest.approx(300)
    assert [len(a) for a in random_forest.summary(np.array([np.nan]))] == [0, 0]


def test_cuts_are_quantiles_of_all_rows(spark):
    n = 20_000
    rows = spark.range(n, numPartitions=7).select(
        ((F.col("id") * 7919) % n).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(4.0).alias("c"),
        F.when(F.col("id") % 10 < 6, 0.0).otherwise(F.col("id").cast("double")).alias("d"), (F.col("id") % 4).cast("int").alias("label"),
    )
    cuts, sizes = random_forest.cut_points(rows, ["a", "b", "c", "d"], "label")
    assert sizes == {k: n // 4 for k in range(4)}
    assert len(cuts[0]) == 31 and np.allclose(cuts[0], np.arange(1, 32) * n / 32, atol=n / 500)
    assert cuts[1].tolist() == [0.5, 1.5] and not len(cuts[2])
    assert cuts[3][0] == 0 and 10 <= len(cuts[3]) <= 14
    made = random_forest.cells(rows, ["a", "b", "c", "d"], "label", cuts, [0, 1, 2, 3])
    assert made.agg(F.sum("n")).first()[0] == n
    blocks = random_forest.blocks(made).collect()
    got = np.concatenate([np.frombuffer(r.n, np.int64) for r in blocks])
    assert got.sum() == n and len(got) == made.groupBy(*made.columns[:-1]).count().count()


def test_the_leaves_of_a_forest_hold_the_rows_that_reach_them(spark, scored, monkeypatch):
    """Without a bootstrap (each row counts once) the counts of every leaf are those of Spark's own walk, in any blocks."""
    n = scored.count()
    monkeypatch.setattr(random_forest, "BLOCK", n // 3)
    index = F.array_position(F.array(*[F.lit(x) for x in waste_classifier.LABELS]), F.col("bucket")) - 1
    train = scored.withColumn("label", index).na.fill(0.0)
    model = random_forest.fit(train, fv.CLASSIFIER_FEATURES, "label", 4, 3, 6, 42, bootstrap=False)
    reached = model.trees[0].setLeafCol("leaf").transform(waste_classifier.vectors(scored)).groupBy("leaf", "bucket").count().collect()
    stats = {}
    for r in attribution.node_table(model).filter("treeID = 0 AND leftChild < 0").collect():
        stats[r.id] = r.impurityStats
    by_leaf = {}
    for r in reached:
        by_leaf.setdefault(r.leaf, {})[waste_classifier.LABELS.index(r.bucket)] = r["count"]
    sizes = {waste_classifier.LABELS.index(r.bucket): r["count"] for r in scored.groupBy("bucket").count().collect()}
    want = sorted([n / (len(sizes) * sizes[k]) * x.get(k, 0) if k in sizes else 0.0 for k in range(4)] for x in by_leaf.values())
    assert np.allclose(want, sorted(stats.values()))


def test_forest_jobs_do_not_grow_with_the_rows(spark, scored, monkeypatch):
    """Every level of all trees is one pass, where groups of trees were fitted one after the other: 13 of 16 at 32 million rows."""
    passes = []
    level = random_forest._level
    monkeypatch.setattr(random_forest, "_level", lambda *a: passes.append(1) or level(*a))
    monkeypatch.setattr(waste_classifier, "TREE_ROWS", 1)
    model = waste_classifier.fit(scored, trees=40, depth=3)
    assert len(passes) == 3 and model.getNumTrees == 40


def test_predictions_are_those_of_the_model(spark, scored):
    """Also for missing features, and trees of more leaves than a mask has bits."""
    model = waste_classifier.fit(scored, trees=12, depth=8)
    assert max(t.numNodes for t in model.trees) > 128
    odd = scored.limit(400).withColumn("cost", F.lit(None).cast("double"))
    rows = durable(scored.unionByName(odd))
    want = model.transform(waste_classifier.vectors(rows)).select("prediction", F.array_max(vector_to_array("probability")).alias("p"))
    told = waste_classifier.predict(model, rows).select("predicted_bucket", "classifier_confidence")
    order = lambda found: sorted((waste_classifier.LABELS[int(a)] if isinstance(a, float) else a, round(b, 9)) for a, b in found)
    assert order(want.collect()) == order(told.collect())


def test_few_rows_and_one_bucket_make_a_forest(spark, scored):
    one = durable(scored.filter("bucket = 'Idle' OR bucket = 'Healthy'").limit(1))
    model = waste_classifier.fit(one, trees=30, depth=3)
    told = waste_classifier.predict(model, one).first()
    assert told.predicted_bucket == told.bucket and told.classifier_confidence == 1.0
    with pytest.raises(ValueError):
        waste_classifier.fit(scored.filter("bucket IS NULL"))


def test_contributions_add_up_to_the_probability(spark, scored, forest):
    rows = latest_rows(scored, SERIES)
    explained = attribution.contributions(forest, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, KEYS)
    probability = forest.transform(waste_classifier.vectors(rows)).select(
        *KEYS, F.posexplode(vector_to_array("probability")).alias("k", "p")
    )
    names = F.array(*[F.lit(x) for x in waste_classifier.LABELS])
    both = explained.join(
        probability.withColumn("output", F.element_at(names, F.col("k") + 1)), [*KEYS, "output"]
    )
    assert both.count() > 0
    assert both.filter(F.abs(F.col("prediction") - F.col("p")) > 1e-9).count() == 0
    total = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)
    assert both.filter(F.abs(F.col("base_value") + total - F.col("p")) > 1e-9).count() == 0


def test_leaf_shapley_matches_the_definition():
    rng = np.random.default_rng(0)
    path = {0: (-np.inf, 0.5, 0.4), 2: (0.1, 0.9, 0.25), 3: (0.2, np.inf, 0.7)}
    x = rng.random((20, 4))
    got = attribution._leaf_shapley(x, path)
    # average marginal contribution over all orders in which features become known
    from itertools import permutations

    want = {f: np.zeros(20) for f in path}
    orders = list(permutations(path))

    def value(known):
        out = np.ones(20)
        for f, (lo, hi, share) in path.items():
            out *= ((x[:, f] > lo) & (x[:, f] <= hi)) if f in known else share
        return out

    for order in orders:
        known = set()
        for f in order:
            before = value(known)
            known.add(f)
            want[f] += (value(known) - before) / len(orders)
    for f in path:
        assert np.allclose(got[f], want[f])


def test_leaves_in_one_table_explain_what_each_explains_alone(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(attribution, "LEAVES", 7)
    monkeypatch.setattr(attribution, "ROWS", 11)
    leaves = [(rng.random(3), 1.0, {})]
    for _ in range(30):
        path = {}
        for f in rng.permutation(5)[: rng.integers(1, 6)]:
            low, high = np.sort(rng.choice(np.round(np.linspace(0, 1, 9), 3), 2, replace=False))
            path[int(f)] = [(low, high, 0.3), (-np.inf, high, 0.6), (low, np.inf, 0.7)][rng.integers(3)]
        leaves.append((rng.random(3), 0.1, path))
    x = np.round(rng.random((60, 5)) * 8) / 8  # also values at the cuts
    x[0] = np.nan
    want = np.zeros((60, 5, 3))
    for value, _, path in leaves:
        for f, part in attribution._leaf_shapley(x, path).items():
            want[:, f, :] += part[:, None] * value
    boxes = attribution.Boxes(leaves, 5)
    assert np.allclose(boxes.shapley(x[1:], None), want[1:])
    at = rng.integers(-1, 3, 60)
    own = boxes.shapley(x, at)
    assert np.allclose(own[1:][at[1:] >= 0], want[np.arange(60), :, at][1:][at[1:] >= 0]) and not own[at < 0].any()


def test_few_rows_are_explained_by_many_tasks(spark, scored, forest):
    rows = latest_rows(scored, SERIES).coalesce(1)
    told = attribution.contributions(forest, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, [*KEYS, "bucket"], only="bucket")
    assert told.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and told.count() == rows.count()


def test_top_contributions_are_ordered(scored, forest):
    rows = latest_rows(scored, SERIES)
    explained = attribution.contributions(forest, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, KEYS)
    r = attribution.top_contributions(explained, 2).first()
    import json

    top = json.loads(r.top_features)
    assert len(top) == 2 and len(r.narrative.split(", ")) == 2


def test_boosted_trees_explain_themselves(spark):
    rng = np.random.default_rng(4)
    data = [(float(a), float(b), float(3 * a - b)) for a, b in rng.random((300, 2))]
    df = spark.createDataFrame(data, "a double, b double, label double").withColumn("id", F.monotonically_increasing_id())
    from pyspark.ml.regression import GBTRegressor

    train = waste_classifier.vectors(df, ["a", "b"])
    model = GBTRegressor(maxIter=4, maxDepth=3, seed=1).fit(train.select("features", "label"))
    explained = attribution.contributions(model, df, ["a", "b"], ["cost"], ["id"], classifier=False)
    both = explained.drop("output").join(model.transform(train).select("id", F.col("prediction").alias("p")), "id")
    assert both.filter(F.abs(F.col("prediction") - F.col("p")) > 1e-6).count() == 0


@pytest.mark.parametrize("m", [1, 2, 5, 9])
def test_shapley_polynomial_equals_all_coalitions(m):
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(m)
    passes, shares = rng.integers(0, 2, (30, m)).astype(float), rng.uniform(0.05, 1, m).tolist()
    got = attribution._shapley(passes, shares)
    for f in range(m):
        rest, want = [g for g in range(m) if g != f], np.zeros(30)
        for size in range(m):
            for known in combinations(rest, size):
                term = np.prod([passes[:, g] if g in known else np.full(30, shares[g]) for g in rest], axis=0)
                want += factorial(size) * factorial(m - size - 1) / factorial(m) * term
        assert np.allclose(got[:, f], want * (passes[:, f] - shares[f]))


def test_one_output_per_row_is_that_of_all(spark, scored, forest):
    rows = latest_rows(scored, SERIES)
    every = attribution.contributions(forest, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, [*KEYS, "bucket"]).filter("output = bucket")
    own = attribution.contributions(forest, rows, fv.CLASSIFIER_FEATURES, waste_classifier.LABELS, [*KEYS, "bucket"], only="bucket")
    plain = lambda df: sorted((r.resource_id, r.output, round(r.prediction, 9), {k: round(v, 9) for k, v in r.contributions.items()}) for r in df.collect())
    assert plain(own) == plain(every)


def test_quantiles_of_few_groups_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 5000), np.round(rng.normal(0, 5, 5000), 1))] + [(7, 3.0)] * 900 + [(8, None), (9, -1.0)]
    df = durable(spark.createDataFrame(rows, "g int, v double"))
    for prob in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = quantile_boost.few_group_quantiles(df, "g", "v", prob, sketch=20)
        assert set(got) == {0, 1, 2, 3, 7, 9}
        for g, value in got.items():
            own = sorted(v for k, v in rows if k == g and v is not None)
            assert value == own[max(math.ceil(prob * len(own) - 1e-9), 1) - 1]


def test_boosted_quantiles_follow_the_spread(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, 4000)
    y = 10 * x + rng.normal(0, 0.2 + 2 * x)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, label double")
    rows = durable(waste_classifier.vectors(df, ["x"]).select("features", "label").coalesce(1))
    below = {}
    for prob in (0.05, 0.95):
        model = quantile_boost.fit(rows, prob, rounds=40)
        below[prob] = model.predict(np.array([[0.1], [0.9]]))
        share = rows.withColumn("q", quantile_boost.predicted(model)).agg(F.avg((F.col("label") <= F.col("q")).cast("double"))).first()[0]
        assert abs(share - prob) < 0.03
    narrow, wide = below[0.95] - below[0.05]
    assert wide > 2 * narrow
    none = quantile_boost.fit(rows.limit(0), 0.05, rounds=2)
    assert none.trees == [] and none.start == 0.0


def test_days_have_bands_of_their_own(spark, tiny):
    rows = durable(forecast.series_rows(features.daily_series(fx.billing(spark, tiny))))
    model = forecast.fit(rows, rounds=10, tail_rounds=12)
    out = durable(forecast.predict(model, rows))
    assert out.filter("ci_lower > forecast or forecast > ci_upper or ci_lower > least(q_low, q_mid, q_high) or ci_upper < greatest(q_low, q_mid, q_high)").count() == 0
    widths = out.filter("level = 'org_total'").select(F.round(F.col("ci_upper") - F.col("ci_lower"), 4).alias("w"), "organization_id").groupBy("organization_id").agg(F.countDistinct("w").alias("n"))
    assert widths.filter("n < 3").count() == 0
    told = {(r.level): r for r in forecast.coverage(out).collect()}
    assert all(r.inside_pct > 60 for r in told.values())
    explained = forecast.explain(model, rows)
    total = F.aggregate(F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)
    both = explained.join(out.select(*forecast.SERIES_KEY, "date", "q_mid"), [*forecast.SERIES_KEY, "date"])
    assert both.count() == out.count()
    assert both.filter(F.abs(F.col("base_value") + total - F.col("q_mid")) > 1e-6 * F.greatest(F.abs("q_mid"), F.lit(1.0))).count() == 0


def test_forecast_bands_and_holdout(spark, tiny):
    rows = durable(forecast.series_rows(features.daily_series(fx.billing(spark, tiny))))
    model = forecast.fit(rows, rounds=3)
    out = durable(forecast.predict(model, rows))
    assert out.filter("ci_lower > forecast or forecast > ci_upper").count() == 0
    inside = out.filter("is_train").agg(F.avg((F.col("cost").between(F.col("ci_lower"), F.col("ci_upper"))).cast("double")))
    assert inside.first()[0] > 0.9
    last = forecast.latest(out)
    assert last.count() == rows.select("organization_id", "level", "service_key").distinct().count()
    assert forecast.evaluation(out).filter("n_test_rows < 1").count() == 0


def test_isolation_finds_injected_spikes(spark):
    rng = np.random.default_rng(9)
    day = dt.date(2024, 1, 1)
    rows = []
    for r in range(6):
        for i, v in enumerate(rng.normal(100, 3, 120)):
            rows.append(("o", f"r{r}", day + dt.timedelta(days=i), float(v + (80 if i == 100 + r else 0))))
    df = spark.createDataFrame(rows, "organization_id string, resource_id string, date date, cost double")
    z = features.lagged_zscore(df, ["cost"])
    forest = isolation.fit(z, KEYS, trees=30)
    assert forest.select("tree").distinct().count() == 30
    out = isolation.detect(z, forest, KEYS).toPandas()
    assert out["incident_score"].between(0, 100).all()
    out["spike"] = [(d - day).days == 100 + int(r[1:]) for d, r in zip(out["date"], out["resource_id"])]
    assert out.loc[out["spike"], "incident_score"].min() > out["incident_score"].median()
    assert set(out.nlargest(6, "incident_score")["spike"]) == {True}


@pytest.mark.parametrize("rows", [12, 40, 500, 5000])
def test_every_tree_gets_its_sample_whatever_the_number_of_rows(spark, rows):
    z = spark.range(rows).select("id", (F.col("id") % 997).cast("double").alias("cost"), F.lit(0.0).alias("cost_zscore"))
    forest = isolation.fit(z, ["id"], trees=10, sample=32).toPandas()
    points = forest.groupby("tree")["points"].first()
    assert len(points) == 10 and points.min() >= min(rows, 20) and points.max() <= 32
    raw = isolation.raw_scores(z, spark.createDataFrame(forest, isolation.NODE), ["id"]).toPandas()["raw_cost"]
    assert raw.between(0, 1).all() and abs(raw.mean() - 0.5) < 0.15  # near one half where depths are as expected


def test_grids_of_a_forest_give_the_depths_of_its_trees():
    rng = np.random.default_rng(4)
    grown = []
    for k in range(40):
        points = np.round(rng.normal(0, 3, (1 if k == 39 else 256, 2)), 1 if k % 2 else 6)
        nodes = pd.DataFrame(isolation._grow(points, rng), columns=["node", "feature", "cut", "left", "right", "length"])
        grown.append(nodes.sort_values("node").to_records(index=False))
    cuts = np.concatenate([t.cut[t.feature >= 0] for t in grown])
    x = np.concatenate([rng.normal(0, 5, (2000, 2)), rng.choice(cuts, (2000, 2)), [[np.inf, -np.inf], [-np.inf, np.inf], [0.0, -0.0]]])
    assert (isolation.Cells(grown).total(x) == sum(isolation.path_lengths(t, x) for t in grown)).all()
