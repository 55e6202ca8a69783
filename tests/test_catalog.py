"""Every catalog query against its SQL check on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from cloudtally.plans.catalog import ORACLE as CHECKS
from tests.compare import differences

QUERIES = {k: v for k, v in entry.queries().items() if k in entry.QUERIES}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, tiny, name):
    made = []

    def query(session, folder):
        made.append(QUERIES[name](session, folder))
        return made[0]

    why, _ = differences(spark, tiny, query, CHECKS[name])
    assert why is None, why
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"Window.*\n.*Sort.*\n.*Exchange SinglePartition", plan)
    assert "PythonUDF" not in plan


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["organization_id", "service", "bucket", "n"]
    assert df.count() > 0


def test_only_models_lack_a_check():
    assert set(QUERIES) - set(CHECKS) == {
        "waste_clf", "waste_clf_report", "attribution", "forecast", "forecast_eval", "forecast_explained", "iforest", "iforest_sweep", "ann_recall",
    }
