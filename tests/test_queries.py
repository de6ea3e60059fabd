"""Every registered query against its SQL check, on whole tables at the smallest scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from urlguard.operators import training as tr
from urlguard.plans import model_queries as mq
from urlguard.plans.inputs import Inputs

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()
QUERIES = entry.queries()
# Training takes minutes at full settings: the same queries run here with small ones.
TRAINED = {
    "m01_gradient_boosting": lambda i: mq.boosting(i, 3), "m02_soft_vote": lambda i: mq.soft_vote(i, 0.02),
    "m03_calibrated": lambda i: mq.calibrated(i, 2, 2), "m04_classifier_zoo": lambda i: mq.classifiers(i, 2),
    "m12_importances": lambda i: mq.ranked_features(i, 3), "s16_saved_model": lambda i: mq.saved(i, 2, 2),
    "v01_model_scan": lambda i: mq.checked_scan(i, 2, 2),
    "m06_depth_sweep": None, "m06_trees_sweep": None, "m06_rate_sweep": None, "m06_boosted_depth_sweep": None, "m06_svm_grid": None,
}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(name for name, build in TRAINED.items() if build))
def test_trained_query_equals_sql(spark, con, name):
    problem, _ = compare(TRAINED[name](Inputs(spark, FOLDER)), con, CHECKS[name])
    assert problem is None


def test_sweep_equals_sql(spark, con):
    found = mq.swept(tr.sweep(mq.parts(Inputs(spark, FOLDER))[0], tr.DecisionTreeClassifier(seed=1), {"maxDepth": [1, 2]}), "maxDepth")
    assert compare(found, con, "SELECT 'maxDepth' AS parameter, CAST(unnest([1, 2]) AS DOUBLE) AS value, 1 AS tried")[0] is None


@pytest.mark.parametrize("name", sorted(set(CHECKS) - set(TRAINED)))
def test_query_equals_sql(spark, con, name):
    frame = QUERIES[name](spark, FOLDER)
    problem, _ = compare(frame, con, CHECKS[name])
    assert problem is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).first().total > 0


def test_names_match():
    assert set(CHECKS) <= set(QUERIES)
