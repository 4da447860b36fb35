"""Scores of fitted models in a session that has been used before."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strataflow.operators import calibration as C
from strataflow.operators import modeling as ML


@pytest.fixture
def observed(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}


@pytest.fixture
def rows(spark):
    x = spark.range(60).selectExpr("id AS subject_id", "'val' AS fold_id", "CAST(id % 7 > 2 AS INT) AS label", "id % 7 / 7D AS x")
    return x.withColumn("features", array_to_vector(F.array("x", F.expr("1 - x"))))


@pytest.mark.parametrize("kind, params", [("lr", {"regParam": 0.1}), ("rf", {"numTrees": 3}), ("gbt", {"maxIter": 2})])
def test_scores_after_an_observed_job(rows, observed, kind, params):
    """A training summary holds the session, which can't be sent to tasks once it has observed a job."""
    model = ML.make_estimator(kind, **params).fit(rows)
    scored = ML.score(model, rows).toPandas()
    assert len(scored) == 60
    for r in scored.itertuples():
        x = (r.ids % 7) / 7
        assert r.pred_probs == pytest.approx(model.predictProbability(Vectors.dense(x, 1 - x))[1], abs=1e-12)


def test_forest_calibration_after_an_observed_job(rows, observed):
    scored = rows.selectExpr("label AS labels", "0.1 + 0.8 * x AS pred_probs")
    assert C.forest_calibration_error(scored).first()["performance"] < 0.5
