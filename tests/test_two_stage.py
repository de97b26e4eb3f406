"""Composition, constants for stages that have nothing to learn, and saved models."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from signalframe.operators.two_stage import TwoStage, TwoStageModel


def separable(spark, labels, seed=0):
    rng = random.Random(seed)
    rows = [(i, *[rng.gauss(4.0 if k == y else 0.0, 0.4) for k in range(4)], y) for i, y in enumerate(labels)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int")


def estimator():
    return Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features"), LogisticRegression(regParam=0.01)])


def probabilities(model, rows):
    return np.array([r.p for r in model.transform(rows).orderBy("id").collect()])


@pytest.mark.parametrize(("first", "second", "want"), [(1, 1, [0, 0, 1, 0]), (0, 2, [1, 0, 0, 0]), (1, None, [0, 1 / 3, 1 / 3, 1 / 3])])
def test_constant_stages_compose(spark, first, second, want):
    got = TwoStageModel(first, second).transform(separable(spark, [0, 1, 2])).collect()
    assert all(np.allclose(r.p, want) and r.p_need == first and r.y_pred == int(np.argmax(want)) for r in got)


def test_four_classes_are_recovered_and_probabilities_compose(spark, tmp_path):
    labels = [0, 1, 2, 3] * 15
    rows = separable(spark, labels)
    model = TwoStage(estimator(), estimator()).fit(rows)
    out = model.transform(rows).orderBy("id").collect()
    p = np.array([r.p for r in out])
    assert np.allclose(p.sum(1), 1) and [r.y_pred for r in out] == labels
    need = np.array([r.p_need for r in out])
    assert np.allclose(p[:, 1:].sum(1), need) and np.allclose(1 - need, p[:, 0])
    assert set(rows.columns) | {"p", "p_need", "y_pred"} == set(model.transform(rows).columns)
    model.write().overwrite().save(str(tmp_path / "m"))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = TwoStageModel.load(str(tmp_path / "m"))
    assert np.array_equal(probabilities(again, rows), p) and again.getOrDefault("kinds") == 3


def test_one_kind_of_need_takes_all_of_it(spark, tmp_path):
    rows = separable(spark, [0] * 12 + [2] * 12)
    model = TwoStage(estimator(), estimator()).fit(rows)
    p = probabilities(model, rows)
    assert model.second == 1 and np.allclose(p.sum(1), 1) and np.allclose(p[:, [1, 3]], 0)
    model.save(str(tmp_path / "one"))
    assert np.array_equal(probabilities(TwoStageModel.load(str(tmp_path / "one")), rows), p)


def test_one_side_alone_and_unlabelled_rows(spark):
    rows = separable(spark, [0] * 10)
    assert np.allclose(probabilities(TwoStage(estimator(), estimator()).fit(rows), rows), [1, 0, 0, 0])
    helped = separable(spark, [1, 3] * 8)
    model = TwoStage(estimator(), estimator()).fit(helped.unionByName(separable(spark, [0] * 3).selectExpr("id", "a", "b", "c", "d", "cast(null as int) as y")))
    p = probabilities(model, helped)
    assert model.first == 1 and np.allclose(p[:, [0, 2]], 0, atol=1e-6) and np.allclose(p.sum(1), 1)
    # a single row with a need is nothing to learn a kind from
    lone = TwoStage(estimator(), estimator()).fit(separable(spark, [0] * 6 + [2]))
    assert lone.second is None
    assert TwoStage(estimator(), estimator()).fit(rows.limit(0)).first == 0
