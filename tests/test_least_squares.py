"""Least squares of a singular design: numpy's shortest solution, from any layout."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from farebox.operators.least_squares import LeastSquares


@pytest.mark.parametrize("weighted", [False, True])
def test_shortest_solution_as_numpy(spark, weighted):
    rng = np.random.default_rng(3)
    one = np.eye(6)[rng.integers(0, 6, 400)]
    two = np.eye(4)[rng.integers(0, 4, 400)]
    x = np.column_stack([one, two, rng.integers(0, 24, 400), np.zeros(400)])         # singular twice, and a constant column
    y = rng.normal(size=400) + x @ rng.normal(size=12)
    w = rng.integers(1, 5, 400).astype(float) if weighted else np.ones(400)
    df = spark.createDataFrame([(Vectors.dense(a), float(b), float(c)) for a, b, c in zip(x, y, w)], ["features", "label", "weight"])
    learner = LeastSquares()
    model = (learner.setWeightCol("weight") if weighted else learner).fit(df.repartition(5))
    mean = (w[:, None] * x).sum(axis=0) / w.sum()
    centre = np.sqrt(w)[:, None] * (x - mean)
    beta = np.linalg.lstsq(centre, np.sqrt(w) * (y - (w * y).sum() / w.sum()), rcond=1e-10)[0]
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-9)
    assert np.isclose(model.intercept, (w * y).sum() / w.sum() - mean @ beta)
    got = model.transform(df).agg(F.sum((F.col("prediction") - F.col("label")) * F.col("weight"))).first()[0]
    assert abs(got) < 1e-6


def test_constant_label_and_one_row(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 0.0]), 4.0)], ["features", "label"])
    model = LeastSquares().fit(df)
    assert model.intercept == 4.0 and model.coefficients.toArray().tolist() == [0.0, 0.0]
