"""Least squares of a design that may be rank-deficient.

The one-hot columns of a category add up to one, and so does the intercept: the
normal equations are singular, and infinitely many coefficients fit equally
well. The solution here is the shortest of them (the centred columns'
pseudo-inverse), which doesn't depend on the layout of the rows or on which
level comes first.

One pass: each task adds up weight, weighted columns and labels, and the Gramian
of its rows, in dense blocks of ``ROWS`` rows; Spark adds the entries up by place.
The driver gets (columns + 1)² / 2 sums, whatever the number of rows, and solves by
eigendecomposition, leaving out directions that no row moves along.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.session import ship_package

ROWS = 4096
#: Share of the largest eigenvalue under which a direction counts as none.
RANK_TOLERANCE = 1e-10


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, label, weight) to sums of products (i, j, value), j <= i, of (columns..., label, 1)."""
    total = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            n = part.num_rows
            x = part.column(0).flatten().to_numpy().reshape(n, -1)
            table = np.column_stack([x, part.column(1).to_numpy(), np.ones(n)])
            sums = table.T @ (table * part.column(2).to_numpy()[:, None])
            total = sums if total is None else total + sums
    if total is not None:
        i, j = np.tril_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "value"])


def gramian(rows: DataFrame, features: str, label: str, weight: str | None) -> np.ndarray:
    """Weighted sums of products of all columns, the label and a constant, as a symmetric matrix."""
    ship_package(rows.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    dense = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    sums = dense.mapInArrow(_products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect()
    size = max((r[0] for r in sums), default=-1) + 1
    out = np.zeros((size, size))
    for i, j, value in sums:
        out[i, j] = out[j, i] = value
    return out


def shortest_solution(products: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients of least length among those of least error, and the intercept."""
    total = products[-1, -1]
    mean = products[-1, :-1] / total
    centred = products[:-1, :-1] - total * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(centred[:-1, :-1])
    kept = values > RANK_TOLERANCE * max(values.max(initial=0.0), 1e-300)
    basis = vectors[:, kept]
    beta = basis @ ((basis.T @ centred[:-1, -1]) / values[kept])
    return beta, float(mean[-1] - mean[:-1] @ beta)


class LeastSquaresModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds intercept + coefficients · features."""

    solution = Param(Params._dummy(), "solution", "JSON: intercept, coefficients", typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")

    @property
    def intercept(self) -> float:
        return json.loads(self.getOrDefault(self.solution))["intercept"]

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(json.loads(self.getOrDefault(self.solution))["coefficients"])

    def _transform(self, df: DataFrame) -> DataFrame:
        factors = F.array(*[F.lit(float(x)) for x in self.coefficients])
        terms = F.zip_with(vector_to_array(self.getFeaturesCol()), factors, lambda x, b: x * b)
        return df.withColumn(self.getPredictionCol(), F.lit(self.intercept) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


class LeastSquares(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasWeightCol, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, featuresCol="features", labelCol="label"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(featuresCol=featuresCol, labelCol=labelCol)

    def setWeightCol(self, value: str) -> LeastSquares:
        return self._set(weightCol=value)

    def _fit(self, df: DataFrame) -> LeastSquaresModel:
        weight = self.getWeightCol() if self.isDefined(self.weightCol) else None
        beta, intercept = shortest_solution(gramian(df, self.getFeaturesCol(), self.getLabelCol(), weight))
        model = LeastSquaresModel()
        model._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol(),
                   solution=json.dumps({"intercept": intercept, "coefficients": beta.tolist()}))
        return model
