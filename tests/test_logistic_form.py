"""Logistic regression is fitted on centred, dense rows and gives the model of the plain fit; rows lie in as many partitions as cores."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from athlos import session
from athlos.ml.models import CENTRED, candidate, fitted_form, resolve
from athlos.ml.train import _try_fit


def rows(spark, n=400):
    """Two numbers, a constant, a one-hot category of five slots (one never seen); three classes."""
    r = np.random.default_rng(3)
    out = []
    for i in range(n):
        a, b, c = float(r.normal(0, 1)), float(r.normal(5, 2)), int(r.integers(0, 4))
        label = int(a + 0.3 * b + 0.5 * c + r.normal(0, 0.7) > 2) + int(a - b + r.normal(0, 1) > -4)
        out.append((i, float(label), [a, b, 7.0] + [1.0 if c == k else 0.0 for k in range(5)]))
    d = spark.createDataFrame(out, "session_id long, label double, x array<double>")
    return d.withColumn("features", array_to_vector("x")).drop("x")


@pytest.mark.parametrize("setting", [0, 1, 4, 5])
def test_centred_fit_is_the_plain_fit(spark, setting):
    d = rows(spark).persist()
    lr, grid = candidate("logreg")
    params = resolve(lr, grid[setting], 400)
    plain, model = lr.fit(d, params), _try_fit(lr, d, grid[setting], 400)
    assert isinstance(model, PipelineModel)
    form = model.stages[-1]
    assert form.getOrDefault("regParam") == plain.getOrDefault("regParam") and form.getOrDefault("elasticNetParam") == plain.getOrDefault("elasticNetParam")
    assert np.allclose(form.coefficientMatrix.toArray(), plain.coefficientMatrix.toArray(), atol=1e-5)
    shown = lambda m: np.array([r[0] for r in m.transform(d).orderBy("session_id").select(vector_to_array("probability")).collect()])
    assert np.allclose(shown(model), shown(plain), atol=1e-5)
    seen = [r[0] for r in model.transform(d).select(CENTRED).collect()]
    assert all(isinstance(v, DenseVector) for v in seen)
    assert np.abs(np.mean([v.toArray() for v in seen], axis=0)).max() < 1e-9


def test_other_families_are_fitted_as_they_are():
    forest, _ = candidate("forest", scale=0.02)
    assert fitted_form(forest) is forest


def test_empty_partitions_do_not_count_as_spread(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 64)
    cores = spark.sparkContext.defaultParallelism
    rows_ = spark.range(64 * cores).repartition(2 * cores, F.lit(1))            # all rows in one of many partitions
    held = session.spread(rows_, "id")
    assert held.count() == 64 * cores
    assert held.select(F.spark_partition_id()).distinct().count() == cores
