"""The fits of a model search share one queue over folds and families; a fold is balanced once and released; forests keep node ids."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from athlos.ml import train
from athlos.ml.models import candidate


class Model:
    def __init__(self, value):
        self.value = value

    def transform(self, d):
        return self.value


class Evaluator:
    def evaluate(self, predicted):
        return float(predicted)


def folded(spark):
    return spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(20)], "id long, fold long, label double").persist()


def test_a_fold_does_not_wait_for_the_slowest_fit_of_the_last(spark):
    rows, later, waited = folded(spark), threading.Event(), []

    class Estimator:
        def fit(self, d, params):
            if d.first()["fold"] == 0:                  # fold 1 is held out last: its fits see fold 0 only
                later.set()
            elif params["k"] == 1:
                waited.append(later.wait(20))
            return Model(params["k"])
    best, scores = train.search(Estimator(), [{"k": 1}, {"k": 2}], rows, 2, lambda r: r, Evaluator(), 2)
    assert waited == [True] and best == {"k": 2} and scores == [1.0, 2.0]
    rows.unpersist()


def test_families_share_the_balanced_folds_and_release_them(spark):
    rows, made, seen = folded(spark), [], []

    class Estimator:
        def __init__(self, sign):
            self.sign = sign

        def fit(self, d, params):
            seen.append((self.sign, params["k"], d.count(), d.storageLevel.useMemory))
            if params["k"] == 3:
                raise ValueError("no fit")
            return Model(self.sign * params["k"])

    def balance(d):
        made.append(d.unionByName(d.limit(1)))
        return made[-1]
    settings = [{"k": 1}, {"k": 2}, {"k": 3}]
    found = train.search_all([(Estimator(1), settings), (Estimator(-1), settings[:2])], rows, 2, balance, Evaluator(), 3)
    assert found == [({"k": 2}, [1.0, 2.0, 0.0]), ({"k": 1}, [-1.0, -2.0])]
    assert len(made) == 2 and len(seen) == 10 and all(n == 11 and kept for _, _, n, kept in seen)
    assert not any(d.storageLevel.useMemory for d in made)
    rows.unpersist()


def test_a_failing_balance_is_raised(spark):
    rows = folded(spark)

    def balance(d):
        raise RuntimeError("no balance")
    with pytest.raises(RuntimeError, match="no balance"):
        train.search(object(), [{"k": 1}, {"k": 2}], rows, 2, balance, Evaluator(), 2)
    rows.unpersist()


def test_forests_keep_node_ids_and_stay_the_same(spark):
    r = np.random.default_rng(5)
    data = [(float(r.integers(0, 3)), [float(x) for x in r.normal(0, 1, 6)], float(r.uniform(0.5, 2))) for _ in range(600)]
    d = spark.createDataFrame(data, "label double, x array<double>, weight double").withColumn("features", array_to_vector("x")).repartition(3, F.col("weight")).persist()
    forest, grid = candidate("forest", 42, 0.1)
    assert forest.getCacheNodeIds()
    deep = next(g for g in grid if g[forest.maxDepth] == 30)
    assert forest.fit(d, deep).toDebugString.split("\n")[1:] == forest.copy({forest.cacheNodeIds: False}).fit(d, deep).toDebugString.split("\n")[1:]
    d.unpersist()
