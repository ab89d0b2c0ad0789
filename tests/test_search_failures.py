"""A failed fit is counted and never listed as a result."""

import pytest
from pyspark.sql import functions as F

from athlos.ml import train


class Evaluator:
    def evaluate(self, predicted):
        return float(predicted)


class Model:
    def transform(self, d):
        return 1.0


def folded(spark):
    return spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(20)], "id long, fold long, label double")


def failing(error, when):
    class Estimator:
        def fit(self, d, params):
            if when(params["k"]):
                raise error
            return Model()
    return Estimator()


def test_refused_settings_are_counted_per_family(spark):
    failed = [[], []]
    families = [(failing(ValueError("no"), lambda k: k == 1), [{"k": 1}, {"k": 2}]), (failing(None, lambda k: False), [{"k": 1}])]
    found = train.search_all(families, folded(spark), 2, lambda r: r, Evaluator(), 2, failed)
    assert found == [({"k": 2}, [0.0, 1.0]), ({"k": 1}, [1.0])] and [len(x) for x in failed] == [2, 0]


def test_a_broken_run_is_raised(spark):
    with pytest.raises(ConnectionError, match="executor lost"):
        train.search(failing(ConnectionError("executor lost"), lambda k: k == 1), [{"k": 1}, {"k": 2}], folded(spark), 2, lambda r: r, Evaluator(), 2)


def test_a_family_without_a_fit_is_raised(spark):
    with pytest.raises(RuntimeError, match="all 4 fits of model family 1 failed"):
        train.search(failing(ValueError("no"), lambda k: True), [{"k": 1}, {"k": 2}], folded(spark), 2, lambda r: r, Evaluator(), 2)


def sessions(spark, n=160):
    from athlos.sources.tables import sessions_from_events
    e = spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("ts"),
                              (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"),
                              F.when(F.col("id") % 2 == 0, 10.0).otherwise(120.0).alias("value"), F.lit('{"k": 5}').alias("props"))
    return sessions_from_events(e)


def test_a_failed_last_fit_is_no_row_of_zeros(spark, monkeypatch):
    from athlos.ml.models import resolve
    from athlos.spec import SessionSpec
    spec = SessionSpec(label_parts=("performance_level",))
    run = dict(models=("logreg",), draws=1, folds=2, balance=None)
    rows = train.train_compare(sessions(spark), spec, **run).comparison.collect()
    assert [(r.key, r.failed_fits) for r in rows] == [("logreg", 0), ("rule", 0)]
    real, fits = train.fitted_form, []

    def fails_last(estimator):
        fits.append(estimator)
        return failing(ValueError("no last fit"), lambda k: True) if len(fits) > 2 else real(estimator)
    monkeypatch.setattr(train, "fitted_form", fails_last)
    monkeypatch.setattr(train, "resolve", lambda e, s, n: {"k": 0} if len(fits) > 2 else resolve(e, s, n))
    with pytest.raises(ValueError, match="no last fit"):
        train.train_compare(sessions(spark), spec, **run)
