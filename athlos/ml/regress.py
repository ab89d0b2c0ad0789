"""AD1: regression of the performance score (stated by the reference, without code there).

Same fit-time feature stages as the classifiers; a random-forest regressor or any other; RMSE and R² on the held-out rows of
the stratified split (stratified on the performance level, so every level is in the test part).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import split
from ..session import spread
from ..spec import SEED, SENSOR_COLUMNS, TEST_SHARE
from .features import FeatureLayout, derive, fit_feature_stages

REGRESSION_NUMERIC = SENSOR_COLUMNS + ("injury_risk_score", "hour", "dayofweek")
REGRESSION_CATEGORICAL = ("risk_level", "hr_zone", "event_type")


def performance_regression(df: DataFrame, target: str = "performance_score", id_col: str = "session_id",
                           strata: str = "performance_level", numeric: Sequence[str] = REGRESSION_NUMERIC,
                           categorical: Sequence[str] = REGRESSION_CATEGORICAL, trees: int = 50, depth: int = 10,
                           seed: int = SEED, test_share: float = TEST_SHARE, estimator=None, title: str = "Random Forest") -> tuple:
    """Fit on the training rows; return (pipeline model, one-row metrics DataFrame). ``estimator`` is any regressor over
    the column ``features`` (default: a forest of ``trees`` trees of ``depth``)."""
    d = derive(df.where(F.col(target).isNotNull()))
    d = d.withColumn("__strata", F.coalesce(F.col(strata).cast("string"), F.lit("?")))
    sp = split.cutoff_split(d, "__strata", id_col, test_share, seed, folds=None)
    sp = spread(sp, id_col)
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    layout = FeatureLayout([c for c in numeric if c in d.columns], [c for c in categorical if c in d.columns])
    if estimator is None:
        estimator = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed)
    last = estimator.copy({estimator.featuresCol: "features", estimator.labelCol: target})
    model = Pipeline(stages=fit_feature_stages(train, layout) + [last]).fit(train)
    pred = model.transform(test).select(target, "prediction").persist()
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction")
    rmse, r2 = ev.setMetricName("rmse").evaluate(pred), ev.setMetricName("r2").evaluate(pred)
    spark = df.sparkSession
    n_test = pred.count()
    pred.unpersist()
    metrics = spark.createDataFrame([(title, float(rmse), float(r2), train.count(), n_test)],
                                    "model string, rmse double, r2 double, n_train long, n_test long")
    return model, metrics
