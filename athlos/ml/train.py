"""Training: prepare → label → split → features → search each model family → compare → best bundle (MD5–MD10).

The split is checkpointed into the session's checkpoint folder (``spark.checkpoint.dir``): the search reads the
training rows folds x draws times, and a written copy both cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import IllegalArgumentException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, labels, metrics, split
from ..session import ensure_checkpoint_dir, spread
from ..spec import CV_FOLDS, IMPORTANCE_TOP_N, SEARCH_DRAWS, SEED, TEST_SHARE, SessionSpec
from .balance import balance_rows
from .boosting import first_largest
from .features import FeatureLayout, check_features, engineer, feature_names, fit_feature_stages
from .models import MODEL_ORDER, MODEL_TITLES, candidate, draw, fitted_form, nested, resolve


@dataclass
class TrainedBundle:
    model: PipelineModel              # feature stages + the chosen classifier
    labels: list[str]                 # label of code i
    lookup: DataFrame                 # label → text
    layout: FeatureLayout
    spec: SessionSpec
    best: str
    comparison: DataFrame
    names: list[str] = field(default_factory=list)


def prepare(df: DataFrame, spec: SessionSpec) -> DataFrame:
    """MD14 (fit side): drop rows without target text, derive the features, mode-impute the label parts, build the
    composite label, drop classes of one row."""
    d = df.na.drop(subset=[spec.text_column]) if spec.text_column in df.columns else df
    parts = [c for c in ("risk_level", "hr_zone", "performance_level") if c in d.columns]
    d = clean.mode_impute(d, parts)
    d = engineer(d, spec)
    d = labels.composite_label(d, spec.label_parts, spec.label_column)
    return labels.drop_singletons(d, spec.label_column)


REFUSED = (ValueError, ArithmeticError, IllegalArgumentException)     # an estimator's answer to a setting it cannot fit


def _fit(estimator, rows: DataFrame, setting: dict, n_rows: int):
    return fitted_form(estimator).fit(rows, resolve(estimator, setting, n_rows))


def _try_fit(estimator, rows: DataFrame, setting: dict, n_rows: int, failed: list | None = None):
    """A fitted model, or None where the estimator refuses the setting: such a fit scores 0, its error goes to ``failed``.

    Any other error (lost executors, memory, the session) says nothing about the setting and is raised."""
    try:
        return _fit(estimator, rows, setting, n_rows)
    except REFUSED as exc:
        logging.getLogger("athlos").warning("a fit failed: %s", str(exc)[:2000])
        if failed is not None:
            failed.append(exc)
        return None


class _Fold:
    """A fold's balanced and held-out rows: cached when its first fit asks, released after its last."""

    def __init__(self, train: DataFrame, fold: int, balance, uses: int):
        self.train, self.fold, self.balance, self.uses = train, fold, balance, uses
        self.lock, self.kept = threading.Lock(), None

    def open(self) -> tuple[DataFrame, DataFrame, int]:
        with self.lock:
            if self.kept is None:
                rows = self.balance(self.train.where(F.col("fold") != self.fold)).persist()
                held = self.train.where(F.col("fold") == self.fold).persist()
                self.kept = rows, held, rows.count()
            return self.kept

    def close(self, uses: int = 1) -> None:
        with self.lock:
            self.uses -= uses
            if self.uses <= 0 and self.kept is not None:
                for df in self.kept[:2]:
                    df.unpersist()
                self.kept = None


def search_all(families: list[tuple], train: DataFrame, folds: int, balance, evaluator,
               parallelism: int = 4, failed: list[list] | None = None) -> list[tuple[dict, list[float]]]:
    """Best setting by mean fold score, the first of equals, per (estimator, settings): (setting, scores per setting).

    The fits of all families, folds and settings share one queue, ``parallelism`` at a time: a small fit leaves cores
    to the next one, and no fold waits for the slowest fit of the last. Each fold is balanced and cached once for all families.
    Boosting settings that differ in the tree count only share a fit: each is scored on the prefix of its rounds.
    A fit that its estimator refuses scores 0 in its fold and its error is added to the family's list in ``failed``; a
    family without any fit has no best setting, which is an error.
    """
    failed = [[] for _ in families] if failed is None else failed
    groups = [(e, g) for e, settings in families for g in nested(e, settings)]
    owner = [k for k, (e, settings) in enumerate(families) for _ in nested(e, settings)]
    logging.getLogger("athlos").info("%d fits for %d settings in %d folds", len(groups) * folds,
                                     sum(len(settings) for _, settings in families), folds)

    def score(fold, k, estimator, group):
        setting, members = group
        try:
            rows, held, n = fold.open()
            model = _try_fit(estimator, rows, setting, n, failed[k])
            if model is None:
                return [0.0] * len(members)
            if members[0][1] is None:
                return [evaluator.evaluate(model.transform(held))]
            judged = model.stages_of(held, [m[1] for m in members]).persist()
            try:
                return [evaluator.evaluate(judged.withColumn("prediction", first_largest(F.col("stages")[k])))
                        for k in range(len(members))]
            finally:
                judged.unpersist()
        finally:
            fold.close()

    opened = [_Fold(train, f, balance, len(groups)) for f in range(folds)]
    scores = [[0.0] * len(settings) for _, settings in families]
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        waiting = [[pool.submit(score, fold, k, *g) for k, g in zip(owner, groups)] for fold in opened]
        try:
            for values in waiting:
                for k, (_, (_, members)), value in zip(owner, groups, values):
                    for (i, _), v in zip(members, value.result()):
                        scores[k][i] += v / folds
        except BaseException:
            pool.shutdown(cancel_futures=True)
            for fold in opened:
                fold.close(len(groups))
            raise
    for k, errors in enumerate(failed):
        if errors and len(errors) == owner.count(k) * folds:
            raise RuntimeError(f"all {len(errors)} fits of model family {k + 1} failed") from errors[0]
    return [(settings[max(range(len(settings)), key=lambda i: (own[i], -i))], own)
            for (_, settings), own in zip(families, scores)]


def search(estimator, settings: list[dict], train: DataFrame, folds: int, balance, evaluator, parallelism: int = 4):
    """``search_all`` for one family."""
    return search_all([(estimator, settings)], train, folds, balance, evaluator, parallelism)[0]


def _test_metrics(pred: DataFrame) -> dict:
    p = pred.select(F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    return metrics.weighted_prf(p).collect()[0].asDict()


def train_compare(df: DataFrame, spec: SessionSpec = SessionSpec(), id_col: str = "session_id",
                  numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None,
                  models: Sequence[str] = MODEL_ORDER, draws: int = SEARCH_DRAWS, folds: int = CV_FOLDS,
                  test_share: float = TEST_SHARE, seed: int = SEED, balance: str | None = "smote",
                  tree_scale: float = 1.0, parallelism: int = 4) -> TrainedBundle:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = prepare(df, spec)
    layout = FeatureLayout(list(numeric or spec.numeric_features), list(categorical or spec.categorical_features))
    check_features(d, layout.numeric, layout.categorical)
    label_model = StringIndexer(inputCol=spec.label_column, outputCol="label",
                                stringOrderType="alphabetAsc").fit(d)
    d = label_model.transform(d)
    sp = split.cutoff_split(d, spec.label_column, id_col, test_share, seed, folds)
    sp = split.class_weights(sp.where(~F.col("is_test")), spec.label_column).unionByName(
        sp.where(F.col("is_test")).withColumn("weight", F.lit(1.0))).checkpoint()
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    feat_model = Pipeline(stages=fit_feature_stages(train, layout)).fit(train)
    keep = [id_col, "label", "features", "fold", "weight", spec.label_column]
    train_f = feat_model.transform(train).select(*keep)
    if balance:
        train_f = train_f.withColumn("weight", F.lit(1.0))
    train_f = spread(train_f, id_col)
    test_f = feat_model.transform(test).select(*keep).checkpoint()
    k = split.neighbour_count(train_f, "label").collect()[0]["k_neighbors"]

    def balanced(rows: DataFrame) -> DataFrame:
        return balance_rows(rows, balance if not balance or k >= 1 else "duplicate", id_col, int(k), seed)

    evaluator = MulticlassClassificationEvaluator(metricName="f1", labelCol="label", predictionCol="prediction")
    families = [(est, draw(grid, draws, seed)) for est, grid in (candidate(name, seed, tree_scale, id_col) for name in models)]
    failed: list[list] = [[] for _ in families]
    found = search_all(families, train_f, folds, balanced, evaluator, parallelism, failed)
    whole = balanced(train_f).persist()
    n_whole = whole.count()

    def final(family, result):
        best = _fit(family[0], whole, result[0], n_whole)       # a chosen setting that cannot be fitted again is an error, not a row of zeros
        return best, _test_metrics(best.transform(test_f))
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        ends = list(pool.map(final, families, found))
    whole.unpersist()
    rows, fitted = [], {}
    for i, (name, (best, m)) in enumerate(zip(models, ends)):
        fitted[name] = best
        rows.append((MODEL_TITLES[name], name, i, float(m["accuracy"]), float(m["precision"]),
                     float(m["recall"]), float(m["f1"]), len(failed[i])))
    # D7: the label is a function of the inputs, so the exact rule is listed for reference (never chosen)
    rule = labels.composite_label(test, spec.label_parts, "__rule")
    m = metrics.weighted_prf(rule.select(F.col(spec.label_column).alias("actual"),
                                         F.col("__rule").alias("predicted"))).collect()[0]
    rule_row = ("Rule label (reference)", "rule", len(rows), float(m["accuracy"]), float(m["precision"]),
                float(m["recall"]), float(m["f1"]), 0)
    comparison = spark.createDataFrame(rows + [rule_row], "model string, key string, ord long, accuracy double, "
                                                          "precision double, recall double, f1 double, failed_fits long")
    best_key = sorted(rows, key=lambda r: (-r[6], r[2]))[0][1]
    best = fitted[best_key]
    full = PipelineModel(stages=list(feat_model.stages) + (list(best.stages) if isinstance(best, PipelineModel) else [best]))
    order = [c for c in spec.order_key if c in d.columns] or [id_col]
    lookup = labels.build_lookup(d, spec.label_column, spec.text_column, order).checkpoint()     # one row per label
    return TrainedBundle(full, list(label_model.labels), lookup, layout, spec, best_key, comparison,
                         feature_names(feat_model.stages, layout))


def feature_importance(bundle: TrainedBundle, top_n: int = IMPORTANCE_TOP_N) -> DataFrame:
    """MD10: tree importances, or the mean absolute coefficient over classes; named slots; top ``n``."""
    clf = bundle.model.stages[-1]
    if hasattr(clf, "featureImportances"):
        weights, title = list(clf.featureImportances.toArray()), "Importance"
    elif hasattr(clf, "coefficientMatrix"):
        from ..operators.topk import mean_abs
        mat = clf.coefficientMatrix.toArray()
        long = bundle.comparison.sparkSession.createDataFrame(
            [(k, j, float(v)) for k, row in enumerate(mat) for j, v in enumerate(row)], "k long, feature long, coefficient double")
        weights, title = [r["weight"] for r in mean_abs(long).orderBy("feature").collect()], "Abs Coef (avg)"
    else:
        raise ValueError("model has no importances")
    names = bundle.names
    if len(names) != len(weights):
        raise ValueError(f"{len(weights)} weights for {len(names)} names")
    spark = bundle.comparison.sparkSession
    from ..operators.topk import top_n as top
    t = spark.createDataFrame(list(zip(names, [float(w) for w in weights])), "feature string, weight double")
    return top(t, "weight", top_n, "feature").withColumn("metric", F.lit(title))
