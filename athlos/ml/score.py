"""Scoring and evaluation (MD11–MD13) and model persistence (IO9).

Scoring is one lazy plan per batch: derive → fitted feature stages → classifier → decode (literal label array)
→ label parts → lookup join (one row per label) → top-3 (array functions).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators import clean, labels, metrics, topk
from ..sources.files import scored_output_path, write_table
from ..spec import INFERENCE_DEFAULTS, SessionSpec
from .features import FeatureLayout, engineer
from .train import TrainedBundle


INPUT = "__input"          # the caller's row, untouched, beside the working columns


def _prepare_input(df: DataFrame, bundle: TrainedBundle) -> DataFrame:
    """MD14 (score side): absent numeric columns → NULL (filled with the fit's statistics), category defaults,
    derived columns. The caller's columns travel in one struct and are not changed."""
    spec = bundle.spec
    d = df.withColumn(INPUT, F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    cats = bundle.layout.categorical
    # present categories: NULL → default; absent ones are added with the default, except the event type,
    # which ``derive`` recovers from the event flags when the text column is absent
    fill = {k: v for k, v in INFERENCE_DEFAULTS.items()
            if k in d.columns or (k in cats and k != "event_type")}
    d = engineer(clean.default_impute(d, fill), spec)
    missing = [c for c in bundle.layout.numeric if c not in d.columns]
    return d.withColumns({c: F.lit(None).cast("double") for c in missing})


def class_probabilities(scored: DataFrame) -> Column:
    """Array of class probabilities: the model's own, or the logistic of each one-vs-rest margin, scaled to sum 1."""
    if "probability" in scored.columns:
        kind = scored.schema["probability"].dataType
        return F.col("probability") if isinstance(kind, ArrayType) else vector_to_array("probability")
    each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return F.transform(each, lambda p: F.when(total > 0, p / total).otherwise(0.0))


def score_batch(bundle: TrainedBundle, df: DataFrame, top3: bool = True) -> DataFrame:
    """MD11: the input columns unchanged, then predicted parts, label, recommendation and (optional) top-3.

    Part names and the fallback text come from the bundle's spec.
    """
    spec, original = bundle.spec, df.columns
    scored = bundle.model.transform(_prepare_input(df, bundle))
    scored = scored.withColumn("predicted_label", labels.decode_expr(F.col("prediction"), bundle.labels))
    scored = labels.label_parts(scored, list(spec.pred_columns))
    scored = labels.lookup_join(scored, bundle.lookup, "predicted_label", spec.label_column, spec.text_column,
                                "pred_recommendation", spec.fallback_prefix)
    extra = [*spec.pred_columns, "predicted_label", "pred_recommendation"]
    if top3:
        scored = topk.top3_wide(scored.withColumn("__p", class_probabilities(scored)), "__p", bundle.labels)
        extra += [f"top{r}_{x}" for r in (1, 2, 3) for x in ("label", "proba")]
    derived = [c for c in ("hour", "dayofweek", "hr_critical_flag", "event_type") if c not in original]
    return scored.select(*[F.col(f"{INPUT}.`{c}`").alias(c) for c in original], *derived,
                         *[c for c in extra if c not in original])


def write_scored(bundle: TrainedBundle, df: DataFrame, input_path: str, path: str | None = None) -> str:
    """IO7: score ``df`` and write it to ``path``, by default next to the input as <stem>_predictions."""
    path = path or scored_output_path(input_path)
    write_table(score_batch(bundle, df), path)
    return path


def score_one(bundle: TrainedBundle, record: dict, spark: SparkSession | None = None) -> dict:
    """MD12: one record in, one dict out, through the same plan as a batch."""
    spark = spark or bundle.comparison.sparkSession
    row = score_batch(bundle, spark.createDataFrame([record]), top3=True).collect()[0]
    return row.asDict()


def evaluate_batch(bundle: TrainedBundle, df: DataFrame) -> DataFrame:
    """MD13: rebuild each row's true label (FE16), replace unseen ones by the first known label (FE17, flagged),
    and return the class report (AG15) of true vs predicted labels over all known classes (D5)."""
    spec = bundle.spec
    if spec.text_column not in df.columns:
        raise ValueError(f"labelled input needs the column {spec.text_column}")
    scored = score_batch(bundle, df, top3=False)
    known = labels.codes_of(df.sparkSession, bundle.labels)
    t = labels.true_label(scored, list(spec.label_parts), "true_label")
    t = labels.known_or_first(t, known, "true_label", "actual")
    return metrics.class_report(t.select("actual", F.col("predicted_label").alias("predicted")), labels=known)


PARTS = ("model", "lookup", "comparison", "meta")
MANIFEST = "MANIFEST-"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _manifests(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n for n in names if n.startswith(MANIFEST))


def save_bundle(bundle: TrainedBundle, path: str) -> str:
    """IO9: pipeline by MLlib persistence; labels, layout and spec as JSON; lookup as Parquet. Returns the version.

    All parts go to a new folder below ``path``/versions. Renaming a manifest that names it to the next number is the
    commit: a reader sees the last whole bundle or this one, never a part, and versions already open stay readable.
    """
    spark = bundle.comparison.sparkSession
    version = uuid.uuid4().hex
    to = f"{path}/versions/{version}"
    bundle.model.write().save(f"{to}/model")
    bundle.lookup.write.parquet(f"{to}/lookup")
    bundle.comparison.write.parquet(f"{to}/comparison")
    meta = {"labels": bundle.labels, "numeric": bundle.layout.numeric, "categorical": bundle.layout.categorical,
            "best": bundle.best, "names": bundle.names,
            "spec": asdict(bundle.spec)}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.json(f"{to}/meta")
    draft, fs = _fs(spark, f"{path}/_manifest-{version}")
    fs.create(draft, True).close()
    while True:
        done = _manifests(spark, path)
        number = int(done[-1][len(MANIFEST):].split("-")[0]) + 1 if done else 0
        target, _ = _fs(spark, f"{path}/{MANIFEST}{number:012d}-{version}")
        if fs.rename(draft, target):
            return version


def load_bundle(spark: SparkSession, path: str, version: str | None = None) -> TrainedBundle:
    """IO9 + IO10: load the last committed version of a bundle (or a given one); what is missing is reported by name."""
    if version is None:
        done = _manifests(spark, path)
        if not done:
            raise ValueError(f"model bundle at {path} lacks: {', '.join(PARTS)}, manifest (train and save it first)")
        version = done[-1].rsplit("-", 1)[1]
    path = f"{path}/versions/{version}"
    missing = [part for part in PARTS if not _exists(spark, f"{path}/{part}")]
    if missing:
        raise ValueError(f"model bundle at {path} lacks: {', '.join(missing)} (train and save it first)")
    meta = json.loads(spark.read.json(f"{path}/meta").collect()[0]["meta"])
    spec = SessionSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["spec"].items()})
    return TrainedBundle(PipelineModel.load(f"{path}/model"), meta["labels"], spark.read.parquet(f"{path}/lookup"),
                         FeatureLayout(meta["numeric"], meta["categorical"]), spec, meta["best"],
                         spark.read.parquet(f"{path}/comparison"), meta["names"])
