"""The flagship slice: raw sessions → cleaned, labelled sessions → label → first text per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, encode, labels
from ..sources.tables import sessions
from ..spec import SENSOR_COLUMNS, TRAINING_LABEL_PARTS
from .catalog import out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: class size, first recommendation text, and the mean clipped heart rate of the class."""
    s = sessions(spark, sf_dir)
    s = clean.clip_filter_impute(s, SENSOR_COLUMNS)
    s = clean.mode_impute(s, ["risk_level", "hr_zone"])
    s = labels.composite_label(encode.hr_critical_flag(s), TRAINING_LABEL_PARTS)
    text = F.col("recommendation_entrainement")
    per_label = s.groupBy("target_label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("heart_rate_bpm").alias("mean_heart_rate"),
        F.min_by(text, F.when(text.isNotNull(), F.col("session_id"))).alias("recommendation_entrainement"))
    return out(per_label.orderBy(F.desc("n"), "target_label"))
