"""Readers for the driver's Parquet tables and the session-shaped view derived from ``events``.

The driver's tables hold no athlete data. ``sessions`` maps every event to one training session with the raw
session schema (ids, time text, twelve sensors, two scores, three ordered categories, two nominal ones, one
recommendation text), including the missing cells, outliers, constant column and bad time strings the cleaning
operators exist for. It is a pure projection of ``events``, so it scales with that table and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan one Parquet table; with ``columns`` only those reach the ``ReadSchema``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _null_when(cond: Column, value: Column) -> Column:
    return F.when(cond, F.lit(None)).otherwise(value)


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session view over ``events`` (23 columns); see README, "sessions view"."""
    return sessions_from_events(read_table(spark, sf_dir, "events", EVENT_COLUMNS))


def injury_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session view with the injury module's text in place of the training text (same clauses, own prefix)."""
    s = sessions(spark, sf_dir)
    text = F.regexp_replace("recommendation_entrainement", "^Niveau", "Prévention niveau")
    return s.withColumn("recommendation_blessure", text).drop("recommendation_entrainement")


def sessions_from_events(e: DataFrame, keep_event_time: bool = False) -> DataFrame:
    """The session projection of an events DataFrame (batch or streaming)."""
    eid, v, uid = F.col("event_id"), nan_to_null(F.col("value")), F.col("user_id")
    gone = eid % 50 == 0                       # every sensor missing: these rows are sparse

    def sensor(expr: Column, extra: Column | None = None) -> Column:
        cond = gone if extra is None else (gone | extra)
        return _null_when(cond, expr.cast("double"))

    risk = (F.when(v >= 100, "Critique").when(v >= 60, "Élevé").when(v >= 25, "Modéré").otherwise("Faible"))
    zone = (F.when(v >= 150, "Zone_Max").when(v >= 70, "Zone_Anaerobie").when(v >= 20, "Zone_Aerobie")
            .otherwise("Zone_Basse"))
    level = F.when(v >= 70, "Excellente").when(v >= 40, "Bonne").otherwise("Insuffisante")
    event = (F.when(F.col("event_type") == "click", "sprint").when(F.col("event_type") == "view", "high_jump")
             .when(F.col("event_type") == "purchase", "long_jump").otherwise("unknown"))
    motion = (F.when(eid % 4 == 0, "acceleration_phase").when(eid % 4 == 1, "flight_phase")
              .when(eid % 4 == 2, "landing").otherwise("start_phase"))
    text = F.concat(
        F.lit("Niveau "), (eid % 6).cast("string"), F.lit(" | Session "), F.col("event_type"),
        F.when(v >= 100, F.lit(" | ALERTE: charge critique, arrêt conseillé")).otherwise(F.lit("")),
        F.when(eid % 10 == 0, F.lit(" |  | récupération active |")).otherwise(F.lit("")),
    )
    return e.select(
        F.concat(F.lit("A"), uid.cast("string")).alias("athlete_id"),
        eid.alias("session_id"),
        F.when(eid % 37 == 0, F.lit("not a time"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        sensor(v, eid % 13 == 0).alias("heart_rate_bpm"),
        sensor((eid % 100).cast("double") / 10, eid % 17 == 0).alias("step_frequency_hz"),
        sensor((uid % 40).cast("double") / 20).alias("stride_length_m"),
        sensor(v - 50).alias("acceleration_mps2"),
        sensor(eid % 7 - 3).alias("gyroscope_x"),
        sensor(eid % 11 - 5).alias("gyroscope_y"),
        sensor(eid % 5 - 2).alias("gyroscope_z"),
        sensor(F.lit(1.0)).alias("accelerometer_x"),
        sensor(uid % 9).alias("accelerometer_y"),
        sensor(v * 3, eid % 3 == 0).alias("accelerometer_z"),
        sensor(F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)"), eid % 11 == 0)
        .alias("signal_energy"),
        sensor(v / 2).alias("dominant_freq_hz"),
        F.least(v, F.lit(100.0)).alias("performance_score"),
        F.least(v / 200, F.lit(1.0)).alias("injury_risk_score"),
        _null_when(eid % 19 == 0, risk).alias("risk_level"),
        _null_when(eid % 23 == 0, zone).alias("hr_zone"),
        level.alias("performance_level"),
        event.alias("event_type"),
        motion.alias("motion_class"),
        _null_when(eid % 29 == 0, text).alias("recommendation_entrainement"),
        *([F.col("ts").cast("timestamp").alias("event_time")] if keep_event_time else []),
    )


def doubled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` appended to itself: every row twice (input of the dedupe check)."""
    e = read_table(spark, sf_dir, "events")
    return e.unionAll(e)
