"""File sources and sinks: session CSV scan with an explicit schema (IO1), lookup and importance scans (IO2,
IO3), and writers (IO4–IO8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null
from ..spec import IMPORTANCE_SHOWN, SENSOR_COLUMNS

_D, _S, _L = T.DoubleType(), T.StringType(), T.LongType()

RAW_SESSION_SCHEMA = T.StructType(
    [T.StructField("athlete_id", _S), T.StructField("session_id", _L), T.StructField("timestamp", _S)]
    + [T.StructField(c, _D) for c in SENSOR_COLUMNS]
    + [T.StructField("performance_score", _D), T.StructField("injury_risk_score", _D)]
    + [T.StructField(c, _S) for c in ("risk_level", "hr_zone", "performance_level", "event_type", "motion_class",
                                      "recommendation_entrainement")]
)


def read_sessions_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SESSION_SCHEMA) -> DataFrame:
    """IO1: comma-separated, UTF-8, header; explicit schema (no inference pass); NaN cells become NULL."""
    df = (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
          .option("mode", "PERMISSIVE").csv(path))
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def read_lookup(spark: SparkSession, path: str, text_column: str = "recommendation_entrainement") -> DataFrame:
    """IO2: label → text table (two columns, header)."""
    schema = T.StructType([T.StructField("target_label", _S), T.StructField(text_column, _S)])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_importance(spark: SparkSession, path: str, shown: int = IMPORTANCE_SHOWN) -> DataFrame:
    """IO3: importance table → drop rows with NULLs, positional rename to (Feature, Score), the ``shown``
    largest scores (a top-n report: the limit is the feature)."""
    df = spark.read.option("header", True).csv(path)
    df = df.na.drop().toDF("Feature", "Score").withColumn("Score", F.expr("try_cast(Score AS DOUBLE)"))
    return df.orderBy(F.desc("Score"), F.col("Feature")).limit(shown)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """IO4–IO8: write a result table (Parquet by default; CSV with a header)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def scored_output_path(input_path: str, suffix: str = "_predictions", fmt: str = "parquet") -> str:
    """IO7: default output name = input stem + suffix, next to the input."""
    base = input_path.rstrip("/")
    stem, dot, ext = base.rpartition(".")
    stem = stem if dot and "/" not in ext else base
    return f"{stem}{suffix}.{fmt}"


def export_history(history: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """IO8: write the history projection (7 columns for the training module, 6 for the injury one) as CSV."""
    cols = columns or [c for c in history.columns if c not in ("athlete_id", "session_id")]
    write_table(history.select(*cols), path, "csv")
