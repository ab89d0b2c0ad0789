"""Dashboard analytics re-aimed at tables: bands, gauge, profile, alerts, clauses, preview, history, families.

All are projections or an explode, except ``family_weights`` (one small aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import band, contains_any
from ..spec import (HIGH_RISK_SCORE, PERFORMANCE_BAND_CUTS, PREVIEW_ELLIPSIS, RISK_BAND_CUTS,
                    TRAINING_ALERT_LOWER, TRAINING_ALERT_UPPER, TRAINING_FAMILY_RULES, TRAINING_INDICATOR_KEYS,
                    TRAINING_PREVIEW_CHARS, TRAINING_PROFILE_KEYS)
from .labels import history_seq

PERFORMANCE_BAND_NAMES = ("excellent", "moyen", "insuffisant")
RISK_BAND_NAMES = ("Critique", "Élevé", "Modéré", "Faible")


def performance_band(df: DataFrame, score: str = "performance_score", out: str = "performance_band") -> DataFrame:
    """IN1: >=70 / >=40 / below."""
    return df.withColumn(out, band(score, PERFORMANCE_BAND_CUTS, PERFORMANCE_BAND_NAMES))


def risk_band(df: DataFrame, score: str = "injury_risk_score", out: str = "risk_band") -> DataFrame:
    """IN2: on the risk score x 100: >=80 / >=60 / >=30 / below."""
    return df.withColumn(out, band(F.col(score) * 100, RISK_BAND_CUTS, RISK_BAND_NAMES))


def gauge_value(df: DataFrame, score: str, out: str = "gauge", unit_scale: bool = False) -> DataFrame:
    """IN3: clamp to 0..100; with ``unit_scale`` clamp to 0..1 first and multiply by 100."""
    c = F.col(score).cast("double")
    v = (F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 100 if unit_scale
         else F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)))
    return df.withColumn(out, F.when(c.isNotNull(), v))


def biometric_profile(df: DataFrame, keys: Sequence[str] = TRAINING_PROFILE_KEYS, prefix: str = "profile_"
                      ) -> DataFrame:
    """IN4: each metric to 0..1 by (v + 3) / 6 clamped; ``performance_score`` / 100 (missing → 50);
    ``injury_risk_score`` clamped as is; other missing values count as 0."""
    def clamp01(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    cols = {}
    for k in keys:
        v = F.col(k).cast("double") if k in df.columns else F.lit(None).cast("double")
        if k == "performance_score":
            cols[prefix + k] = clamp01(F.coalesce(v, F.lit(50.0)) / 100)
        elif k == "injury_risk_score":
            cols[prefix + k] = clamp01(F.coalesce(v, F.lit(0.0)))
        else:
            cols[prefix + k] = clamp01((F.coalesce(v, F.lit(0.0)) + 3) / 6)
    return df.withColumns(cols)


def profile_long(df: DataFrame, id_cols: Sequence[str], keys: Sequence[str] = TRAINING_PROFILE_KEYS,
                 prefix: str = "profile_") -> DataFrame:
    """IN4 long form: (ids..., metric, value) by ``unpivot``."""
    wide = biometric_profile(df, keys, prefix).select(*id_cols, *[F.col(prefix + k).alias(k) for k in keys])
    return wide.unpivot(list(id_cols), list(keys), "metric", "value")


def high_risk(df: DataFrame, score: str = "injury_risk_score", out: str = "high_risk") -> DataFrame:
    """IN5: risk score > 0.6 (missing → false)."""
    return df.withColumn(out, F.coalesce(F.col(score) > F.lit(HIGH_RISK_SCORE), F.lit(False)))


def recommendation_clauses(df: DataFrame, text: str, id_cols: Sequence[str],
                           alert_upper: Sequence[str] = TRAINING_ALERT_UPPER,
                           alert_lower: Sequence[str] = TRAINING_ALERT_LOWER) -> DataFrame:
    """IN6: one row per non-empty trimmed clause of a bar-separated text, numbered from 1, with an alert flag
    (upper-cased clause contains an upper keyword, or lower-cased clause contains a lower keyword)."""
    parts = F.filter(F.transform(F.split(F.col(text), r"\|", -1), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    exploded = df.select(*id_cols, F.posexplode(parts).alias("pos", "clause"))
    alert = contains_any(F.upper("clause"), alert_upper) | contains_any(F.lower("clause"), alert_lower)
    return exploded.select(*id_cols, (F.col("pos") + 1).cast("long").alias("clause_no"), "clause",
                           alert.alias("is_alert"))


def preview(df: DataFrame, text: str, n: int = TRAINING_PREVIEW_CHARS, out: str = "preview") -> DataFrame:
    """IN7: first ``n`` characters and an ellipsis (missing text reads as empty)."""
    return df.withColumn(out, F.concat(F.substring(F.coalesce(F.col(text), F.lit("")), 1, n),
                                       F.lit(PREVIEW_ELLIPSIS)))


def prediction_history(df: DataFrame, columns: dict[str, str], text: str, n_chars: int = TRAINING_PREVIEW_CHARS,
                       partition: str = "athlete_id", order: Sequence[str] = ("timestamp", "session_id")
                       ) -> DataFrame:
    """IN8: sequence per athlete + the chosen columns (renamed by ``columns``) + text preview."""
    seq = history_seq(df, partition, order)
    return preview(seq, text, n_chars, "recommendation").select(
        partition, "session_id", "seq", *[F.col(src).alias(dst) for src, dst in columns.items()], "recommendation")


def feature_family(df: DataFrame, feature: str = "feature", rules: Sequence[str] = TRAINING_FAMILY_RULES,
                   out: str = "family", default: str = "other") -> DataFrame:
    """IN9: the first rule substring contained in the feature name names its family."""
    expr = None
    for r in rules:
        cond = F.col(feature).contains(r)
        expr = F.when(cond, F.lit(r)) if expr is None else expr.when(cond, F.lit(r))
    return df.withColumn(out, expr.otherwise(F.lit(default)))


def family_weights(df: DataFrame, weight: str = "weight", feature: str = "feature",
                   rules: Sequence[str] = TRAINING_FAMILY_RULES) -> DataFrame:
    """IN9: total weight and feature count per family."""
    return (feature_family(df, feature, rules).groupBy("family")
            .agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n_features")))


def fixed_point(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals as a fixed-point text shows it: the exact binary value is rounded, ties to even.

    The product with 10^digits is rounded itself, so where it reads as a tie its exact error (from the split
    halves of ``x``) decides.
    """
    s = float(10 ** digits)
    y = x * s
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * s - y) + (x - high) * s
    low = F.floor(y)
    up = (y - low > 0.5) | ((y - low == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return F.when(up, low + 1).otherwise(low) / s


def indicators(df: DataFrame, keys: Sequence[str] = TRAINING_INDICATOR_KEYS, percent_key: str | None = None
               ) -> DataFrame:
    """IN10: indicator values to two decimals (missing → 0); ``percent_key`` as a percentage with one.

    Exact ties round to even, as in the reference's fixed-point texts.
    """
    cols = {}
    for k in keys:
        v = F.coalesce(F.col(k).cast("double"), F.lit(0.0))
        if k == percent_key:
            cols[f"{k}_pct"] = fixed_point(v * 100, 1)
        else:
            cols[k] = fixed_point(v, 2)
    return df.withColumns(cols)
