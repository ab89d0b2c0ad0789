"""Encoding and feature operators: one-hot, ordinal codes, flags ↔ category, time features, critical flag.

All are projections (no shuffle). Only ``one_hot`` without a given vocabulary runs one small distinct job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_set_flag, ordinal_code
from ..spec import (CRITICAL_ZONE, EVENT_TYPES, INFERENCE_DEFAULTS, MOTION_CLASSES, ORDINAL_DEFAULT_CODE,
                    UNKNOWN_EVENT)


def vocabulary(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct non-NULL values of a column that becomes one output column per value; one aggregate job."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str] | None], drop_source: bool = True) -> DataFrame:
    """FE8/FE12: ``<col>_<value>`` int columns (1 if equal, else 0; NULL → all 0), source column dropped.

    With ``vocab[col] = None`` the values come from the data (sorted); pass the spec's vocabulary to skip that
    job.
    """
    out = df
    for c, values in vocab.items():
        if c not in out.columns:
            continue
        values = vocabulary(out, c) if values is None else sorted(values)
        out = out.withColumns({f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for v in values})
        if drop_source:
            out = out.drop(c)
    return out


def ordinal_encode(df: DataFrame, maps: Mapping[str, Sequence[str]], default: int | None = None,
                   only_if_absent: bool = False) -> DataFrame:
    """FE9/FE10: ``<col>_encoded`` = position in the ordered values; unmapped → ``default`` (NULL if None).

    Without a default the code is a double (NULL for unmapped text), as a mapped column with missing values is a
    float column in the reference; with a default it is an int. ``only_if_absent`` keeps an existing code column
    (scoring path, FE10).
    """
    cols = {}
    for c, values in maps.items():
        target = f"{c}_encoded"
        if c not in df.columns or (only_if_absent and target in df.columns):
            continue
        code = ordinal_code(F.col(c), values, default)
        cols[target] = code.cast("double") if default is None else code
    return df.withColumns(cols)


def ordinal_default(df: DataFrame, maps: Mapping[str, Sequence[str]]) -> DataFrame:
    """FE10: codes with default 1 for unknown text, added only where the code column is absent."""
    return ordinal_encode(df, maps, default=ORDINAL_DEFAULT_CODE, only_if_absent=True)


def flags_to_category(df: DataFrame, column: str = "event_type", values: Sequence[str] = EVENT_TYPES,
                      default: str = UNKNOWN_EVENT, prefix: str | None = None) -> DataFrame:
    """FE11: recover a category from its ``<prefix>_<value>`` flags; last set flag wins; else ``default``.

    Absent flag columns count as never set.
    """
    prefix = prefix or column
    flags = {f"{prefix}_{v}": v for v in values if f"{prefix}_{v}" in df.columns}
    return df.withColumn(column, last_set_flag(flags, default))


def category_flags(df: DataFrame, event_column: str = "event_type", motion_column: str = "motion_class"
                   ) -> DataFrame:
    """FE12: scoring-side flags from category text: three event flags (source kept) and four motion flags
    (source dropped)."""
    out = one_hot(df, {event_column: EVENT_TYPES}, drop_source=False)
    return one_hot(out, {motion_column: MOTION_CLASSES}, drop_source=True)


def time_features(df: DataFrame, column: str | None = "timestamp") -> DataFrame:
    """FE13: ``hour`` and Monday-based ``dayofweek`` (Mon=0) from a time text; unparsable or absent → 0."""
    if column is None or column not in df.columns:
        return df.withColumns({"hour": F.lit(0), "dayofweek": F.lit(0)})
    ts = F.expr(f"try_cast(`{column}` AS TIMESTAMP_NTZ)")
    return df.withColumns({"hour": F.coalesce(F.hour(ts), F.lit(0)),
                           "dayofweek": F.coalesce(F.weekday(ts), F.lit(0))})


def hr_critical_flag(df: DataFrame, zone: str = "hr_zone", out: str = "hr_critical_flag") -> DataFrame:
    """FE14: "critical" when the zone is the top zone, else "normal" (also for NULL)."""
    return df.withColumn(out, F.when(F.col(zone) == CRITICAL_ZONE, "critical").otherwise("normal"))


def inference_defaults(df: DataFrame, defaults: Mapping[str, str] = INFERENCE_DEFAULTS) -> DataFrame:
    """FE4 with the scoring defaults."""
    from .clean import default_impute
    return default_impute(df, defaults)
