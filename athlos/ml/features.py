"""Feature stages of the scoring model, as persistable MLlib stages.

Fit-time statistics (medians, modes, means, population stds) are computed with one aggregate each and frozen
into ``SQLTransformer`` statements, so the whole chain — fill, derive, scale, index, one-hot, assemble,
classify — is one ``PipelineModel`` that saves, loads and scores without a shuffle (D3: fill values are those
of fit time, never of the scored batch).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean, encode, stats
from ..spec import CRITICAL_ZONE, EVENT_TYPES, UNKNOWN_EVENT, SessionSpec

TIME_FEATURES = ("hour", "dayofweek")


def _q(c: str) -> str:
    return f"`{c}`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) + "D"


@dataclass
class FeatureLayout:
    numeric: list[str]          # numeric model inputs (incl. hour/dayofweek when asked for)
    categorical: list[str]      # categorical model inputs

    def filled(self, c: str) -> str:
        return f"f__{c}"

    def scaled(self, c: str) -> str:
        return f"z__{c}"

    def index(self, c: str) -> str:
        return f"i__{c}"

    def onehot(self, c: str) -> str:
        return f"o__{c}"


def derived_columns_sql(columns: Sequence[str], time_column: str | None = "timestamp") -> str:
    """FE11 + FE13 + FE14 as SQL over ``__THIS__``: event type from flags (if no text), hour, weekday, flag."""
    cols = set(columns)
    parts = ["*"]
    if time_column and time_column in cols:
        ts = f"try_cast({_q(time_column)} AS TIMESTAMP_NTZ)"
        parts += [f"coalesce(hour({ts}), 0) AS hour", f"coalesce(weekday({ts}), 0) AS dayofweek"]
    else:
        parts += ["0 AS hour", "0 AS dayofweek"]
    if "event_type" not in cols:
        flags = [(f"event_type_{v}", v) for v in EVENT_TYPES if f"event_type_{v}" in cols]
        whens = " ".join(f"WHEN coalesce(CAST({_q(f)} AS INT), 0) = 1 THEN '{v}'" for f, v in reversed(flags))
        parts.append(f"CASE {whens} ELSE '{UNKNOWN_EVENT}' END AS event_type" if flags
                     else f"'{UNKNOWN_EVENT}' AS event_type")
    if "hr_critical_flag" not in cols and "hr_zone" in cols:
        parts.append(f"CASE WHEN hr_zone = '{CRITICAL_ZONE}' THEN 'critical' ELSE 'normal' END AS hr_critical_flag")
    return "SELECT " + ", ".join(parts) + " FROM __THIS__"


def derive(df: DataFrame, time_column: str | None = "timestamp") -> DataFrame:
    return SQLTransformer(statement=derived_columns_sql(df.columns, time_column)).transform(df)


def engineer(df: DataFrame, spec: SessionSpec) -> DataFrame:
    """MD14, shared by fitting and scoring: time features, event type, critical flag; for a spec with flag features
    also the flags from the category texts (FE12, where absent), the flag fill (FE5) and the ordinal codes with the
    default for unknown text (FE10, where absent)."""
    d = derive(df, spec.time_column)
    if spec.flag_features:
        absent = [c for c in spec.flag_features if c not in d.columns]
        for column in ("event_type", "motion_class"):
            mine = [c for c in absent if c.startswith(f"{column}_")]
            if mine and column in d.columns:
                d = d.withColumns({c: (F.col(column) == c[len(column) + 1:]).cast("int") for c in mine})
        d = clean.fill_flags(d, list(spec.flag_features))
        maps = {c: v for c, v in spec.ordinal_maps.items() if f"{c}_encoded" in spec.numeric_features}
        d = encode.ordinal_default(d, maps)
    return d


def check_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> None:
    """Training inputs must all be there: a silently dropped feature is another model."""
    absent = [c for c in (*numeric, *categorical) if c not in df.columns]
    if absent:
        raise ValueError(f"training input lacks: {', '.join(absent)}")


def fit_feature_stages(train: DataFrame, layout: FeatureLayout, method: str = "exact") -> list:
    """Fit the fill and scale statistics on ``train`` (already derived) and return the unfitted-free stages:
    fill SQL, scale SQL, indexer, one-hot, assembler. Three aggregate jobs in total."""
    nums, cats = layout.numeric, layout.categorical
    num_base = [c for c in nums if c not in TIME_FEATURES]
    med = stats.medians(train.select(*[F.expr(f"try_cast({_q(c)} AS DOUBLE)").alias(c) for c in num_base]),
                        num_base, method) if num_base else {}
    modes = stats.modes(train, cats) if cats else {}
    fill_parts = ["*"]
    for c in nums:
        base = f"try_cast({_q(c)} AS DOUBLE)"
        fill_parts.append(f"coalesce({base}, {_lit(med.get(c)) if c in med else '0.0D'}) AS {layout.filled(c)}")
    for c in cats:
        fill_parts.append(f"coalesce(CAST({_q(c)} AS STRING), {_lit(modes.get(c))}) AS {layout.filled(c)}")
    fill = SQLTransformer(statement="SELECT " + ", ".join(fill_parts) + " FROM __THIS__")

    filled = fill.transform(train)
    ms = stats.mean_std(filled, [layout.filled(c) for c in nums], ddof=0)
    scale_parts = ["*"]
    for c in nums:
        mean, sd = ms[layout.filled(c)]
        mean = mean if mean is not None else 0.0
        sd = sd if sd not in (None, 0.0) else 1.0     # constant column: centred only
        scale_parts.append(f"({layout.filled(c)} - {_lit(mean)}) / {_lit(sd)} AS {layout.scaled(c)}")
    scale = SQLTransformer(statement="SELECT " + ", ".join(scale_parts) + " FROM __THIS__")

    stages = [fill, scale]
    if cats:
        stages.append(StringIndexer(inputCols=[layout.filled(c) for c in cats],
                                    outputCols=[layout.index(c) for c in cats],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[layout.index(c) for c in cats],
                                    outputCols=[layout.onehot(c) for c in cats], dropLast=True))
    stages.append(VectorAssembler(inputCols=[layout.scaled(c) for c in nums] + [layout.onehot(c) for c in cats],
                                  outputCol="features", handleInvalid="error"))
    return stages


def feature_names(fitted_stages: list, layout: FeatureLayout) -> list[str]:
    """Names of the assembled vector slots: numeric names, then ``<category>_<value>`` per one-hot slot."""
    names = list(layout.numeric)
    for st in fitted_stages:
        if hasattr(st, "labelsArray"):
            for c, labels in zip(layout.categorical, st.labelsArray):
                names += [f"{c}_{v}" for v in labels]     # the indexer's unknown slot is the dropped last one
    return names
