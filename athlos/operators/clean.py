"""Cleaning operators: dedupe, coerce, IQR clip, sparse rows, imputation, scaling, and the whole chain.

Each statistics-based operator runs one aggregate job (``stats``) and then applies a pure projection with the
statistics inlined as literals: no join, no shuffle besides the aggregate's own partial/final exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import clip_keep_null, is_numeric_type, null_count
from ..spec import IQR_FACTOR, MISSING_SHARE_MAX, NUMERIC_EXCLUDE, SessionSpec
from . import stats


def numeric_columns(df: DataFrame, exclude: Sequence[str] = NUMERIC_EXCLUDE) -> list[str]:
    """PF1: names of numeric columns minus an exclusion list (schema only, no job)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def dedupe(df: DataFrame) -> DataFrame:
    """AG1: whole-row distinct. NULL equals NULL; partial aggregation collapses copies before the shuffle."""
    return df.dropDuplicates()


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PF2: cast the named columns to double; unparsable text becomes NULL (never an error under ANSI)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns if c in df.columns})


def drop_missing_target(df: DataFrame, target: str, observation: Observation | None = None) -> DataFrame:
    """PF3: drop rows whose target is NULL.

    With an ``Observation``, the rows seen and the rows dropped are counted on the consumer's own job (no second
    pass); read them with ``observation.get`` after the first action.
    """
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"),
                        F.sum(F.col(target).isNull().cast("long")).alias("dropped"))
    return df.na.drop(subset=[target])


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR,
               method: str = "exact") -> dict[str, tuple]:
    q = stats.quartiles(df, columns, method)
    out = {}
    for c, (q1, q3) in q.items():
        if q1 is None or q3 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - factor * iqr, q3 + factor * iqr)
    return out


def iqr_clip(df: DataFrame, columns: Sequence[str] | None = None, factor: float = IQR_FACTOR,
             method: str = "exact") -> DataFrame:
    """FE1: bound each column to [Q1 - f*IQR, Q3 + f*IQR]; NULL stays NULL."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    bounds = iqr_bounds(df, columns, factor, method)
    return df.withColumns({c: clip_keep_null(F.col(c), lo, hi) for c, (lo, hi) in bounds.items()})


def sparse_row_filter(df: DataFrame, max_share: float = MISSING_SHARE_MAX,
                      columns: Sequence[str] | None = None) -> DataFrame:
    """PF4: keep rows whose share of NULL cells over ``columns`` (default: all) is at most ``max_share``."""
    columns = list(columns) if columns is not None else df.columns
    n = len(columns)
    return df.filter(null_count(columns) <= F.lit(max_share * n))


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """FE2: NULL → column median (of the non-NULL values). An all-NULL column stays NULL."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    med = stats.medians(df, columns, method)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m).cast("double")) for c, m in med.items()
                           if m is not None})


def clip_filter_impute(df: DataFrame, columns: Sequence[str], factor: float = IQR_FACTOR,
                       max_share: float = MISSING_SHARE_MAX, method: str = "exact") -> DataFrame:
    """FE1 → PF4 → FE2 with all their statistics from one selection: quartiles of every row, medians of the kept rows.

    Clipping is monotone and keeps NULLs, so the rows to keep are known before it and the order statistics of the
    clipped kept rows are the clipped order statistics of the kept rows.
    """
    columns = list(columns)
    if method != "exact":
        return median_impute(sparse_row_filter(iqr_clip(df, columns, factor, method), max_share), columns, method)
    kept = null_count(df.columns) <= F.lit(max_share * len(df.columns))
    found = stats.order_statistics(df, {**{f"all {c}": (F.col(c), (0.25, 0.75)) for c in columns},
                                        **{f"kept {c}": (F.when(kept, F.col(c)), (0.5,)) for c in columns}})
    out = {}
    for c in columns:
        q1, q3 = (stats.interpolated(*x) for x in found[f"all {c}"])
        lo, hi = (None, None) if q1 is None else (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
        a, b, share = found[f"kept {c}"][0]
        clipped = clip_keep_null(F.col(c), lo, hi)
        if a is None or lo != lo or hi != hi:          # no values, or bounds from infinite quartiles
            out[c] = clipped
        else:
            a, b = (max(min(v, hi), lo) for v in (a, b))
            out[c] = F.coalesce(clipped, F.lit(stats.interpolated(a, b, share)).cast("double"))
    return df.filter(kept).withColumns(out)


def mode_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FE3: NULL → most frequent value (smallest on a tie)."""
    mo = stats.modes(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in mo.items() if m is not None})


def default_impute(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """FE4: constant defaults; absent columns are added with the default (PF6)."""
    present = {c: v for c, v in defaults.items() if c in df.columns}
    absent = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.na.fill(present).withColumns(absent) if present else df.withColumns(absent)


def fill_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FE5: 0/1 flag columns: NULL → 0, as int; absent flags are added as 0."""
    return df.withColumns({c: (F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in df.columns else F.lit(0))
                           for c in columns})


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """FE6: (x - min) / (max - min); a constant column is left unchanged."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    mm = stats.min_max(df, columns)
    out = {}
    for c, (mn, mx) in mm.items():
        if mn is None:
            continue                                   # all NULL: nothing to scale
        if mn != mx:
            out[c] = (F.col(c) - F.lit(float(mn))) / F.lit(float(mx - mn))
    return df.withColumns(out)


def zscore(df: DataFrame, columns: Sequence[str] | None = None, ddof: int = 1) -> DataFrame:
    """FE7: (x - mean) / std with the sample std; a constant column is unchanged; a one-row column → NULL."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    ms = stats.mean_std(df, columns, ddof)
    out = {}
    for c, (mean, sd) in ms.items():
        if mean is None:
            continue
        if sd is None:
            out[c] = F.lit(None).cast("double")        # std undefined: the reference's NaN column
        elif sd != 0:
            out[c] = (F.col(c) - F.lit(float(mean))) / F.lit(float(sd))
    return df.withColumns(out)


def clean_sessions(df: DataFrame, spec: SessionSpec = SessionSpec(), method: str = "exact",
                   standardise: bool = True, encode: bool = True, materialize: str | None = "checkpoint"
                   ) -> DataFrame:
    """FE23: dedupe → coerce → IQR clip → sparse-row filter + median impute → z-score → encode.

    Order matters: quartiles see every deduplicated row, medians the clipped kept rows, mean/std the imputed
    ones: two scans for the order statistics (``clip_filter_impute``), one for the moments. The deduplicated table is
    materialised once: ``"checkpoint"`` (written to the shared ``spark.checkpoint.dir``: survives lost executors; its files
    go with the session's references where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on), ``"persist"`` (MEMORY_AND_DISK; the caller unpersists), or ``None``.
    """
    from .encode import one_hot, ordinal_encode

    nums = [c for c in spec.numeric_columns if c in df.columns]
    base = coerce_numeric(dedupe(df), nums)
    if materialize == "persist":
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    elif materialize == "checkpoint":
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)
    kept = clip_filter_impute(base, nums, method=method)
    out = zscore(kept, nums) if standardise else kept
    if encode:
        out = ordinal_encode(one_hot(out, spec.one_hot_vocab), spec.ordinal_maps)
    return out
