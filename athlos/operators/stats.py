"""One-pass column statistics.

Every statistic a cleaning stage needs is built as one ``agg`` over all columns, so a stage costs one scan and
one tiny final row, however many columns it treats. The row is the only thing that reaches the driver; its
size is (columns x statistics), independent of the data size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

# Relative accuracy of the approximate quantile sketch (Greenwald-Khanna) used with method="approx":
# error about 1/accuracy of the rank, memory O(accuracy) per column and task, independent of the row count.
APPROX_ACCURACY = 100_000


def quantile_expr(c: str, probs: Sequence[float], method: str = "approx") -> Column:
    """Quantiles of ``c`` as an array from a bounded sketch (``method='approx'``)."""
    if method != "approx":
        raise ValueError(f"unknown quantile method {method!r}")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile_approx(F.col(c), arr, APPROX_ACCURACY).cast("array<double>")


def collect_row(df: DataFrame, exprs: dict[str, Column]) -> dict:
    """Run one aggregate job and return its single row as a dict."""
    if not exprs:
        return {}
    row = df.agg(*[e.alias(k) for k, e in exprs.items()]).collect()[0]
    return row.asDict()


def quartiles(df: DataFrame, columns: Sequence[str], method: str = "exact",
              probs: Sequence[float] = (0.25, 0.75)) -> dict[str, tuple]:
    """{column: (q_probs[0], q_probs[1], ...)}; NaN counts as missing. Runs its jobs when called.

    ``exact``: ``exact_select`` at every size. ``approx``: one sketch job.
    """
    columns = list(columns)
    if method == "exact":
        return exact_select(df, columns, probs)
    x = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    row = collect_row(x, {c: quantile_expr(c, probs, method) for c in columns})
    return {c: tuple(row[c]) if row[c] is not None else tuple(None for _ in probs) for c in columns}


def medians(df: DataFrame, columns: Sequence[str], method: str = "exact") -> dict[str, float | None]:
    return {c: q[0] for c, q in quartiles(df, columns, method, (0.5,)).items()}


# Rank error of the sketch that brackets a quantile is 1/BAND_ACCURACY of the rows, so bounds two errors away surely
# enclose it. The values between the bounds (a value frequent enough to fill them is itself a bound) are listed exactly
# while at most BAND_VALUES are expected; beyond that another sketch narrows the band first.
BAND_ACCURACY = 10_000
BAND_VALUES = 1_000_000


def exact_select(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, tuple]:
    """Exact quantiles (linear interpolation between order statistics); see ``order_statistics``."""
    found = order_statistics(df, {c: (F.col(c), probs) for c in columns})
    return {c: tuple(interpolated(*x) for x in found[c]) for c in columns}


def interpolated(a, b, share):
    if a is None:
        return None
    return a if a == b or not share else (1 - share) * a + share * b


def order_statistics(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]]) -> dict[str, list[tuple]]:
    """{name: [(a, b, share) per probability]}: the two order statistics around each quantile of a column expression
    and the weight of the upper one; (None, None, 0.0) without values. NaN counts as missing.

    Two scans, for all expressions at once: a bounded sketch brackets every rank between a lower and an upper value, with
    a middle guess; the second scan counts the values below, on and between these and lists those between. Where a rank
    falls outside its bracket, or a bracket holds too many values to list, the counts say which open interval holds it and
    the next sketch brackets it there, so every further pair of scans shrinks it by the sketch's accuracy.
    """
    base = df.select(*[nan_to_null(e.cast("double")).alias(f"_{i}") for i, (e, _) in enumerate(wanted.values())])
    names = list(wanted)

    def around(share: float) -> list[Column]:
        step = 2.0 / BAND_ACCURACY
        return [F.lit(min(1.0, max(0.0, share + d))) for d in (-step, 0.0, step)]

    first = collect_row(base, {**{f"n{i}": F.count(f"_{i}") for i in range(len(names))}, **{
        f"q{i}": F.percentile_approx(f"_{i}", F.array(*[x for p in wanted[c][1] for x in around(float(p))]), BAND_ACCURACY)
        for i, c in enumerate(names)}})
    values: dict[tuple, float] = {}                    # (column, rank) -> order statistic
    open_: dict[tuple, dict] = {}                      # (column, rank) -> interval and bracket
    out: dict[str, list] = {}
    for i, c in enumerate(names):
        n = first[f"n{i}"]
        for j, p in enumerate(wanted[c][1]):
            if not n:
                continue
            h = float(p) * (n - 1)
            for k in {int(h), min(int(h) + 1, n - 1)}:
                open_.setdefault((i, k), {"below": 0, "n": n, "lo": None, "hi": None, "bracket": tuple(first[f"q{i}"][3 * j:3 * j + 3])})
    while open_:
        specs = list(dict.fromkeys((i, *t["bracket"], 6 * t["n"] / BAND_ACCURACY <= BAND_VALUES) for (i, _), t in open_.items()))
        seen = _bracketed(base, specs)
        again = {}
        for (i, k), t in open_.items():
            spec = (i, *t["bracket"], 6 * t["n"] / BAND_ACCURACY <= BAND_VALUES)
            value, interval = _located(k, spec, seen[specs.index(spec)])
            if interval is not None and interval["n"] is None:
                interval["n"] = first[f"n{i}"] - interval["below"]
            if interval is None:
                values[i, k] = value
            else:
                again[i, k] = interval
        open_ = again
        if open_:
            row = collect_row(base, {str(x): F.percentile_approx(
                F.when(_inside(F.col(f"_{i}"), t["lo"], t["hi"]), F.col(f"_{i}")),
                F.array(*around(min(1.0, (k - t["below"] + 0.5) / t["n"]))), BAND_ACCURACY) for x, ((i, k), t) in enumerate(open_.items())})
            for x, t in enumerate(open_.values()):
                t["bracket"] = tuple(row[str(x)])
    for i, c in enumerate(names):
        n, res = first[f"n{i}"], []
        for p in wanted[c][1]:
            if not n:
                res.append((None, None, 0.0))
                continue
            h = float(p) * (n - 1)
            res.append((values[i, int(h)], values[i, min(int(h) + 1, n - 1)], h - int(h)))
        out[c] = res
    return out


def _inside(x: Column, lo, hi) -> Column:
    cond = x.isNotNull()
    if lo is not None:
        cond &= x > F.lit(lo).cast("double")
    return cond & (x < F.lit(hi).cast("double")) if hi is not None else cond


def _bracketed(base: DataFrame, specs: Sequence[tuple]) -> list[dict]:
    """One scan: for each (column, lo, mid, hi, listed) the counts below, on and between, the nearest values outside, and
    the values between where ``listed``. Tasks count in numpy, a grouped sum puts the counts together."""
    def run(batches):
        count = np.zeros((len(specs), 6), np.int64)    # below lo, on lo, between, on mid, between, on hi
        out = np.tile([-np.inf, np.inf], (len(specs), 1))
        any_out = np.zeros((len(specs), 2), bool)
        low, high = [[] for _ in specs], [[] for _ in specs]
        for b in batches:
            for s, (i, lo, mid, hi, listed) in enumerate(specs):
                x = b.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                under, over = x < lo, x > hi
                a, z = x[(x > lo) & (x < mid)], x[(x > mid) & (x < hi)]
                count[s] += [under.sum(), (x == lo).sum(), len(a), (x == mid).sum() if mid != lo else 0, len(z),
                             (x == hi).sum() if hi != mid else 0]
                if under.any():
                    out[s, 0], any_out[s, 0] = max(out[s, 0], x[under].max()), True
                if over.any():
                    out[s, 1], any_out[s, 1] = min(out[s, 1], x[over].min()), True
                if listed:
                    low[s].append(a)
                    high[s].append(z)
        listing = lambda v: np.concatenate(v) if v else np.zeros(0)
        for s in range(len(specs)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s], pa.int32()), pa.array([count[s]], pa.list_(pa.int64())),
                 pa.array([out[s, 0] if any_out[s, 0] else None], pa.float64()), pa.array([out[s, 1] if any_out[s, 1] else None], pa.float64()),
                 pa.array([listing(low[s])], pa.list_(pa.float64())), pa.array([listing(high[s])], pa.list_(pa.float64()))],
                names=["s", "n", "prev", "next", "low", "high"])

    parts = base.mapInArrow(run, "s int, n array<long>, prev double, next double, low array<double>, high array<double>")
    rows = parts.groupBy("s").agg(*[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(6)], F.max("prev").alias("prev"),
                                  F.min("next").alias("next"), F.flatten(F.collect_list("low")).alias("low"),
                                  F.flatten(F.collect_list("high")).alias("high")).collect()      # one row per bracket
    return [r.asDict() for r in sorted(rows, key=lambda r: r["s"])]


def _located(k: int, spec: tuple, r: dict):
    """(value, None) of the rank ``k`` (from 0), or (None, interval) where the scan does not settle it."""
    _, lo, mid, hi, listed = spec
    under, *parts = (r[f"n{j}"] for j in range(6))
    if k < under:
        return (r["prev"], None) if k == under - 1 else (None, {"below": 0, "n": under, "lo": None, "hi": lo})
    at = under
    for j, (part, edge) in enumerate(zip(parts, (lo, "low", mid, "high", hi))):
        if k < at + part:
            if edge not in ("low", "high"):
                return edge, None
            if listed:
                return sorted(r[edge])[k - at], None
            ends = (lo, mid) if edge == "low" else (mid, hi)
            return None, {"below": at, "n": part, "lo": ends[0], "hi": ends[1]}
        at += part
    if k == at:
        return r["next"], None
    return None, {"below": at, "n": None, "lo": hi, "hi": None}


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent non-NULL value per column; the smallest value wins a tie. One scan and one grouped count for all
    columns of a type, so no task holds all values of a column; one row per column reaches the driver."""
    by_type: dict = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType, []).append(c)
    found = {}
    for cols in by_type.values():
        counted = (df.select(F.posexplode(F.array(*[F.col(c) for c in cols])).alias("i", "v")).where(F.col("v").isNotNull())
                   .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
        top = counted.groupBy("i").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("v"))
        found.update((cols[r["i"]], r["v"]) for r in top.collect())
    return {c: found.get(c) for c in columns}


def min_max(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    exprs = {}
    for c in columns:
        exprs[f"{c}__min"] = F.min(c)
        exprs[f"{c}__max"] = F.max(c)
    row = collect_row(df, exprs)
    return {c: (row[f"{c}__min"], row[f"{c}__max"]) for c in columns}


def mean_std(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> dict[str, tuple]:
    """{column: (mean, std)}; ``ddof=1`` sample std (NULL for one row), ``ddof=0`` population std."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    exprs = {}
    for c in columns:
        exprs[f"{c}__mean"] = F.avg(c)
        exprs[f"{c}__std"] = std(c)
    row = collect_row(df, exprs)
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in columns}
