"""Embedding whitening by a weighted multiplicity covariance.

Identical integer vectors are grouped once; each distinct vector carries its count (or one) as fit weight. Exact
integer sums give the mean, a weighted GEMM of the centred distinct vectors gives the covariance, its eigenvectors
whiten each distinct vector once, and the rows take their result back by a join on the vector. Partial sums are made
per task and added up by a shuffle on matrix cells; the driver holds one matrix of dimensions x dimensions.

Defined cases: rows whose vector is null, empty or holds a null or non-finite component go, and so do rows whose length
is not the most frequent one (the longest of equally frequent ones). floor(64 * c) stays within +-2^29. Repeated rows,
equal vectors and null ids stay rows of their own. A component whose eigenvalue is zero to double precision (one
distinct vector, constant directions) has null ``whitened`` and no part in ``identity_error``; ``explained`` is null if
the trace is zero. A ``deviation`` beyond a long is null. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, vectors

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 29
COMPONENTS = 32
_LONG = (1 << 63) - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def distinct(table: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """(rows (vec_id, x), groups (x, n), dimensions, rows of that length); ``groups`` is written to the shared folder."""
    rows = vectors.packed(table, ["vec_id"], SCALE, SHIFT, MOST)
    groups = common.checkpointed(rows.groupBy("x").agg(F.count("*").alias("n")))
    dims, n = vectors.usual_length(groups.groupBy(F.length("x").alias("bytes")).agg(F.sum("n").alias("n")))
    same = F.length("x") == dims * 4
    return rows.where(same), groups.where(same), dims, n


def _dot(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact w @ x; Python integers where a long might overflow."""
    if len(x) and float(w.astype(np.float64).sum()) * float(np.abs(x).max()) >= 2.0 ** 62:
        return w.astype(object) @ x.astype(object)
    return w @ x


def sums(groups: DataFrame, dims: int) -> list[int]:
    """Exact weighted sum of every dimension; ``groups`` is (x, w)."""
    def run(batches):
        total = [0] * dims
        for b in batches:
            part = _dot(b.column("w").to_numpy(), vectors.unpack(b.column("x"), dims))
            total = [t + int(p) for t, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["s"])

    found = vectors.summed(groups.mapInArrow(run, "s array<decimal(38,0)>"), [], "s").collect()      # one row per dimension
    out = [0] * dims
    for r in found:
        out[r["pos"]] = int(r["total"])
    return out


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - S, exactly (int64, or Python integers where a long might overflow)."""
    if n * (1 << 31) >= 1 << 62 or max((abs(s) for s in total), default=0) >= 1 << 62:
        return x.astype(object) * n - np.array(total, object)
    return x * n - np.array(total, np.int64)


def deviations(y: np.ndarray) -> list:
    """Exact sum of squares of each row of n * x - S; None beyond a long."""
    if y.dtype == object or (y.size and float(np.abs(y).max()) ** 2 * y.shape[1] >= 2.0 ** 62):
        out = [sum(int(v) ** 2 for v in r) for r in y.tolist()]
        return [v if v <= _LONG else None for v in out]
    return (y * y).sum(axis=1).tolist()


def gemm(table: DataFrame, dims: int, matrix) -> np.ndarray:
    """Sum over all batches of (w * m)^T m, where ``matrix(batch)`` gives (w, m); tasks add up first, then a shuffle."""
    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            w, m = matrix(b)
            total += (m * w[:, None]).T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))],
                                         names=["i", "v"])

    out = np.zeros((dims, dims))
    for r in vectors.summed(table.mapInArrow(run, "i int, v array<double>"), ["i"], "v").collect():    # dims x dims cells
        out[r["i"], r["pos"]] = r["total"]
    return out


@dataclass
class Whitening:
    """Mean as exact sums over n fit rows, unit components in columns, their eigenvalues and the trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values]

    def live(self) -> np.ndarray:
        top = self.values[0] if len(self.values) else 0.0
        return self.values > max(top, 0.0) * len(self.components) * np.finfo(float).eps

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integer vectors; NaN for components without variance."""
        y = centred(x, self.n, self.total).astype(np.float64) / self.n
        live = self.live()
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, live] = (y @ self.components[:, live]) / np.sqrt(self.values[live])
        return out


def fit(groups: DataFrame, dims: int, components: int = COMPONENTS, weights: str = "counts") -> Whitening:
    """Fit on the distinct vectors (x, n): weight n each (``counts``: all rows) or one each (``one``)."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be counts or one")
    w = groups.select("x", (F.col("n") if weights == "counts" else F.lit(1)).cast("long").alias("w"))
    n = w.agg(F.sum("w")).first()[0]
    total = sums(w, dims)
    cov = gemm(w, dims, lambda b: (b.column("w").to_numpy().astype(np.float64),
                                   centred(vectors.unpack(b.column("x"), dims), n, total).astype(np.float64) / n)) / n
    values, units = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:min(components, dims)]
    return Whitening(n, total, np.ascontiguousarray(units[:, order]), values[order], float(np.trace(cov)))


def whiten(groups: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """(x, n, deviation, z array<double>) of each distinct vector, written to the shared folder."""
    shared = groups.sparkSession.sparkContext.broadcast(model)           # dims x components doubles

    def run(batches):
        for b in batches:
            m, x = shared.value, vectors.unpack(b.column("x"), dims)
            z = m.apply(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("x"), b.column("n"), pa.array(deviations(centred(x, m.n, m.total)), pa.int64()),
                 pa.array(list(z), pa.list_(pa.float64()))], names=["x", "n", "deviation", "z"])

    return common.checkpointed(groups.select("x", "n").mapInArrow(run, "x binary, n long, deviation long, z array<double>"))


def identity_error(white: DataFrame, model: Whitening, weights: str = "counts") -> float:
    """Largest absolute entry of the measured covariance of ``z`` minus the identity, over components with variance."""
    live = model.live()
    k = len(live)
    if not live.any():
        return 0.0
    w = white.select("z", (F.col("n") if weights == "counts" else F.lit(1)).cast("long").alias("w"))

    def matrix(b):
        return np.nan_to_num(np.array(b.column("z").to_pylist(), np.float64).reshape(b.num_rows, k)), b.column("w").to_numpy().astype(np.float64)

    def run(batches):
        total = np.zeros(k)
        for b in batches:
            z, c = matrix(b)
            total += c @ z
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    mean = np.zeros(k)
    for r in vectors.summed(w.mapInArrow(run, "s array<double>"), [], "s").collect():
        mean[r["pos"]] = r["total"] / model.n

    def shifted(b):
        z, c = matrix(b)
        return c, z - mean

    cov = gemm(w, k, shifted) / model.n
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())


def whiten_table(table: DataFrame, components: int = COMPONENTS, weights: str = "counts") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every kept row and component."""
    spark = table.sparkSession
    common.bound_batches(spark)
    rows, groups, dims, total = distinct(table)
    if not total:
        return spark.createDataFrame([], RESULT)
    model = fit(groups, dims, components, weights)
    white = whiten(groups, dims, model)
    error = identity_error(white, model, weights)
    joined = vectors.left_join(rows, white, "x", "n", total, "vec_id")
    explained = F.array(*[F.lit(v).cast("double") for v in model.explained])
    return (joined.select("vec_id", "deviation", F.posexplode("z").alias("_i", "_z"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("_i") + 1).alias("component"),
                    F.lit(model.n).cast("long").alias("n"), "deviation",
                    F.when(~F.isnan("_z"), F.col("_z")).alias("whitened"),
                    F.element_at(explained, F.col("_i") + 1).alias("explained"), F.lit(error).alias("identity_error")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_table(common.read(spark, sf_dir, "embeddings"))
