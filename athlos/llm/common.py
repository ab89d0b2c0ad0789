"""Helpers shared by the operators: table reads, Arrow batch size, fresh names, checkpoints, components."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows in one Arrow batch sent to Python. A batch also ends at ARROW_BYTES, so a batch of very long texts stays
# small; one text is the least a batch can hold.
ARROW_ROWS = 500
ARROW_BYTES = 8 << 20


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages by rows and bytes, and let the workers find this package."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release() -> None:
    """Give freed memory of this Python worker back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and cut its lineage.

    Shuffle files behind earlier checkpoints are no longer needed. Spark deletes them when the driver's collector
    finds their plans unreachable, which is asked for here, so an iterative operator does not pile them up.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


FILTER_BITS = 22            # 512 KB, whatever the input


def bitmap(slots: DataFrame):
    """Broadcast bitmap of 2^FILTER_BITS bits from the one column of ``slots`` (longs below 2^FILTER_BITS)."""
    s = slots.columns[0]
    words = (slots.groupBy(F.expr(f"{s} div 32").alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({s} % 32 AS INT))")).alias("bits")).collect())
    out = np.zeros(1 << (FILTER_BITS - 5), np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return slots.sparkSession.sparkContext.broadcast(out)


def in_bitmap(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (words[at >> 5] >> (at & 31)) & 1 == 1


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """A filter that is true for every value of the one long column of ``ids``, and false for most others while it
    holds up to about a million. It only thins out rows before the exact join; its size is fixed."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    shared = bitmap(ids.select(slot(F.col(ids.columns[0])).alias("s")))
    udf = F.arrow_udf(lambda s: pa.array(in_bitmap(shared.value, s.to_numpy())), "boolean")
    return lambda c: udf(slot(c))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over undirected ``edges`` (a long, b long).

    Alternating large-star and small-star steps. Every step is a grouped minimum and an equi-join. The edge
    table is checkpointed each round, only its count and checksum reach the driver, and the number of rounds
    grows with the logarithm of the longest path.
    """
    e = checkpointed(edges.where(F.col("a") != F.col("b"))
                     .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour (or itself)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        # small star: each node links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = checkpointed(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                         .union(low.select("u", F.col("m").alias("v")))
                         .where(F.col("u") != F.col("v")).distinct())
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
