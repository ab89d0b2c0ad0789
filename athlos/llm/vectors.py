"""Embedding rows as packed integer vectors, and a left join that survives hot keys (operators 11 and 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 10_000           # a key with fewer rows is never hot
HOT_SHARE = 1000            # a hot key holds over 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE of them
HOT_SALTS = 997


def floored(values: np.ndarray, scale: int, shift: int, most: int) -> np.ndarray:
    """floor(scale * value) + shift as int32; the floor is kept within +-``most`` (2^30 at the largest)."""
    return (np.clip(np.floor(scale * values.astype(np.float64)), -most, most) + shift).astype(np.int32)


def pack(col: pa.Array, scale: int, shift: int, most: int) -> tuple[pa.Array, np.ndarray]:
    """(packed int32 vectors of the good rows, which rows are good).

    A row is good if its list is there, is not empty and has no null, NaN or infinite component.
    """
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    row = np.repeat(np.arange(len(col)), size)
    value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
    good = (size > 0) & (np.bincount(row, ~np.isfinite(value), len(col)) == 0)
    x = floored(value[good[row]], scale, shift, most)
    end = np.concatenate([[0], np.cumsum(size[good] * 4)])
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), int(good.sum()), [None, pa.py_buffer(end.astype(np.int64)), pa.py_buffer(x)]), good


def unpack(col: pa.Array, dims: int) -> np.ndarray:
    """The int64 matrix of a packed column whose vectors all have ``dims`` components."""
    if not len(col):
        return np.zeros((0, dims), np.int64)
    return np.frombuffer(b"".join(col.to_pylist()), np.int32).reshape(len(col), dims).astype(np.int64)


def packed(table: DataFrame, keep: list[str], scale: int, shift: int, most: int, vector: str = "embedding") -> DataFrame:
    """Columns ``keep`` and the packed vector ``x`` of every good row."""
    rows = table.select(*keep, F.col(vector).cast("array<double>").alias("x"))

    def run(batches):
        for b in batches:
            x, good = pack(b.column("x"), scale, shift, most)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in keep] + [x.cast(pa.binary())], names=b.schema.names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["x binary"]))


def usual_length(sizes: DataFrame) -> tuple[int, int]:
    """(dimensions, rows) of the most frequent vector length (the longest of equals); (0, 0) without rows.

    ``sizes`` has columns bytes and n, one row per length.
    """
    top = sizes.orderBy(F.desc("n"), F.desc("bytes")).first()
    return (top["bytes"] // 4, top["n"]) if top else (0, 0)


def left_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, salt: str) -> DataFrame:
    """``rows`` left join ``table`` on ``key``; ``table`` has one row per key, ``weight`` counts the key's rows.

    Hot keys (at least HOT_ROWS rows and over 1/HOT_SHARE of ``total``: fewer than HOT_SHARE keys whatever the
    input) are broadcast. Their rows enter the shuffle of the rest under a salt that matches nothing, spread by the
    column ``salt``, so no key makes a large task. A null key matches nothing.
    """
    extra = [c for c in table.columns if c not in (key, weight)]
    hot = table.where((F.col(weight) >= HOT_ROWS) & (F.col(weight) * HOT_SHARE > total))
    hot = hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in extra])
    cold = table.select(F.col(key).alias("_ck"), F.lit(0).alias("_cs"), *[F.col(c).alias(f"_c_{c}") for c in extra])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn(
        "_rs", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), 0).otherwise(
            1 + F.pmod(F.xxhash64(F.col(salt)), F.lit(HOT_SALTS)).cast("int")))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_rs") == F.col("_cs")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in extra])


def summed(partials: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Componentwise sums of the array column ``values`` per ``keys``, as rows (keys, pos, total)."""
    return (partials.select(*keys, F.posexplode(values).alias("pos", "v")).groupBy(*keys, "pos")
            .agg(F.sum("v").alias("total")))

