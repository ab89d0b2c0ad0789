"""AG7 + AG8 kept up to date: per-day sketches and counts of label classes that merge instead of rescanning.

A day's state is one row per label part with a HyperLogLog sketch, and one row per class with a count. Both merge by
union and sum, so any split of the rows into days (or loads) gives the same totals, and a new day costs its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_LOG2 = 12            # registers of a sketch: a standard error of about 1.6 %


def day_state(df: DataFrame, parts: Sequence[str], day: Column) -> DataFrame:
    """(day, part, value, n, sketch): counts per class value, and with NULL value the sketch of the part."""
    rows = df.select(day.alias("day"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("value")) for p in parts])).alias("x")).select("day", "x.*")
    counts = rows.where("value IS NOT NULL").groupBy("day", "part", "value").agg(F.count(F.lit(1)).alias("n"))
    sketches = counts.groupBy("day", "part").agg(F.sum("n").alias("n"), F.hll_sketch_agg("value", SKETCH_LOG2).alias("sketch"))
    return counts.withColumn("sketch", F.lit(None).cast("binary")).unionByName(
        sketches.withColumn("value", F.lit(None).cast("string")).select("day", "part", "value", "n", "sketch"))


def merged(*states: DataFrame) -> DataFrame:
    """One state out of several: sketches union, counts add."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("day", "part", "value").agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch")).withColumn(
        "sketch", F.when(F.col("value").isNull(), F.col("sketch")))


def distinct_estimates(state: DataFrame) -> DataFrame:
    """(part, estimate): distinct values of each part over all days."""
    return state.where("value IS NULL").groupBy("part").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def class_sizes(state: DataFrame, part: str) -> DataFrame:
    """(value, n): rows per class of one part over all days."""
    return state.where((F.col("part") == part) & F.col("value").isNotNull()).groupBy("value").agg(F.sum("n").alias("n"))
