"""Exact row numbers inside groups that may be huge.

``row_number() over (partition by g order by k)`` sends a whole group to one task. Here the rows are range-partitioned
on (group, order key) and sorted within partitions: one shuffle of the rows, with partitions of even size whatever the
group sizes or key values. A row's place in its partition comes from ``monotonically_increasing_id``; a table with one
row per (partition, group) says where each group begins in each partition and how many of its rows came before.
The partitioned rows are checkpointed, so both passes see the same partitions even after a lost executor.

A count of the groups comes first: where none has over ``GROUP_ROWS`` rows, a window per group is as safe and needs one
shuffle only. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

GROUP_ROWS = 1_000_000      # rows of a group that one task may sort


def exact_row_number(df: DataFrame, partition: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Add ``out`` = 1-based row number of each row within ``partition`` by ``order`` (NULL groups are ranked too).

    Runs the shuffle when called. ``order`` should end in a unique key, or rows that tie are numbered arbitrarily.
    """
    largest = df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 0
    if largest <= GROUP_ROWS:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))
    ensure_checkpoint_dir(df.sparkSession)
    keys = [F.col(c).asc_nulls_first() for c in partition]
    placed = (df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn("__place", F.monotonically_increasing_id()).checkpoint())
    pid = F.shiftright("__place", 33)
    runs = placed.groupBy(*partition, pid.alias("__pid")).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*partition).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    side = runs.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(partition)], "__pid", "__first", "__before")
    cond = pid == F.col("__pid")
    for i, c in enumerate(partition):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return (placed.join(side, cond).withColumn(out, (F.col("__before") + F.col("__place") - F.col("__first") + 1).cast("long"))
            .drop("__place", "__pid", "__first", "__before", *[f"__g{i}" for i in range(len(partition))]))
