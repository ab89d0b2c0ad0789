"""Joins against small, data-derived tables (class lists, label lookups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000        # rows of a per-label table, under 1 KB each


def small_side(side: DataFrame) -> DataFrame:
    """A table of one row per label, worked out once and counted: broadcast up to ``BROADCAST_ROWS`` rows, so that the
    rows it is joined to are not shuffled by a label that many of them share; joined by a shuffle beyond."""
    ensure_checkpoint_dir(side.sparkSession)
    side = side.checkpoint()
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def join_on_label(big: DataFrame, small: DataFrame, label: str, how: str = "left") -> DataFrame:
    """Null-safe join of ``big`` with the columns of ``small`` by ``label``.

    A NULL label finds the NULL class. The side to broadcast is left to adaptive execution, which decides by the
    measured bytes of the aggregated side and splits skewed partitions otherwise.
    """
    side = small.withColumnRenamed(label, "__join_label")
    return big.join(side, big[label].eqNullSafe(side["__join_label"]), how).drop("__join_label")


def semi_on_label(big: DataFrame, small: DataFrame, label: str) -> DataFrame:
    side = small.select(F.col(label).alias("__join_label"))
    return big.join(side, big[label].eqNullSafe(side["__join_label"]), "left_semi")
