"""Top-k operators: top-3 classes per row (no shuffle), top-n features, best model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top3_struct(scores: Column, k: int = 3) -> Column:
    """WS1: the ``k`` largest entries of a score array as structs (p, i), largest first.

    Sorting (p, i) descending puts the higher index first on equal scores, as a reversed ascending argsort
    does. Runs inside the row's projection: no shuffle, no explode.
    """
    pairs = F.transform(scores, lambda x, i: F.struct(x.cast("double").alias("p"), i.alias("i")))
    return F.slice(F.sort_array(pairs, asc=False), 1, k)


def top3_wide(df: DataFrame, scores: str, labels: Sequence[str] | None = None, k: int = 3,
              decimals: int = 4) -> DataFrame:
    """WS1 wide form: ``top{r}_label`` and ``top{r}_proba`` (half-even rounding to ``decimals``).

    With ``labels`` the index is decoded to the label text, else it is the index itself.
    """
    top = top3_struct(F.col(scores), k)
    cols = {}
    for r in range(k):
        item = F.get(top, r)
        idx = item.getField("i")
        name = (F.element_at(F.array(*[F.lit(x) for x in labels]), idx + 1) if labels else idx.cast("string"))
        cols[f"top{r + 1}_label"] = F.when(idx.isNotNull(), name)
        cols[f"top{r + 1}_proba"] = F.bround(item.getField("p"), decimals)
    return df.withColumns(cols)


def top3_long(df: DataFrame, id_cols: Sequence[str], scores: str, k: int = 3) -> DataFrame:
    """WS1 long form: (ids..., rank, class_index, score)."""
    top = top3_struct(F.col(scores), k)
    return (df.select(*id_cols, F.posexplode(top).alias("pos", "t"))
            .select(*id_cols, (F.col("pos") + 1).cast("long").alias("rank"),
                    F.col("t.i").cast("long").alias("class_index"), F.col("t.p").alias("score")))


def mean_abs(df: DataFrame, feature: str = "feature", coefficient: str = "coefficient", out: str = "weight") -> DataFrame:
    """AG17: mean absolute coefficient over classes per feature, from (class, feature, coefficient) rows."""
    return df.groupBy(feature).agg(F.avg(F.abs(F.col(coefficient))).alias(out))


def top_n(df: DataFrame, weight: str = "weight", n: int = 15, name: str = "feature") -> DataFrame:
    """WS2: the ``n`` largest weights with a 1-based rank (the limit is the feature: a top-n report)."""
    w = Window.orderBy(F.desc(weight), F.col(name))
    return df.orderBy(F.desc(weight), F.col(name)).limit(n).withColumn("rank", F.row_number().over(w).cast("long"))


def rank_models(df: DataFrame, score: str = "f1", order: str = "ord") -> DataFrame:
    """WS3: comparison ordered by score (first listed wins a tie), with ``rank`` and ``is_best``."""
    w = Window.orderBy(F.desc(score), F.col(order))
    return df.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("is_best", F.col("rank") == 1)
