"""Composite labels, class statistics, the label → text lookup, label codes and decoding.

Class-level work is done on the aggregated class table (one row per label, partial aggregation first, so a
label holding a third of all rows costs no more than any other). Row-level work joins back against that table;
adaptive execution broadcasts it while its bytes are within the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import composite
from ..functions.joins import semi_on_label, small_side
from ..functions.ranking import exact_row_number
from ..spec import LABEL_SEP, TRAINING_FALLBACK_PREFIX
from .encode import flags_to_category, hr_critical_flag


def composite_label(df: DataFrame, parts: Sequence[str], out: str = "target_label", sep: str = LABEL_SEP,
                    missing: str = "?") -> DataFrame:
    """FE15: parts joined by ``sep``; absent or NULL parts read ``missing`` (never shifts the others)."""
    cols = [F.col(p) if p in df.columns else F.lit(None) for p in parts]
    return df.withColumn(out, composite(cols, sep, missing))


def label_parts(df: DataFrame, names: Sequence[str], label: str = "predicted_label",
                sep: str = LABEL_SEP) -> DataFrame:
    """FE18: split a label into named part columns (a missing part → NULL)."""
    arr = F.split(F.col(label), sep, -1)
    return df.withColumns({n: F.get(arr, i) for i, n in enumerate(names)})


def true_label(df: DataFrame, parts: Sequence[str], out: str = "true_label") -> DataFrame:
    """FE16: rebuild the label of a labelled table: event from flags (if no text), critical flag, composite."""
    if "event_type" in parts and "event_type" not in df.columns:
        df = flags_to_category(df)
    if "hr_critical_flag" in parts and "hr_critical_flag" not in df.columns and "hr_zone" in df.columns:
        df = hr_critical_flag(df)
    return composite_label(df, parts, out)


def class_sizes(df: DataFrame, label: str = "target_label") -> DataFrame:
    """AG8: rows per class, largest first (label breaks ties)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col(label))


def class_size_summary(df: DataFrame, label: str = "target_label") -> DataFrame:
    """AG9 + AG7: number of classes, min / median / max class size."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("min_size"),
                     F.median("n").alias("median_size"), F.max("n").alias("max_size"))


def label_nunique(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """AG7: distinct non-NULL values per column, one row, one job (``approx`` uses HyperLogLog++)."""
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    return df.agg(*[f(F.col(c)).alias(c) for c in columns])


def valid_classes(df: DataFrame, label: str = "target_label", min_size: int = 2) -> DataFrame:
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
            .select(label))


def drop_singletons(df: DataFrame, label: str = "target_label", min_size: int = 2) -> DataFrame:
    """PF9/JN2: keep rows whose class has at least ``min_size`` rows (semi join on the class table)."""
    return semi_on_label(df, valid_classes(df, label, min_size), label)


def build_lookup(df: DataFrame, label: str = "target_label", text: str = "recommendation_entrainement",
                 order_key: Sequence[str] = ("session_id",)) -> DataFrame:
    """AG10: first non-NULL text per label by an explicit order key, sorted by label.

    ``min_by`` is a partial aggregate, so this costs one shuffle of (label, text, key) triples after map-side
    reduction.
    """
    key = F.struct(*[F.col(k) for k in order_key]) if len(order_key) > 1 else F.col(order_key[0])
    t = F.col(text)
    return (df.groupBy(label).agg(F.min_by(t, F.when(t.isNotNull(), key)).alias(text))
            .orderBy(label))


def lookup_join(df: DataFrame, lookup: DataFrame, label: str = "predicted_label",
                lookup_label: str = "target_label", text: str = "recommendation_entrainement",
                out: str = "pred_recommendation", fallback_prefix: str = TRAINING_FALLBACK_PREFIX) -> DataFrame:
    """JN1: left join the label → text lookup (see ``small_side``); a label without a row gets ``prefix + label + ')'``."""
    lk = small_side(lookup.select(F.col(lookup_label).alias("__lk_label"), F.col(text).alias("__lk_text")))
    joined = df.join(lk, F.col(label) == F.col("__lk_label"), "left")
    fallback = F.concat(F.lit(fallback_prefix), F.col(label), F.lit(")"))
    return (joined.withColumn(out, F.when(F.col("__lk_label").isNull(), fallback).otherwise(F.col("__lk_text")))
            .drop("__lk_label", "__lk_text"))


def label_table(df: DataFrame, label: str = "target_label") -> DataFrame:
    """FE22 fit: (label, code): the distinct labels in code-point order, numbered from 0. One row per label is
    sorted, never the rows."""
    distinct = df.select(F.col(label).cast("string").alias("label")).where(F.col(label).isNotNull()).distinct()
    return distinct.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("code"))


def sorted_labels(df: DataFrame, label: str = "target_label") -> list[str]:
    """The label list of a model (one row per class), in code order."""
    return [r["label"] for r in label_table(df, label).orderBy("code").collect()]


def codes_of(spark, labels: Sequence[str]) -> DataFrame:
    """(label, code) of a model's label list."""
    return spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, code int")


def encode(df: DataFrame, codes: DataFrame, label: str = "target_label", out: str = "label_code") -> DataFrame:
    """FE22 transform: code of each label, unknown or NULL → NULL, by a join with the code table."""
    side = codes.select(F.col("label").alias("__known"), F.col("code").alias(out))
    return df.join(side, F.col(label) == F.col("__known"), "left").drop("__known")


def decode(df: DataFrame, codes: DataFrame, code: str = "code", out: str = "decoded") -> DataFrame:
    """JN3: label of each code by a join with the code table."""
    side = codes.select(F.col("label").alias(out), F.col("code").alias("__code"))
    return df.join(side, F.col(code).cast("int") == F.col("__code"), "left").drop("__code")


def decode_expr(code: Column, labels: Sequence[str]) -> Column:
    """JN3 as a projection, for the label list of a fitted model (as long as its probability vector)."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), code.cast("int") + 1)


def label_codes(df: DataFrame, label: str = "target_label", out: str = "label_code") -> DataFrame:
    """FE22: add the sorted-order code of each label."""
    return encode(df, label_table(df, label), label, out)


def known_or_first(df: DataFrame, known: DataFrame, label: str = "true_label", out: str = "true_label_known") -> DataFrame:
    """PF10 + FE17: a label outside ``known`` (label, code) is replaced by its first one; ``is_unseen`` marks it."""
    first = known.agg(F.min_by("label", "code").alias("__first"))
    side = known.select(F.col("label").alias("__known"), F.lit(True).alias("__seen"))
    j = df.join(side, F.col(label) == F.col("__known"), "left").drop("__known")
    # one row on the right side: a lookup of a constant, not a product of two tables
    return (j.withColumn("__one", F.lit(1)).join(first.withColumn("__one", F.lit(1)), "__one", "left")
            .withColumns({"is_unseen": F.col("__seen").isNull(),
                          out: F.when(F.col("__seen"), F.col(label)).otherwise(F.col("__first"))})
            .drop("__one", "__seen", "__first"))


def history_seq(df: DataFrame, partition: str = "athlete_id", order: Sequence[str] = ("timestamp", "session_id"),
                out: str = "seq") -> DataFrame:
    """WS4: 1-based sequence of a session within its athlete, by time text then session id (NULL time last).

    One athlete may own a large share of all sessions, and many may share one time text: ranks come from range
    partitions on (athlete, time, session), see ``exact_row_number``.
    """
    return exact_row_number(df, [partition], [F.col(c).asc_nulls_last() for c in order], out)
