"""Label lookups do not shuffle the rows they are joined to; iterative fits get a partition per core."""

from pyspark.sql import functions as F

from athlos import session
from athlos.functions import joins
from athlos.operators import labels
from athlos.session import spread


def test_lookup_is_broadcast_whatever_its_estimated_size(spark, monkeypatch):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("rare").alias("predicted_label"))
    text = spark.range(500).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("other").alias("target_label"), F.col("id").cast("string").alias("t"))
    lookup = labels.build_lookup(text.withColumn("session_id", F.col("t").cast("long")), text="t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = labels.lookup_join(df, lookup, text="t", fallback_prefix="(none: ")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        assert {(r[0], r[1]): r[2] for r in got.groupBy("predicted_label", "pred_recommendation").count().collect()} == {
            ("hot", "0"): 1800, ("rare", "(none: rare)"): 200}
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)                      # beyond the limit: a shuffle, same rows
        far = labels.lookup_join(df, lookup, text="t", fallback_prefix="(none: ")
        assert "BroadcastHashJoin" not in far._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert sorted(far.collect()) == sorted(got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_of_few_partitions_are_spread(spark, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_ROWS", 64)
    cores = spark.sparkContext.defaultParallelism
    few = spark.range(64 * cores).withColumn("x", F.col("id") * 2).coalesce(1)
    out = spread(few, "id")
    assert out.rdd.getNumPartitions() == cores and out.columns == ["id", "x"]
    assert out.count() == few.count() and out.exceptAll(few).count() == 0
    place = lambda d: {(r["id"], r["p"]) for r in d.select("id", F.spark_partition_id().alias("p")).collect()}
    assert place(out) == place(spread(few.orderBy(F.desc("id")).coalesce(1), "id"))
    assert spread(spark.range(60).coalesce(1), "id").rdd.getNumPartitions() == 1


def test_boosting_blocks_keep_all_cores_busy():
    from athlos.ml.boosting import whole_rounds
    assert [whole_rounds(p, 8) for p in (1, 8, 9, 15, 16, 100)] == [8, 8, 8, 8, 16, 96]


def test_paths_by_columns_match_a_walk_per_row():
    import numpy as np

    from athlos.ml import boosting
    r = np.random.default_rng(0)
    bins = r.integers(0, 8, (40, 5)).astype(np.uint8)
    for depth in (1, 3, 5):
        n = 2 ** depth - 1
        tree = boosting.Round(r.integers(0, 5, (3, n)), np.where(r.random((3, n)) < 0.2, 255, r.integers(0, 8, (3, n))), r.normal(0, 1, (3, n + 1)))
        for levels in range(depth + 1):
            got = boosting.descend(bins, tree, levels)
            for c in range(3):
                for i in range(40):
                    node = 0
                    for level in range(levels):
                        at = 2 ** level - 1 + node
                        node = 2 * node + int(bins[i, tree.feature[c, at]] > tree.cut[c, at])
                    assert got[i, c] == node
