import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from athlos.operators import metrics, split


def scored(spark):
    data = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    return spark.createDataFrame(data, "actual double, predicted double")


def test_weighted_metrics_match_evaluator(spark):
    df = scored(spark)
    ours = metrics.weighted_prf(df).collect()[0]
    ev = MulticlassClassificationEvaluator(labelCol="actual", predictionCol="predicted")
    for ours_name, name in [("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1"),
                            ("accuracy", "accuracy")]:
        assert ours[ours_name] == pytest.approx(ev.setMetricName(name).evaluate(df))


def test_class_report_rows(spark):
    rep = {r["class"]: r for r in metrics.class_report(scored(spark)).collect()}
    assert set(rep) == {"0.0", "1.0", "2.0", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].support == 8 and rep["accuracy"].precision is None


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b")], "actual string, predicted string")
    rep = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert rep["b"].precision == 0.0 and rep["b"].f1 == 0.0 and rep["b"].support == 0


def test_stratified_split_invariants(spark):
    from athlos.plans.catalog import labelled_sessions
    lab = labelled_sessions(spark, "/root/testdata/sf0.001").select("session_id", "target_label")
    sp = split.stratified_split(lab, "target_label", "session_id").cache()
    n = sp.count()
    n_test = sp.where("is_test").count()
    assert n == lab.count() and n_test == math.ceil(0.1 * n)
    per = {r.target_label: (r.n, r.t) for r in sp.groupBy("target_label").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n_c, t in per.values():
        assert abs(t - 0.1 * n_test / n * n_c * (n / n_test)) <= 1.0 + 1e-9
    folds = sp.where("not is_test").groupBy("fold").count().collect()
    assert sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]
    again = split.stratified_split(lab, "target_label", "session_id")
    assert sorted(r.session_id for r in again.where("is_test").collect()) == \
        sorted(r.session_id for r in sp.where("is_test").collect())


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_exact_row_number_equals_window(spark, monkeypatch, most):
    from athlos.functions import ranking
    monkeypatch.setattr(ranking, "GROUP_ROWS", most)
    from pyspark.sql import Window
    from athlos.functions.ranking import exact_row_number
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 3 == 0).cast("int")).withColumn(
        "h", F.md5(F.col("id").cast("string")))
    a = exact_row_number(df, ["g"], [F.col("h"), F.col("id")], "r")
    b = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    j = a.join(b.select("id", "r2"), "id")
    assert j.where(F.col("r") != F.col("r2")).count() == 0 and j.count() == 3000


def test_class_weights(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "id int, label string")
    w = {r.id: r.weight for r in split.class_weights(df, "label").collect()}
    assert w[1] == pytest.approx(4 / (2 * 3)) and w[4] == pytest.approx(4 / 2)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_exact_row_number_ranks_null_group(spark, monkeypatch, most):
    from athlos.functions import ranking
    monkeypatch.setattr(ranking, "GROUP_ROWS", most)
    from athlos.functions.ranking import exact_row_number
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "a")], "id long, g string")
    out = exact_row_number(df, ["g"], [F.col("id")], "r")
    got = {r.id: r.r for r in out.collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3}


def test_row_number_with_one_owner_and_one_time(spark):
    from pyspark.sql import Window
    from athlos.operators import labels
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("A"), F.col("id") % 70)).otherwise("busy").alias("athlete_id"),
        F.col("id").alias("session_id"), F.lit("2024-01-01 00:00:00").alias("timestamp")).repartition(9)
    a = labels.history_seq(df)
    b = df.withColumn("want", F.row_number().over(Window.partitionBy("athlete_id").orderBy("timestamp", "session_id")))
    j = a.join(b.select("session_id", "want"), "session_id")
    assert j.count() == 4000 and j.where("seq != want").count() == 0


def test_null_labels_are_kept(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "ab"[i % 2]) for i in range(90)], "id long, label string")
    sp = split.stratified_split(df, "label", "id", test_share=0.1)
    assert sp.count() == 90 and sp.where("is_test").count() == 9
    w = split.class_weights(df, "label")
    assert w.count() == 90 and w.where("label IS NULL").first()["weight"] == pytest.approx(90 / (3 * 30))


def test_report_lists_known_classes_that_do_not_occur(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "actual string, predicted string")
    known = spark.createDataFrame([("a",), ("b",), ("z",)], "label string")
    rep = {r["class"]: r for r in metrics.class_report(df, labels=known).collect()}
    assert tuple(rep["z"])[1:] == (0.0, 0.0, 0.0, 0)
    assert rep["macro avg"].recall == pytest.approx((0.5 + 1 + 0) / 3) and rep["accuracy"].f1 == pytest.approx(2 / 3)
