import os
import tempfile

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bundle(spark):
    from athlos.ml.train import train_compare
    from athlos.sources.tables import sessions
    return train_compare(sessions(spark, SF), models=("logreg",), draws=3, folds=2, balance=None)


def test_training_learns_rule_labels(bundle):
    rows = {r.key: r for r in bundle.comparison.collect()}
    assert rows["logreg"].model == "Logistic Regression" and rows["logreg"].f1 > 0.5
    assert rows["rule"].accuracy == 1.0 and bundle.best == "logreg"
    assert bundle.labels == sorted(bundle.labels)


def test_feature_importance_names(bundle):
    from athlos.ml.train import feature_importance
    fi = feature_importance(bundle).collect()
    assert len(fi) == 15 and [r.rank for r in fi] == list(range(1, 16))
    assert all(r.feature in bundle.names for r in fi)


def test_score_appends_columns_and_save_load_same_rows(spark, bundle):
    from athlos.ml.score import load_bundle, save_bundle, score_batch
    from athlos.sources.tables import sessions
    s = sessions(spark, SF)
    a = score_batch(bundle, s)
    assert a.columns[:len(s.columns)] == s.columns
    assert sorted(map(repr, a.select(*s.columns).collect())) == sorted(map(repr, s.collect()))    # values untouched
    assert {"predicted_label", "pred_recommendation", "top1_label", "top3_proba"} <= set(a.columns)
    path = tempfile.mkdtemp(prefix="bundle-", dir=spark.sparkContext.getCheckpointDir().replace("file:", ""))
    save_bundle(bundle, path)
    b = score_batch(load_bundle(spark, path), s)
    left = {r.session_id: (r.predicted_label, r.top1_proba) for r in a.collect()}
    right = {r.session_id: (r.predicted_label, r.top1_proba) for r in b.collect()}
    assert left == right


def test_score_one_record_with_missing_inputs(spark, bundle):
    from athlos.ml.score import score_one
    rec = {"athlete_id": "A001", "session_id": 20, "heart_rate_bpm": 150.0, "performance_score": 93.93,
           "injury_risk_score": 0.61, "risk_level": "Élevé", "hr_zone": "Zone_Anaerobie",
           "performance_level": "Excellente", "event_type": "high_jump"}
    out = score_one(bundle, rec, spark)
    assert out["predicted_label"] in bundle.labels
    assert out["hour"] == 0 and out["dayofweek"] == 0


def test_evaluate_report(spark, bundle):
    from athlos.ml.score import evaluate_batch
    from athlos.sources.tables import sessions
    rep = {r["class"]: r for r in evaluate_batch(bundle, sessions(spark, SF)).collect()}
    assert rep["accuracy"].f1 > 0.5 and rep["accuracy"].support == 1000


def test_stream_equals_batch(spark, bundle):
    from athlos.ml.score import score_batch
    from athlos.sources.tables import sessions
    from athlos.streaming.score_stream import score_stream
    base = spark.sparkContext.getCheckpointDir().replace("file:", "")
    run = tempfile.mkdtemp(prefix="stream-", dir=base)
    st = score_stream(spark, bundle, SF, os.path.join(run, "out"), os.path.join(run, "ck"))
    batch = {r.session_id: r.predicted_label for r in score_batch(bundle, sessions(spark, SF)).collect()}
    streamed = {r.session_id: r.predicted_label for r in st.collect()}
    assert streamed == batch


def test_stream_keeps_late_files(spark, bundle, tmp_path):
    from athlos.sources.tables import read_table
    from athlos.streaming.score_stream import score_stream
    e = read_table(spark, SF, "events").orderBy(F.desc("ts")).toPandas()
    import pyarrow as pa
    import pyarrow.parquet as pq
    src = tmp_path / "src"
    src.mkdir()
    table = pa.Table.from_pandas(e, preserve_index=False)
    step = -(-len(e) // 5)
    for k in range(5):                                             # newest first, with a repeated row per file
        part = table.slice(k * step, step)
        pq.write_table(pa.concat_tables([part, part.slice(0, 1)]), src / f"events-{k}.parquet", coerce_timestamps="us")
        os.utime(src / f"events-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    for files in (1, None):
        out = score_stream(spark, bundle, str(src), str(tmp_path / f"out{files}"), str(tmp_path / f"ck{files}"), max_files=files)
        ids = [r.session_id for r in out.select("session_id").collect()]
        assert sorted(ids) == sorted(e["event_id"].tolist())


def test_one_failing_draw_does_not_sink_its_family(spark):
    import threading
    import time

    from athlos.ml.train import search
    train = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(20)], "id long, fold long, label double")
    running, most, lock = [0], [0], threading.Lock()

    class Model:
        def __init__(self, good):
            self.good = good

        def transform(self, d):
            return self.good

    class Estimator:
        def fit(self, rows, params):
            with lock:
                running[0] += 1
                most[0] = max(most[0], running[0])
            time.sleep(0.3)
            with lock:
                running[0] -= 1
            if params["k"] == 0:
                raise ValueError("no fit")
            return Model(params["k"])

    class Evaluator:
        def evaluate(self, predicted):
            return float(predicted)
    best, scores = search(Estimator(), [{"k": 0}, {"k": 2}, {"k": 1}], train, 2, lambda r: r, Evaluator())
    assert best == {"k": 2} and scores == [0.0, 2.0, 1.0] and most[0] > 1


def test_smote_evidence(spark):
    from athlos.ml.balance import smote
    from pyspark.ml.functions import vector_to_array
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    d = e.select("vec_id", F.col("label").cast("long").alias("label"),
                 array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    b = smote(d, "label", "features", "vec_id", k=5).where("is_synthetic")
    x = d.select("vec_id", F.col("label").alias("base_label"), vector_to_array("features").alias("x"))
    y = d.select(F.col("vec_id").alias("neighbour_id"), F.col("label").alias("near_label"), vector_to_array("features").alias("y"))
    j = b.withColumn("z", vector_to_array("features")).join(x, "vec_id").join(y, "neighbour_id", "left").collect()
    assert len(j) == b.count() and len({(r.vec_id, r.slot) for r in j}) == len(j)
    for r in j:
        assert r.base_label == r.label and 0 <= r.step < 1
        if r.neighbour_id is not None:
            assert r.near_label == r.label
            assert r.z == pytest.approx([p + r.step * (q - p) for p, q in zip(r.x, r.y)])


def test_injury_model(spark):
    """23 numeric and 3 categorical features, its own names, fallback and top three."""
    from athlos.ml.score import evaluate_batch, load_bundle, save_bundle, score_batch
    from athlos.ml.train import train_compare
    from athlos.sources.tables import injury_sessions
    from athlos.spec import INJURY_SPEC
    s = injury_sessions(spark, SF)
    b = train_compare(s, INJURY_SPEC, models=("logreg",), draws=1, folds=2, balance=None)
    assert (len(b.layout.numeric), len(b.layout.categorical)) == (23, 3)
    out = score_batch(b, s)
    assert {"pred_risk_level", "pred_hr_zone", "pred_event_type", "top3_label"} <= set(out.columns)
    assert "pred_performance_level" not in out.columns
    r = out.first()
    assert r.predicted_label == "__".join([r.pred_risk_level, r.pred_hr_zone, r.pred_event_type])
    report = {x["class"] for x in evaluate_batch(b, s).collect()}
    assert set(b.labels) <= report
    with pytest.raises(ValueError, match="recommendation_blessure"):
        evaluate_batch(b, s.drop("recommendation_blessure"))
    with pytest.raises(ValueError, match="lacks: signal_energy"):
        train_compare(s.drop("signal_energy"), INJURY_SPEC, models=("logreg",), draws=1, folds=2, balance=None)


def test_smote_balances_and_stays_in_class_box(spark):
    from athlos.ml.balance import smote
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    d = e.select("vec_id", F.col("label").cast("long").alias("label"),
                 array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    b = smote(d, "label", "features", "vec_id", k=5).cache()
    sizes = {r.label: r.n for r in b.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert len(set(sizes.values())) == 1
    assert b.where("not is_synthetic").count() == d.count()
    from pyspark.ml.functions import vector_to_array
    arr = b.withColumn("a", vector_to_array("features"))
    box = arr.where("not is_synthetic").groupBy("label").agg(
        *[F.min(F.col("a")[i]).alias(f"lo{i}") for i in range(3)], *[F.max(F.col("a")[i]).alias(f"hi{i}") for i in range(3)])
    j = arr.where("is_synthetic").join(box, "label")
    for i in range(3):
        assert j.where((F.col("a")[i] < F.col(f"lo{i}") - 1e-9) | (F.col("a")[i] > F.col(f"hi{i}") + 1e-9)).count() == 0


def test_duplicate_balance(spark):
    from athlos.ml.balance import duplicate_balance
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(7)], "id long, label string")
    out = duplicate_balance(df, "label", "id")
    sizes = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sizes == {"a": 5, "b": 5}


def test_boosting_in_train_compare_on_few_classes(spark):
    from athlos.ml.train import feature_importance, train_compare
    from athlos.sources.tables import sessions
    from athlos.spec import SessionSpec
    spec = SessionSpec(label_parts=("risk_level",))
    b = train_compare(sessions(spark, SF), spec, models=("boosting",), draws=1, folds=2, tree_scale=0.01,
                      balance=None)
    row = [r for r in b.comparison.collect() if r.key == "boosting"][0]
    assert row.model == "Gradient Boosting" and row.f1 > 0.5
    fi = feature_importance(b).collect()
    assert fi[0].metric == "Importance" and len(fi) == 15


def test_flags_only_input_derives_event_type(spark, bundle):
    from athlos.ml.score import score_one
    rec = {"athlete_id": "A006", "session_id": 101, "timestamp": "2024-06-01 08:15:00", "heart_rate_bpm": 0.6,
           "performance_score": 88.5, "injury_risk_score": 0.25, "risk_level": "Modéré", "hr_zone": "Zone_Aerobie",
           "performance_level": "Excellente", "event_type_high_jump": 0, "event_type_long_jump": 0,
           "event_type_sprint": 1}
    out = score_one(bundle, rec, spark)
    assert out["event_type"] == "sprint" and out["hour"] == 8 and out["dayofweek"] == 5
    assert out["hr_critical_flag"] == "normal"


def test_smote_inside_the_search(spark):
    from athlos.ml.train import train_compare
    from athlos.sources.tables import sessions
    from athlos.spec import SessionSpec
    spec = SessionSpec(label_parts=("risk_level", "hr_zone"))
    b = train_compare(sessions(spark, SF), spec, models=("logreg",), draws=2, folds=2, balance="smote")
    row = [r for r in b.comparison.collect() if r.key == "logreg"][0]
    assert row.f1 > 0.3 and b.model.stages[-1] is not None


def test_load_missing_bundle_names_the_parts(spark, tmp_path):
    from athlos.ml.score import load_bundle
    with pytest.raises(ValueError, match="lacks: model, lookup, comparison, meta"):
        load_bundle(spark, str(tmp_path / "nothing"))
