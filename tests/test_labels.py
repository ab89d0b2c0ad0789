import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from athlos.operators import encode, labels
from athlos.spec import INJURY_LABEL_PARTS, TRAINING_LABEL_PARTS

# Golden rows (retyped from the reference's sample sessions): risk, zone, level, event, performance, risk score.
GOLDEN = [
    (20, "Élevé", "Zone_Anaerobie", "Excellente", "high_jump", 93.93, 0.6118),
    (101, "Modéré", "Zone_Aerobie", "Excellente", "sprint", 88.5, 0.25),
    (102, "Élevé", "Zone_Anaerobie", "Bonne", "long_jump", 72.3, 0.61),
    (103, "Critique", "Zone_Max", "Insuffisante", "sprint", 55.8, 0.88),
    (104, "Faible", "Zone_Anaerobie", "Excellente", "high_jump", 97.2, 0.04),
    (110, "Critique", "Zone_Basse", "Insuffisante", "sprint", 48.2, 0.97),
    (112, "Faible", "Zone_Max", "Excellente", "sprint", 98.4, 0.06),
]


def golden_df(spark):
    rows = []
    for sid, risk, zone, level, event, perf, rs in GOLDEN:
        flags = [1 if event == e else 0 for e in ("high_jump", "long_jump", "sprint")]
        rows.append((sid, risk, zone, level, *flags, perf, rs))
    return spark.createDataFrame(rows, "session_id long, risk_level string, hr_zone string, performance_level string, "
                                       "event_type_high_jump int, event_type_long_jump int, event_type_sprint int, "
                                       "performance_score double, injury_risk_score double")


def test_golden_training_and_injury_labels(spark):
    df = encode.hr_critical_flag(encode.flags_to_category(golden_df(spark)))
    t = labels.composite_label(df, TRAINING_LABEL_PARTS, "train_label")
    t = labels.composite_label(t, INJURY_LABEL_PARTS, "injury_label")
    got = {r.session_id: (r.train_label, r.injury_label) for r in t.collect()}
    assert got[20] == ("Élevé__Zone_Anaerobie__Excellente__high_jump__normal", "Élevé__Zone_Anaerobie__high_jump")
    assert got[103] == ("Critique__Zone_Max__Insuffisante__sprint__critical", "Critique__Zone_Max__sprint")
    assert got[112] == ("Faible__Zone_Max__Excellente__sprint__critical", "Faible__Zone_Max__sprint")


def test_null_part_does_not_shift(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert labels.composite_label(df, ["x", "y", "z", "absent"], "l").collect()[0].l == "a__?__c__?"


def test_label_parts_round_trip(spark):
    df = spark.createDataFrame([("A__B__C",), ("A__B",)], "predicted_label string")
    out = labels.label_parts(df, ["p1", "p2", "p3"]).collect()
    assert (out[0].p1, out[0].p2, out[0].p3) == ("A", "B", "C") and out[1].p3 is None


def test_48_injury_labels_code_point_order(spark):
    risks = ("Faible", "Modéré", "Élevé", "Critique")
    zones = ("Zone_Basse", "Zone_Aerobie", "Zone_Anaerobie", "Zone_Max")
    events = ("high_jump", "long_jump", "sprint")
    all_labels = ["__".join(p) for p in itertools.product(risks, zones, events)]
    df = spark.createDataFrame([(x,) for x in all_labels], "target_label string")
    coded = {r.target_label: r.label_code for r in labels.label_codes(df).collect()}
    assert len(coded) == 48 and sorted(coded.values()) == list(range(48))
    assert coded["Critique__Zone_Aerobie__high_jump"] == 0
    assert min(v for k, v in coded.items() if k.startswith("Élevé")) > max(
        v for k, v in coded.items() if k.startswith("Modéré"))
    codes = labels.codes_of(spark, sorted(all_labels))
    decoded = labels.decode(labels.encode(df, codes, out="code"), codes).collect()
    assert all(r.decoded == r.target_label for r in decoded) and len(decoded) == 48


def test_lookup_first_text_and_fallback(spark):
    df = spark.createDataFrame([(3, "L1", "late"), (1, "L1", None), (2, "L1", "early"), (4, "L2", None)],
                               "session_id long, target_label string, recommendation_entrainement string")
    lk = {r.target_label: r.recommendation_entrainement for r in labels.build_lookup(df).collect()}
    assert lk == {"L1": "early", "L2": None}
    scored = spark.createDataFrame([("L1",), ("L9",)], "predicted_label string")
    out = {r.predicted_label: r.pred_recommendation for r in labels.lookup_join(scored, labels.build_lookup(df)).collect()}
    assert out == {"L1": "early", "L9": "(no recommendation text for label: L9)"}


def test_drop_singletons_and_unseen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, target_label string")
    assert sorted(r.id for r in labels.drop_singletons(df).collect()) == [1, 2]
    t = labels.known_or_first(df.withColumnRenamed("target_label", "true_label"), labels.codes_of(spark, ["a"]))
    got = {r.id: (r.true_label_known, r.is_unseen) for r in t.collect()}
    assert got[3] == ("a", True) and got[1] == ("a", False)


def test_history_seq_matches_plain_window(spark):
    from athlos.sources.tables import sessions
    s = sessions(spark, "/root/testdata/sf0.001").select("athlete_id", "session_id", "timestamp")
    a = {(r.athlete_id, r.session_id): r.seq for r in labels.history_seq(s).collect()}
    w = Window.partitionBy("athlete_id").orderBy(F.col("timestamp").asc_nulls_last(), "session_id")
    b = {(r.athlete_id, r.session_id): r.seq for r in s.withColumn("seq", F.row_number().over(w)).collect()}
    assert a == b and len(a) == s.count()


def test_output_path_and_history_export(spark, tmp_path):
    from athlos.operators import insights
    from athlos.sources.files import export_history, scored_output_path
    assert scored_output_path("/d/new_athletes.csv") == "/d/new_athletes_predictions.parquet"
    df = spark.createDataFrame([("A1", 2, "2024-01-02 10:00:00", "sprint", "Faible", "Zone_Basse", "Bonne", 50.0, "x | y"),
                                ("A1", 1, "2024-01-01 10:00:00", "sprint", "Faible", "Zone_Basse", "Bonne", 60.0, None)],
                               "athlete_id string, session_id long, timestamp string, event_type string, "
                               "risk_level string, hr_zone string, performance_level string, "
                               "performance_score double, recommendation_entrainement string")
    cols = {"event_type": "event", "risk_level": "risk", "hr_zone": "hr_zone", "performance_level": "perf_level",
            "performance_score": "performance_score"}
    h = insights.prediction_history(df, cols, "recommendation_entrainement")
    assert {r.session_id: r.seq for r in h.collect()} == {1: 1, 2: 2}
    export_history(h, str(tmp_path / "hist"))
    back = spark.read.option("header", True).csv(str(tmp_path / "hist"))
    assert back.columns == ["seq", "event", "risk", "hr_zone", "perf_level", "performance_score", "recommendation"]
