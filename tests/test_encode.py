from athlos.operators import encode


def test_one_hot_missing_is_all_zero(spark):
    df = spark.createDataFrame([(0, "sprint"), (1, None)], "id int, event_type string")
    out = encode.one_hot(df, {"event_type": ("high_jump", "long_jump", "sprint")}).orderBy("id").collect()
    assert [out[0][c] for c in ("event_type_high_jump", "event_type_long_jump", "event_type_sprint")] == [0, 0, 1]
    assert [out[1][c] for c in ("event_type_high_jump", "event_type_long_jump", "event_type_sprint")] == [0, 0, 0]
    assert "event_type" not in out[0].asDict()


def test_ordinal_unmapped_null_and_default(spark):
    df = spark.createDataFrame([(0, "Élevé"), (1, "zzz"), (2, None)], "id int, risk_level string")
    maps = {"risk_level": ("Faible", "Modéré", "Élevé", "Critique")}
    a = [r.risk_level_encoded for r in encode.ordinal_encode(df, maps).orderBy("id").collect()]
    b = [r.risk_level_encoded for r in encode.ordinal_default(df, maps).orderBy("id").collect()]
    assert a == [2, None, None] and b == [2, 1, 1]


def test_flags_last_set_wins(spark):
    df = spark.createDataFrame([(0, 1, 0, 1), (1, 1, None, 0), (2, 0, 0, 0), (3, None, 1, None)],
                               "id int, event_type_high_jump int, event_type_long_jump int, event_type_sprint int")
    out = [r.event_type for r in encode.flags_to_category(df).orderBy("id").collect()]
    assert out == ["sprint", "high_jump", "unknown", "long_jump"]


def test_time_features_monday_zero_and_bad_text(spark):
    df = spark.createDataFrame([(0, "2024-06-01 08:15:00"), (1, "2024-06-03 23:00:00.123"), (2, "nope"), (3, None)],
                               "id int, timestamp string")
    out = [(r.hour, r.dayofweek) for r in encode.time_features(df).orderBy("id").collect()]
    assert out == [(8, 5), (23, 0), (0, 0), (0, 0)]


def test_critical_flag(spark):
    df = spark.createDataFrame([(0, "Zone_Max"), (1, "Zone_Basse"), (2, None)], "id int, hr_zone string")
    assert [r.hr_critical_flag for r in encode.hr_critical_flag(df).orderBy("id").collect()] == \
        ["critical", "normal", "normal"]
