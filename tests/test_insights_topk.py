from pyspark.sql import functions as F

from athlos.operators import insights, topk
from athlos.spec import INJURY_ALERT_UPPER


def test_bands_from_golden_sessions(spark):
    df = spark.createDataFrame([(20, 93.93, 0.612), (110, 48.2, 0.97), (104, 97.2, 0.04)],
                               "session_id long, performance_score double, injury_risk_score double")
    out = insights.high_risk(insights.risk_band(insights.performance_band(df)))
    got = {r.session_id: (r.performance_band, r.risk_band, r.high_risk) for r in out.collect()}
    assert got[20] == ("excellent", "Élevé", True)
    assert got[110] == ("moyen", "Critique", True)
    assert got[104] == ("excellent", "Faible", False)


def test_clauses_drop_empty_and_flag_alerts(spark):
    df = spark.createDataFrame([(1, "A | | ALERTE x || arrêt immédiat |"), (2, None)], "id int, t string")
    rows = insights.recommendation_clauses(df, "t", ["id"]).orderBy("clause_no").collect()
    assert [(r.clause_no, r.clause, r.is_alert) for r in rows] == [
        (1, "A", False), (2, "ALERTE x", True), (3, "arrêt immédiat", True)]
    inj = insights.recommendation_clauses(df, "t", ["id"], INJURY_ALERT_UPPER, ()).orderBy("clause_no").collect()
    assert [r.is_alert for r in inj] == [False, True, True]


def test_preview_and_profile(spark):
    df = spark.createDataFrame([(1, "x" * 100, None, 3.0)], "id int, t string, performance_score double, "
                                                              "heart_rate_bpm double")
    p = insights.preview(df, "t", 80).collect()[0].preview
    assert len(p) == 81 and p.endswith("…")
    prof = insights.biometric_profile(df, ("heart_rate_bpm", "performance_score", "step_frequency_hz")).collect()[0]
    assert prof.profile_heart_rate_bpm == 1.0 and prof.profile_performance_score == 0.5
    assert prof.profile_step_frequency_hz == 0.5


def test_top3_ties_prefer_higher_index(spark):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.2, 0.1]), (2, [0.9, 0.1])], "id int, p array<double>")
    out = topk.top3_wide(df, "p", ["a", "b", "c", "d"]).orderBy("id").collect()
    assert (out[0].top1_label, out[0].top2_label, out[0].top3_label) == ("b", "c", "a")
    assert out[1].top3_label is None
    assert out[0].top1_proba == 0.5


def test_family_rules_first_match(spark):
    df = spark.createDataFrame([("performance_level_Bonne", 1.0), ("injury_risk_score", 2.0), ("gyro", 0.5)],
                               "feature string, weight double")
    fam = {r.feature: r.family for r in insights.feature_family(df).collect()}
    assert fam == {"performance_level_Bonne": "performance_level", "injury_risk_score": "injury", "gyro": "other"}


def test_gauge_and_indicators(spark):
    df = spark.createDataFrame([(1, 120.0, 1.7, 2.345, None), (2, -5.0, -0.2, 0.004, 0.615)],
                               "id int, score double, risk double, hr double, injury_risk_score double")
    g = insights.gauge_value(insights.gauge_value(df, "score", "g1"), "risk", "g2", unit_scale=True)
    got = {r.id: (r.g1, r.g2) for r in g.collect()}
    assert got == {1: (100.0, 100.0), 2: (0.0, 0.0)}
    ind = insights.indicators(df, ("hr", "injury_risk_score"), percent_key="injury_risk_score")
    vals = {r.id: (r.hr, r.injury_risk_score_pct) for r in ind.collect()}
    assert vals[1] == (float(f"{2.345:.2f}"), 0.0) and vals[2] == (0.0, 61.5)


def test_indicator_ties_round_as_fixed_point_text(spark):
    vals = [0.125, 0.375, 2.345, 0.145, 0.155, 0.165, 1.005, 2.675, 0.615, -0.125, 1e15 + 0.5, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    got = {r.id: r.x for r in insights.indicators(df, ("x",)).collect()}
    for i, v in enumerate(vals):
        assert got[i] == float(f"{v:.2f}"), v
