"""Registered queries over splits, trends, growing histories, stored models and incremental class state, with SQL twins."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..ml.regress import performance_regression
from ..ml.score import load_bundle, save_bundle, score_batch, score_one
from ..operators import clean, incremental, split, trends
from ..sources.tables import injury_sessions, sessions
from ..spec import SENSOR_COLUMNS, TRAINING_LABEL_PARTS
from ..streaming.score_stream import session_stream
from ..streaming.tables import run_history
from .catalog import _scratch, labelled_sessions, out
from .oracle import LABELLED, ORACLE as CATALOG_SQL, SESSIONS, _w
from .parity import _BRIEF, _INJURY, rule_bundle

METRICS = (*SENSOR_COLUMNS, "performance_score", "injury_risk_score")


def q_cutoff_split(spark, sf):
    lab = labelled_sessions(spark, sf).select("session_id", "target_label")
    return out(split.cutoff_split(lab, "target_label", "session_id"))


def q_metric_summary(spark, sf):
    return out(trends.metric_summary(sessions(spark, sf), METRICS))


def q_metric_trend(spark, sf):
    return out(trends.metric_trend(sessions(spark, sf), METRICS))


def q_metric_days(spark, sf):
    return out(trends.daily_means(sessions(spark, sf), METRICS))


def q_metric_changes(spark, sf):
    return out(trends.change_points(trends.daily_means(sessions(spark, sf), METRICS)))


def q_stream_history(spark, sf):
    """IN8 / WS4 on the event stream: running numbers per athlete, kept in a table."""
    run = _scratch(spark, "history-stream")
    got = run_history(session_stream(spark, sf).select("athlete_id", "session_id", "timestamp"), run, f"{run}/ckpt")
    return out(got.drop("timestamp"))


def q_bundle_roundtrip(spark, sf):
    """IO9: two versions of a bundle saved, the last one loaded and used."""
    path = _scratch(spark, "bundle")
    bundle = rule_bundle(spark, sf)
    save_bundle(bundle, path)
    save_bundle(bundle, path)
    scored = score_batch(load_bundle(spark, path), injury_sessions(spark, sf))
    return out(scored.select("session_id", "predicted_label", "pred_recommendation", "top1_label"))


def q_score_record(spark, sf):
    """MD12: the first session of the table as one record."""
    first = injury_sessions(spark, sf).orderBy("session_id").first().asDict()
    got = score_one(rule_bundle(spark, sf), {k: v for k, v in first.items() if v is not None}, spark)
    names = ("session_id", "predicted_label", "pred_recommendation", "top1_label")
    return out(spark.createDataFrame([tuple(got[n] for n in names)], "session_id long, predicted_label string, pred_recommendation string, top1_label string"))


def q_regression_fit(spark, sf):
    """AD1 through the library's stages, split and metrics, with a linear regressor on one feature."""
    found = performance_regression(sessions(spark, sf), numeric=("injury_risk_score",), categorical=(),
                                   estimator=LinearRegression(solver="normal"), title="Linear")[1]
    return out(found)


def q_numeric_profile(spark, sf):
    """PF1: the numeric columns the schema rule selects, with their values counted."""
    s = sessions(spark, sf)
    return out(trends.metric_summary(s, clean.numeric_columns(s)).select(F.col("metric").alias("column_name"), "n"))


def q_label_nunique_incremental(spark, sf):
    """AG7: distinct label parts from merged per-day sketches, beside the exact numbers."""
    d = labelled_sessions(spark, sf)
    parts = [*TRAINING_LABEL_PARTS, "target_label"]
    state = incremental.day_state(d, parts, F.substring("timestamp", 1, 10))
    exact = d.agg(*[F.count_distinct(p).alias(p) for p in parts]).unpivot([], parts, "part", "n_distinct")
    both = exact.join(incremental.distinct_estimates(state), "part")
    return out(both.select("part", "n_distinct", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct")).alias("within_5_percent")))


def q_class_sizes_incremental(spark, sf):
    """AG8 from merged per-day counts."""
    state = incremental.day_state(labelled_sessions(spark, sf), ["target_label"], F.substring("timestamp", 1, 10))
    return out(incremental.class_sizes(incremental.merged(state), "target_label"))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}

_LONG = "m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, athlete_id, epoch_us(try_cast(\"timestamp\" AS TIMESTAMP)) / 86400000000.0::DOUBLE AS day, {c}::DOUBLE AS value FROM sessions"
    for c in METRICS) + ")"
_DAYS = """, v AS (SELECT metric, floor(day)::BIGINT AS day, value FROM m WHERE day IS NOT NULL AND value IS NOT NULL),
  d AS (SELECT metric, day, count(*) AS n, avg(value) AS mean FROM v GROUP BY ALL),
  c AS (SELECT metric, unnest(generate_series(min(day), max(day))) AS day FROM d GROUP BY 1),
  days AS (SELECT metric, day, coalesce(n, 0) AS n, mean, last_value(mean IGNORE NULLS) OVER (PARTITION BY metric ORDER BY day) AS filled
    FROM c LEFT JOIN d USING (metric, day))"""
_RANKED = CATALOG_SQL["stratified_split"]
_QUOTA = _RANKED[:_RANKED.index("SELECT r.session_id, r.target_label, r.rank_in_class")]
_STRATA = (_w(SESSIONS, "d AS (SELECT session_id, performance_level AS target_label, performance_score AS y, injury_risk_score AS x FROM sessions "
                        "WHERE performance_score IS NOT NULL)")
           + ", " + _QUOTA[_QUOTA.index("r AS ("):].replace("labelled2", "d"))
ORACLE = {
    "cutoff_split": _QUOTA + """SELECT r.session_id, r.target_label, rank_in_class <= quota AS is_test,
        CAST(CASE WHEN rank_in_class > quota THEN (rank_in_class - quota - 1) * 5 // (n_c - quota) ELSE -1 END AS BIGINT) AS fold
        FROM r JOIN q USING (target_label) JOIN sz USING (target_label)""",
    "metric_summary": _w(SESSIONS, _LONG) + """SELECT metric, count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6) AS mean,
        round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM m GROUP BY 1""",
    "metric_trend": _w(SESSIONS, _LONG) + """SELECT athlete_id, metric, count(*) AS n, round(regr_slope(value, day), 6) AS slope_per_day,
        round(regr_r2(value, day), 6) AS r2, floor(min(day))::BIGINT AS first_day, floor(max(day))::BIGINT AS last_day
        FROM m WHERE day IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""",
    "metric_days": _w(SESSIONS, _LONG) + _DAYS + "SELECT metric, day, n, round(mean, 6) AS mean, round(filled, 6) AS filled FROM days",
    "metric_changes": _w(SESSIONS, _LONG) + _DAYS + """, o AS (SELECT *, filled - avg(filled) OVER (PARTITION BY metric) AS off FROM days),
        a AS (SELECT *, round(abs(sum(off) OVER (PARTITION BY metric ORDER BY day)), 9) AS away FROM o),
        p AS (SELECT metric, day AS change_day FROM a QUALIFY row_number() OVER (PARTITION BY metric ORDER BY away DESC, day) = 1)
        SELECT metric, change_day, round(avg(filled) FILTER (day <= change_day), 6) AS level_before,
        round(avg(filled) FILTER (day > change_day), 6) AS level_after FROM days JOIN p USING (metric) GROUP BY 1, 2""",
    "stream_history": _w(SESSIONS) + """SELECT athlete_id, session_id, row_number() OVER (PARTITION BY athlete_id
        ORDER BY "timestamp" NULLS LAST, session_id) AS seq FROM sessions""",
    "bundle_roundtrip": _w(SESSIONS, LABELLED, _INJURY) + _BRIEF,
    "score_record": _w(SESSIONS, LABELLED, _INJURY) + _BRIEF + " WHERE session_id = (SELECT min(session_id) FROM sessions)",
    "regression_fit": _STRATA + """, s AS (SELECT d.*, rank_in_class <= quota AS test FROM d JOIN r USING (session_id) JOIN q ON q.target_label = d.target_label),
        f AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, count(*) AS n_train FROM s WHERE NOT test),
        e AS (SELECT y, a * x + b AS z, n_train FROM s, f WHERE test)
        SELECT 'Linear' AS model, round(sqrt(avg((y - z) * (y - z))), 6) AS rmse,
        round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 6) AS r2, any_value(n_train) AS n_train, count(*) AS n_test FROM e""",
    "numeric_profile": _w(SESSIONS) + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n FROM sessions" for c in SENSOR_COLUMNS),
    "label_nunique_incremental": _w(SESSIONS, LABELLED) + " UNION ALL ".join(
        f"SELECT '{p}' AS part, count(DISTINCT {p}) AS n_distinct, true AS within_5_percent FROM labelled2" for p in (*TRAINING_LABEL_PARTS, "target_label")),
    "class_sizes_incremental": _w(SESSIONS, LABELLED) + "SELECT target_label AS value, count(*) AS n FROM labelled2 GROUP BY 1",
}
