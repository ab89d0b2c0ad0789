"""Registered queries that run the scoring, evaluation, streaming and training code paths on models a SQL twin can state.

The rule bundle is an ordinary ``TrainedBundle`` whose last stage computes prediction and probabilities by SQL from one
score, so ``score_batch``, ``evaluate_batch``, the stream, top-3, lookup and fallback run unchanged on it.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..ml import features
from ..ml.balance import smote
from ..ml.score import evaluate_batch, score_batch, write_scored
from ..ml.train import TrainedBundle
from ..operators import encode, insights, labels, topk
from ..sources.files import export_history
from ..sources.tables import injury_sessions, read_table, sessions
from ..spec import INJURY_SPEC, SENSOR_COLUMNS, TRAINING_LABEL_PARTS
from ..streaming.score_stream import score_stream
from .catalog import _scratch, injury_labelled, labelled_sessions, out
from .oracle import LABELLED, SESSION_COLUMNS, SESSIONS, _w

SCALED = ("heart_rate_bpm", "step_frequency_hz", "accelerometer_x")


def rule_bundle(spark, sf) -> TrainedBundle:
    """Labels and lookup of the injury label; the class is the score's place in the label list. Labels that end in
    ``sprint`` have no lookup row, so the fallback text runs."""
    lab = injury_labelled(spark, sf)
    names = labels.sorted_labels(lab)
    k = len(names)
    score = f"greatest(coalesce(injury_risk_score, 0D), 0D) * {k}D"
    rule = SQLTransformer(statement=(
        f"SELECT *, CAST(least(floor({score}), {k - 1}) AS DOUBLE) AS prediction, "
        f"transform(sequence(0, {k - 1}), i -> 1D / (2D + abs(i - {score}))) AS probability FROM __THIS__"))
    lookup = (labels.build_lookup(lab.where(~F.col("target_label").endswith("sprint")))
              .withColumnRenamed("recommendation_entrainement", INJURY_SPEC.text_column))
    layout = features.FeatureLayout(list(INJURY_SPEC.numeric_features), list(INJURY_SPEC.categorical_features))
    return TrainedBundle(PipelineModel([rule]), names, lookup, layout, INJURY_SPEC, "rule", lookup)


def q_score_rule(spark, sf):
    return out(score_batch(rule_bundle(spark, sf), injury_sessions(spark, sf)))


def q_score_passthrough(spark, sf):
    s = sessions(spark, sf)
    return out(score_batch(rule_bundle(spark, sf), s).select(*s.columns))


def q_evaluate_rule(spark, sf):
    return out(evaluate_batch(rule_bundle(spark, sf), injury_sessions(spark, sf)))


def q_stream_rule(spark, sf):
    run = _scratch(spark, "stream")
    res = score_stream(spark, rule_bundle(spark, sf), sf, f"{run}/out", f"{run}/ckpt")
    return out(res.select("session_id", "predicted_label", "pred_recommendation", "top1_label"))


def q_scored_write(spark, sf):
    """IO7: the scored batch written to its default path beside the input's name, read back."""
    run = _scratch(spark, "scored")
    path = write_scored(rule_bundle(spark, sf), injury_sessions(spark, sf), f"{run}/batch.csv")
    return out(spark.read.parquet(path).select("session_id", "predicted_label", "pred_recommendation", "top1_label"))


def q_history_export(spark, sf):
    """IO8: the seven history columns as CSV, read back."""
    cols = {"event_type": "event", "risk_level": "risk", "hr_zone": "hr_zone", "performance_level": "perf_level",
            "performance_score": "performance_score"}
    path = _scratch(spark, "history")
    export_history(insights.prediction_history(labelled_sessions(spark, sf), cols, "recommendation_entrainement"), path)
    back = spark.read.option("header", True).csv(path)
    return out(back.withColumns({"seq": F.col("seq").cast("long"), "performance_score": F.col("performance_score").cast("double")}))


def q_true_label(spark, sf):
    """FE16 on a table with event flags instead of the text."""
    s = encode.one_hot(labelled_sessions(spark, sf).drop("target_label", "hr_critical_flag"),
                       {"event_type": ("high_jump", "long_jump", "sprint")})
    return out(labels.true_label(s, list(TRAINING_LABEL_PARTS)).select("session_id", "true_label"))


def q_engineered_injury(spark, sf):
    """MD14, injury half: 23 numeric and 3 categorical inputs."""
    d = features.engineer(injury_sessions(spark, sf), INJURY_SPEC)
    return out(d.select("session_id", *INJURY_SPEC.numeric_features, *INJURY_SPEC.categorical_features))


def q_scaled_features(spark, sf):
    """FE19-FE21: fill, population-std scaling, one-hot and assembled vector of three sensors and one category."""
    s = sessions(spark, sf).select("session_id", *SCALED, "performance_level")
    layout = features.FeatureLayout(list(SCALED), ["performance_level"])
    d = Pipeline(stages=features.fit_feature_stages(s, layout)).fit(s).transform(s)
    d = d.withColumn("v", vector_to_array("features"))
    names = [*SCALED, "is_bonne", "is_excellente", "is_insuffisante"]
    return out(d.select("session_id", F.size("v").alias("width"), *[F.col("v")[i].alias(n) for i, n in enumerate(names)]))


def q_mean_abs_coefficient(spark, sf):
    """AG17 on class-wise sensor means: mean absolute value over classes per feature, ranked."""
    per = labelled_sessions(spark, sf).groupBy("risk_level").agg(*[F.avg(c).alias(c) for c in SENSOR_COLUMNS])
    long = per.unpivot(["risk_level"], list(SENSOR_COLUMNS), "feature", "coefficient")
    return out(topk.top_n(topk.mean_abs(long), "weight", 15, "feature"))


def q_regression_line(spark, sf):
    """AD1 with one feature: slope, intercept and R² of the fitted line."""
    s = sessions(spark, sf).where("performance_score IS NOT NULL AND injury_risk_score IS NOT NULL")
    d = VectorAssembler(inputCols=["injury_risk_score"], outputCol="features").transform(s)
    m = LinearRegression(featuresCol="features", labelCol="performance_score", solver="normal").fit(d)
    return out(spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept), float(m.summary.r2))],
                                     "slope double, intercept double, r2 double"))


def q_smote_evidence(spark, sf):
    """MD3 row by row: each synthetic row against its base and neighbour, summed per class."""
    d = read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    made = smote(d, "label", "features", "vec_id", k=5).where("is_synthetic").withColumn("z", vector_to_array("features"))
    side = lambda i, n: d.select(F.col("vec_id").alias(i), F.col("label").alias(f"{n}_label"),
                                 vector_to_array("features").alias(n))
    j = made.drop("features").join(side("base_id", "x"), F.col("vec_id") == F.col("base_id")).join(
        side("near_id", "y"), F.col("neighbour_id") == F.col("near_id"), "left")
    y = F.coalesce("y", "x")
    off = F.aggregate(F.zip_with(F.col("z"), F.zip_with("x", y, lambda a, b: a + F.col("step") * (b - a)),
                                 lambda p, q: F.abs(p - q)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    ok = lambda c: F.sum(c.cast("long"))
    return out(j.groupBy("label").agg(
        F.count(F.lit(1)).alias("synthetic"), F.count_distinct("vec_id", "slot").alias("distinct_ids"),
        ok((F.col("x_label") == F.col("label")) & F.coalesce(F.col("y_label") == F.col("label"), F.lit(True))).alias("same_class"),
        ok((F.col("step") >= 0) & (F.col("step") < 1)).alias("step_in_range"), ok(off < 1e-9).alias("on_segment")))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}

# ------------------------------------------------------------------------------------------------ SQL twins

_INJURY = """il AS (SELECT *, risk_level || '__' || hr_zone || '__' || event_type AS il FROM labelled),
names AS (SELECT il AS label, row_number() OVER (ORDER BY il) - 1 AS code FROM (SELECT DISTINCT il FROM il)),
k AS (SELECT count(*) AS k FROM names),
lk AS (SELECT il, arg_min(recommendation_entrainement, CASE WHEN recommendation_entrainement IS NOT NULL THEN session_id END) AS txt
       FROM il WHERE NOT il LIKE '%sprint' GROUP BY 1),
sc AS (SELECT s.*, greatest(coalesce(injury_risk_score, 0.0), 0.0) * k AS x, k FROM sessions s, k),
pr AS (SELECT sc.*, n.label AS predicted_label,
         CASE WHEN lk.il IS NULL THEN '(aucune recommendation pour: ' || n.label || ')' ELSE lk.txt END AS pred_recommendation
       FROM sc JOIN names n ON n.code = least(floor(x), k - 1) LEFT JOIN lk ON lk.il = n.label),
tp AS (SELECT session_id, label, 1.0::DOUBLE / (2.0::DOUBLE + abs(code - x)) AS p, row_number() OVER (
         PARTITION BY session_id ORDER BY 1.0::DOUBLE / (2.0::DOUBLE + abs(code - x)) DESC, code DESC) AS r FROM sc, names),
t3 AS (SELECT session_id, """ + ", ".join(
    f"max(CASE WHEN r = {r} THEN label END) AS top{r}_label, max(CASE WHEN r = {r} THEN round_even(p, 4) END) AS top{r}_proba"
    for r in (1, 2, 3)) + """ FROM tp WHERE r <= 3 GROUP BY 1)"""
_DERIVED = ("coalesce(hour(try_cast(\"timestamp\" AS TIMESTAMP)), 0) AS hour, "
            "coalesce(isodow(try_cast(\"timestamp\" AS TIMESTAMP)) - 1, 0) AS dayofweek, "
            "CASE WHEN hr_zone = 'Zone_Max' THEN 'critical' ELSE 'normal' END AS hr_critical_flag")


def _cols(skip=()):
    doubles = {*SENSOR_COLUMNS, "performance_score", "injury_risk_score"}
    return ", ".join(f'round({c}, 6) AS {c}' if c in doubles else c for c in SESSION_COLUMNS if c not in skip)


_BRIEF = "SELECT session_id, predicted_label, pred_recommendation, top1_label FROM pr JOIN t3 USING (session_id)"
_FLAGS = {c: c.split("_", 2)[2] for c in INJURY_SPEC.flag_features}
ORACLE = {
    "score_rule": _w(SESSIONS, LABELLED, _INJURY) + f"""SELECT {_cols(('recommendation_entrainement',))},
        regexp_replace(recommendation_entrainement, '^Niveau', 'Prévention niveau') AS recommendation_blessure, {_DERIVED},
        string_split(predicted_label, '__')[1] AS pred_risk_level, string_split(predicted_label, '__')[2] AS pred_hr_zone,
        string_split(predicted_label, '__')[3] AS pred_event_type, predicted_label, pred_recommendation, t3.* EXCLUDE (session_id)
        FROM pr JOIN t3 USING (session_id)""",
    "score_passthrough": _w(SESSIONS) + f"SELECT {_cols()} FROM sessions",
    "evaluate_rule": _w(SESSIONS, LABELLED, _INJURY) + """, e AS (SELECT predicted_label AS p,
        CASE WHEN t IN (SELECT label FROM names) THEN t ELSE (SELECT min(label) FROM names) END AS a FROM (
          SELECT *, coalesce(risk_level, '?') || '__' || coalesce(hr_zone, '?') || '__' || event_type AS t FROM pr)),
      c AS (SELECT label AS class, (SELECT count(*) FROM e WHERE a = label) AS support,
        (SELECT count(*) FROM e WHERE p = label) AS np, (SELECT count(*) FROM e WHERE p = label AND a = label) AS tp FROM names),
      m AS (SELECT class, support, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS re FROM c),
      f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
      SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, support FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END) FROM e), 6), (SELECT count(*) FROM e)
      UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
      UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
        round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f""",
    "stream_rule": _w(SESSIONS, LABELLED, _INJURY) + _BRIEF,
    "scored_write": _w(SESSIONS, LABELLED, _INJURY) + _BRIEF,
    "history_export": _w(SESSIONS, LABELLED) + """SELECT row_number() OVER (PARTITION BY athlete_id
        ORDER BY "timestamp" NULLS LAST, session_id) AS seq, event_type AS event, risk_level AS risk, hr_zone, performance_level AS perf_level,
        round(performance_score, 6) AS performance_score, substr(coalesce(recommendation_entrainement, ''), 1, 80) || '…' AS recommendation
        FROM labelled2""",
    "true_label": _w(SESSIONS, LABELLED) + "SELECT session_id, target_label AS true_label FROM labelled2",
    "engineered_injury": _w(SESSIONS) + "SELECT session_id, " + ", ".join(
        [f"round({c}, 6) AS {c}" for c in (*SENSOR_COLUMNS, "performance_score", "injury_risk_score")]
        + ["CASE risk_level WHEN 'Faible' THEN 0 WHEN 'Élevé' THEN 2 WHEN 'Critique' THEN 3 ELSE 1 END AS risk_level_encoded",
           "CASE hr_zone WHEN 'Zone_Basse' THEN 0 WHEN 'Zone_Anaerobie' THEN 2 WHEN 'Zone_Max' THEN 3 ELSE 1 END AS hr_zone_encoded"]
        + [f"CASE WHEN {'_'.join(c.split('_', 2)[:2])} = '{v}' THEN 1 ELSE 0 END AS {c}" for c, v in _FLAGS.items()]
        + ["risk_level", "hr_zone", "event_type"]) + " FROM sessions",
    "scaled_features": _w(SESSIONS) + ", f AS (SELECT session_id, performance_level, " + ", ".join(
        f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM sessions)) AS {c}" for c in SCALED) + " FROM sessions) "
        "SELECT session_id, 6 AS width, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM f), 6) AS {c}"
        for c in SCALED) + ", " + ", ".join(
        f"CASE WHEN performance_level = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS is_{v.lower()}" for v in ("Bonne", "Excellente", "Insuffisante"))
        + " FROM f",
    "mean_abs_coefficient": _w(SESSIONS, LABELLED) + ", g AS (SELECT risk_level, " + ", ".join(
        f"avg({c}) AS {c}" for c in SENSOR_COLUMNS) + " FROM labelled2 GROUP BY 1), w AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({c})) AS weight FROM g" for c in SENSOR_COLUMNS) + ") "
        "SELECT feature, round(weight, 6) AS weight, row_number() OVER (ORDER BY weight DESC, feature) AS rank FROM w",
    "regression_line": _w(SESSIONS) + "SELECT round(regr_slope(performance_score, injury_risk_score), 6) AS slope, "
        "round(regr_intercept(performance_score, injury_risk_score), 6) AS intercept, "
        "round(regr_r2(performance_score, injury_risk_score), 6) AS r2 FROM sessions",
    "smote_evidence": "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), "
        "d AS (SELECT label::BIGINT AS label, (SELECT max(n) FROM c) - n AS s FROM c) SELECT label, s AS synthetic, s AS distinct_ids, "
        "s AS same_class, s AS step_in_range, s AS on_segment FROM d WHERE s > 0",
}
