"""Registered queries of the boosting and neighbour operators, with SQL twins where SQL can state the result."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..ml import boosting, features
from ..ml.neighbours import nearest_rows
from ..operators import labels, metrics, split, stats
from ..sources.tables import read_table
from ..spec import SENSOR_COLUMNS, SessionSpec
from .catalog import labelled_sessions, out
from .oracle import LABELLED, SESSIONS, _w

OCTILES = [k / 8 for k in range(1, 8)]


def q_boosting_round(spark, sf):
    """MD7, first round: the best cut of each class's first tree, its gain and leaf weights (rate 0.1)."""
    d = labels.label_codes(labelled_sessions(spark, sf)).select("session_id", "target_label", "label_code", *SENSOR_COLUMNS)
    x = d.select("session_id", "label_code", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SENSOR_COLUMNS])
    q = stats.quartiles(x, SENSOR_COLUMNS, probs=OCTILES)
    edges = [sorted(set(q[c])) for c in SENSOR_COLUMNS]
    names = labels.sorted_labels(d)
    found: list = []
    rows = x.select("session_id", "label_code", F.array(*SENSOR_COLUMNS).alias("x"))
    r = boosting.fit(rows, edges, len(names), boosting.Setting(1, 0.1, 1, 1.0, 1.0), label="label_code", key="session_id", evidence=found)[0]
    gain, feature, cut, _, _ = found[0]
    table = [(names[c], SENSOR_COLUMNS[feature[c]], float(edges[feature[c]][cut[c]]), float(gain[c]), float(r.leaf[c, 0]), float(r.leaf[c, 1]))
             if gain[c] > 0 else (names[c], None, None, None, None, None) for c in range(len(names))]
    return out(spark.createDataFrame(table, "label string, feature string, threshold double, gain double, left_weight double, right_weight double"))


def q_boosting_fit(spark, sf):
    """MD7 + MD8: one softmax fit of 100 trees a class on the training rows; its prefixes of 25, 50 and 100 rounds judged
    on the test rows."""
    spec = SessionSpec()
    d = features.engineer(labels.drop_singletons(labelled_sessions(spark, sf)), spec)
    d = labels.label_codes(d)
    sp = split.stratified_split(d, "target_label", "session_id", folds=None).checkpoint()
    train, test = sp.where(~F.col("is_test")), sp.where(F.col("is_test"))
    layout = features.FeatureLayout(list(spec.numeric_features), list(spec.categorical_features))
    stages = Pipeline(stages=features.fit_feature_stages(train, layout)).fit(train)
    made = stages.transform(train).select("session_id", "label_code", "features")
    model = boosting.SoftmaxBooster(labelCol="label_code", idCol="session_id", trees=100).fit(made)
    counts = [25, 50, 100]
    judged = model.stages_of(stages.transform(test).select("label_code", "features"), counts).select("label_code", "stages").checkpoint()
    result = None
    for i, n in enumerate(counts):
        m = metrics.weighted_prf(judged.select(F.col("label_code").cast("double").alias("actual"),
                                               boosting.first_largest(F.col("stages")[i]).alias("predicted")))
        m = m.select(F.lit(n).alias("trees"), "accuracy", "precision", "recall", "f1")
        result = m if result is None else result.unionByName(m)
    return out(result)


def q_smote_neighbours(spark, sf):
    """MD3: the five nearest rows of the same class for every embedding."""
    return out(nearest_rows(read_table(spark, sf, "embeddings"), "vec_id", "label", "embedding", 5))


def q_smote_recall(spark, sf):
    """MD3: share of the five nearest same-class rows that the random-projection buckets find, per class."""
    from ..ml.balance import bucket_width, lsh_neighbours
    e = read_table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.col("label").cast("long").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    largest = e.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    hashed = lsh_neighbours(e, e, "label", "features", "vec_id", 5, 42, bucket_width(e, "features", largest))
    exact = nearest_rows(e.withColumn("features", vector_to_array("features")), "vec_id", "label", "features", 5)
    hit = exact.join(hashed.select(F.col("a_id").alias("id"), "nn_id", F.lit(1).alias("hit")), ["id", "nn_id"], "left")
    per = hit.join(e.select(F.col("vec_id").alias("id"), "label"), "id").groupBy("label")
    return out(per.agg(F.count("*").alias("pairs"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"),
                       (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall")))


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}

_GAIN = "(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1))"
ORACLE = {
    "boosting_round": _w(SESSIONS, LABELLED) + ", f AS (" + " UNION ALL ".join(
        f"SELECT target_label AS label, {k} AS feature, coalesce({c}, 0) AS v FROM labelled2" for k, c in enumerate(SENSOR_COLUMNS))
    + f"""), k AS (SELECT label, count(*) AS n_c FROM labelled2l GROUP BY 1),
    u AS (SELECT 1.0::DOUBLE / count(*) AS p, sum(n_c) AS n FROM k),
    w AS (SELECT round((p - 1) * 1073741824) / 1073741824 AS hit, round(p * 1073741824) / 1073741824 AS miss,
      round(2 * p * (1 - p) * 1073741824) / 1073741824 AS curve, n FROM u),
    e AS (SELECT DISTINCT feature, t FROM (SELECT feature, unnest(quantile_cont(v, {OCTILES})) AS t FROM f GROUP BY 1)),
    c AS (SELECT e.feature, t, f.label, count(*) AS n_l FROM f JOIN e ON e.feature = f.feature AND v < t GROUP BY ALL),
    a AS (SELECT feature, t, sum(n_l) AS n_all FROM c GROUP BY ALL),
    s AS (SELECT k.label, a.feature, a.t, coalesce(n_l, 0) * hit + (n_all - coalesce(n_l, 0)) * miss AS gl, n_all * curve AS hl,
      n_c * hit + (n - n_c) * miss AS g, n * curve AS h
      FROM a CROSS JOIN k CROSS JOIN w LEFT JOIN c ON c.feature = a.feature AND c.t = a.t AND c.label = k.label),
    b AS (SELECT *, {_GAIN} AS gain FROM s WHERE hl >= 1 AND h - hl >= 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, feature, t) AS r FROM b)
    SELECT k.label, CASE feature """.replace("labelled2l", "(SELECT target_label AS label FROM labelled2)")
    + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(SENSOR_COLUMNS))
    + """ END AS feature, round(t, 6) AS threshold, round(gain, 6) AS gain, round(-0.1 * gl / (hl + 1), 6) AS left_weight,
      round(-0.1 * (g - gl) / (h - hl + 1), 6) AS right_weight FROM k LEFT JOIN top ON top.label = k.label AND r = 1 AND gain > 0""",
    "smote_neighbours": """WITH d AS (SELECT a.vec_id AS id, b.vec_id AS nn_id,
        sqrt(list_sum([(x - a.embedding[i])::DOUBLE * (x - a.embedding[i])::DOUBLE FOR x, i IN b.embedding])) AS dist
      FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) a
      JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) b
      ON a.label IS NOT DISTINCT FROM b.label AND a.vec_id != b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nn_id) AS nn_rank FROM d)
    SELECT id, nn_rank, nn_id, round(dist, 6) AS dist FROM r WHERE nn_rank <= 5""",
}
