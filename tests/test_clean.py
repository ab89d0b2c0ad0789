import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from athlos.operators import clean, stats


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("id").collect()]


def test_quartiles_interpolate_linearly(spark):
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    q1, q3 = stats.quartiles(df, ["x"])["x"]
    finite = [v for v in vals if v is not None]
    assert q1 == pytest.approx(np.quantile(finite, 0.25))
    assert q3 == pytest.approx(np.quantile(finite, 0.75))


def test_iqr_clip_bounds_and_keeps_null(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0), (4, 100.0), (5, None)], "id int, x double")
    out = rows(clean.iqr_clip(df, ["x"]), "x")
    q1, q3 = np.quantile([1, 2, 3, 4, 100], [0.25, 0.75])
    hi = q3 + 1.5 * (q3 - q1)
    assert out[4][0] == pytest.approx(hi)
    assert out[5][0] is None
    assert out[0][0] == 1.0


def test_nan_becomes_null_before_statistics(spark):
    from athlos.functions.columns import nan_to_null
    df = spark.createDataFrame([(0, float("nan")), (1, 1.0), (2, 3.0)], "id int, x double")
    df = df.withColumn("x", nan_to_null("x"))
    assert stats.medians(df, ["x"])["x"] == 2.0


def test_sparse_rows_use_all_columns(spark):
    df = spark.createDataFrame([(0, None, None, 1.0), (1, 1.0, None, 1.0), (2, 1.0, 1.0, 1.0)],
                               "id int, a double, b double, c double")
    kept = [r.id for r in clean.sparse_row_filter(df).collect()]
    assert sorted(kept) == [1, 2]       # 2/4 = 0.5 > 0.3 dropped; 1/4 = 0.25 kept


def test_median_impute_and_all_null_column(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, None, None), (2, 4.0, None)], "id int, a double, b double")
    out = rows(clean.median_impute(df, ["a", "b"]), "a", "b")
    assert out == [(1.0, None), (2.5, None), (4.0, None)]


def test_mode_impute_smallest_on_tie(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, c string")
    assert rows(clean.mode_impute(df, ["c"]), "c")[4] == ("a",)


def test_zscore_constant_and_one_row(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (1, 3.0, 5.0)], "id int, a double, k double")
    out = rows(clean.zscore(df, ["a", "k"]), "a", "k")
    sd = math.sqrt(2.0)
    assert out[0][0] == pytest.approx(-1 / sd) and out[1][1] == 5.0
    one = spark.createDataFrame([(0, 2.0)], "id int, a double")
    assert rows(clean.zscore(one, ["a"]), "a") == [(None,)]


def test_minmax_constant_unchanged(spark):
    df = spark.createDataFrame([(0, 1.0, 7.0), (1, 3.0, 7.0)], "id int, a double, k double")
    assert rows(clean.minmax_scale(df, ["a", "k"]), "a", "k") == [(0.0, 7.0), (1.0, 7.0)]


def test_coerce_numeric_under_ansi(spark):
    df = spark.createDataFrame([(0, "12"), (1, "x1"), (2, None), (3, "1.5")], "id int, s string")
    assert rows(clean.coerce_numeric(df, ["s"]), "s") == [(12.0,), (None,), (None,), (1.5,)]


def test_dedupe_null_equals_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "id int, s string")
    assert clean.dedupe(df).count() == 2


def test_clean_chain_shape(spark):
    from athlos.sources.tables import sessions
    s = sessions(spark, "/root/testdata/sf0.001")
    c = clean.clean_sessions(s)
    cols = set(c.columns)
    assert {"event_type_sprint", "motion_class_landing", "risk_level_encoded"} <= cols
    assert "event_type" not in cols and "motion_class" not in cols
    # the sensors are z-scores: mean 0 on every non-constant column
    m = c.agg(F.avg("heart_rate_bpm").alias("m")).collect()[0]["m"]
    assert abs(m) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_selection_equals_numpy(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(0, 1, 3000), rng.exponential(50, 2000), np.full(1500, 3.25),
                           np.round(rng.normal(10, 2, 1000), 1)])
    rng.shuffle(vals)
    rows = [(i, float(v) if i % 97 else None, float(i % 5)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    monkeypatch.setattr(stats, "APPROX_ACCURACY", 20)             # a coarse sketch forces many rounds
    got = stats.exact_select(df, ["x", "y"], (0.0, 0.25, 0.5, 0.75, 0.9, 1.0))
    xs = np.array([r[1] for r in rows if r[1] is not None])
    ys = np.array([r[2] for r in rows])
    for p, g in zip((0.0, 0.25, 0.5, 0.75, 0.9, 1.0), got["x"]):
        assert g == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12)
    for p, g in zip((0.0, 0.25, 0.5, 0.75, 0.9, 1.0), got["y"]):
        assert g == pytest.approx(np.quantile(ys, p), rel=1e-12, abs=1e-12)


def test_selection_with_nan_infinities_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(stats, "APPROX_ACCURACY", 50)
    rng = np.random.default_rng(3)
    body = rng.normal(0, 1, 3000).tolist()
    for extra in ([float("nan")] * 40, [float("inf")], [float("-inf"), float("inf")] * 5, [1.7e308, -1.7e308]):
        vals = body + extra
        got = stats.quartiles(spark.createDataFrame([(v,) for v in vals], "x double"), ["x"])["x"]
        kept = sorted(v for v in vals if v == v)
        for p, g in zip((0.25, 0.75), got):
            h = p * (len(kept) - 1)
            a, b = kept[int(h)], kept[min(int(h) + 1, len(kept) - 1)]
            assert g == pytest.approx(a + (h - int(h)) * (b - a), rel=1e-12)
    everything = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert stats.quartiles(everything, ["x"]) == {"x": (None, None)}


def test_selection_matches_percentile_on_sessions(spark):
    from athlos.sources.tables import sessions
    from athlos.spec import SENSOR_COLUMNS
    s = sessions(spark, "/root/testdata/sf0.001")
    a = stats.quartiles(s, SENSOR_COLUMNS, "exact")
    b = s.agg(*[F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in SENSOR_COLUMNS]).first()
    for c in SENSOR_COLUMNS:
        assert a[c] == pytest.approx(tuple(b[c]), rel=1e-12, abs=1e-12)


def test_clean_chain_checkpoint_equals_persist(spark):
    from athlos.sources.tables import sessions
    s = sessions(spark, "/root/testdata/sf0.001")
    a = clean.clean_sessions(s, materialize="persist").select("session_id", "heart_rate_bpm").collect()
    b = clean.clean_sessions(s, materialize="checkpoint").select("session_id", "heart_rate_bpm").collect()
    assert sorted(a) == sorted(b)


def test_drop_missing_target_counts_dropped(spark):
    from pyspark.sql import Observation
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id int, t string")
    obs = Observation("target")
    kept = clean.drop_missing_target(df, "t", obs)
    assert [r.id for r in kept.collect()] == [1]
    assert obs.get == {"rows": 3, "dropped": 2}
