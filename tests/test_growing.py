"""Cutoff split, trends, table-backed streams, versioned bundles and incremental class state."""

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from athlos.operators import incremental, split, trends

SF = "/root/testdata/sf0.001"


def skewed(spark):
    rows = [(i, "big") for i in range(900)] + [(1000 + i, "mid") for i in range(80)] + [(2000 + i, None) for i in range(15)]
    rows += [(3000 + i, f"tiny{i % 3}") for i in range(5)]
    return spark.createDataFrame(rows, "id long, label string")


def plain_split(rows, quotas, folds):
    by = {}
    for i, c in rows:
        by.setdefault(c, []).append((hashlib.md5(f"{i}42".encode()).hexdigest(), i))
    out = {}
    for c, v in by.items():
        q, rest = quotas[c], len(v) - quotas[c]
        for r, (_, i) in enumerate(sorted(v), 1):
            out[i] = (True, -1) if r <= q else (False, (r - q - 1) * folds // rest)
    return out


@pytest.mark.parametrize("folds", [5, 3, None])
def test_cutoff_split_matches_a_sort(spark, folds):
    df = skewed(spark)
    quotas = {r["label"]: r["quota"] for r in split.class_quotas(df, "label").collect()}
    want = plain_split([tuple(r) for r in df.collect()], quotas, folds or 1)
    got = {r["id"]: (r["is_test"], r["fold"] if folds else (-1 if r["is_test"] else 0)) for r in
           split.cutoff_split(df, "label", "id", folds=folds).collect()}
    assert got == want
    same = {r["id"]: r["is_test"] for r in split.stratified_split(df, "label", "id", folds=folds).collect()}
    assert {i: t for i, (t, _) in got.items()} == same


def test_cutoff_split_shuffles_no_full_rows(spark):
    df = skewed(spark).withColumn("payload", F.sha2(F.col("id").cast("string"), 512))
    out = split.cutoff_split(df, "label", "id")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "payload" in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Sort" not in plan
    assert split.cutoff_split(df.limit(0), "label", "id").count() == 0


def test_cutoff_split_of_rows_with_one_id(spark):
    df = spark.createDataFrame([(1, "a")] * 10 + [(2, "a")] * 10, "id long, label string")
    got = split.cutoff_split(df, "label", "id").groupBy("id").agg(F.count_distinct("is_test", "fold").alias("k")).collect()
    assert all(r["k"] == 1 for r in got)                       # equal (hash, id) go together


def test_trends_against_plain_python(spark):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-03 00:00:00", 5.0), ("a", "bad", 9.0), ("a", None, 9.0),
            ("a", "2024-01-05 12:00:00", float("nan")), ("b", "2024-01-02 00:00:00", 2.0), ("b", "2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(rows, "athlete_id string, timestamp string, x double")
    t = {r["athlete_id"]: r for r in trends.metric_trend(df, ["x"]).collect()}
    assert t["a"]["slope_per_day"] == pytest.approx(2.0) and t["a"]["n"] == 2 and t["b"]["slope_per_day"] is None
    s = trends.metric_summary(df, ["x"]).first()
    assert (s["n"], s["missing"], s["min"], s["max"]) == (5, 2, 1.0, 9.0)
    d = {r["day"] - 19723: (r["n"], r["mean"], r["filled"]) for r in trends.daily_means(df, ["x"]).collect()}
    assert d == {0: (1, 1.0, 1.0), 1: (1, 2.0, 2.0), 2: (1, 5.0, 5.0)}
    gaps = spark.createDataFrame([("a", f"2024-01-{k:02d} 00:00:00", 1.0 if k < 9 else 4.0) for k in (1, 2, 5, 6, 9, 14)], df.schema)
    days = trends.daily_means(gaps, ["x"])
    assert [r["filled"] for r in days.orderBy("day").collect()] == [1.0] * 8 + [4.0] * 6
    c = trends.change_points(days).first()
    assert (c["change_day"] - 19723, c["level_before"], c["level_after"]) == (7, 1.0, 4.0)
    assert trends.change_points(trends.daily_means(df.limit(0), ["x"])).count() == 0


def event_files(spark, folder, parts, repeat=True):
    """The events in time order as ``parts`` files, each repeating the first row of all."""
    from athlos.sources.tables import read_table
    e = read_table(spark, SF, "events").orderBy("ts", "event_id").toPandas()
    table = pa.Table.from_pandas(e, preserve_index=False)
    folder.mkdir()
    step = -(-len(e) // parts)
    for k in range(parts):
        piece = table.slice(k * step, step)
        if repeat:
            piece = pa.concat_tables([piece, table.slice(0, 1)])
        pq.write_table(piece, folder / f"events-{k}.parquet", coerce_timestamps="us")
        os.utime(folder / f"events-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return e


def ordered_history(spark):
    """Numbers by event time: sessions with an unreadable time text come when they happen."""
    from athlos.sources.tables import read_table, sessions_from_events
    s = sessions_from_events(read_table(spark, SF, "events"), keep_event_time=True)
    rows = sorted((r["athlete_id"], r["event_time"], r["session_id"]) for r in s.collect())
    out, n = {}, {}
    for a, _, i in rows:
        n[a] = n.get(a, 0) + 1
        out[i] = n[a]
    return out


ORDER = {"order": ("event_time", "session_id")}


def test_history_grows_over_files_and_restarts(spark, tmp_path):
    from athlos.streaming.score_stream import session_stream
    from athlos.streaming.tables import run_history
    event_files(spark, tmp_path / "src", 5)
    late = tmp_path / "src" / "events-4.parquet"
    hidden = tmp_path / "later.parquet"
    os.rename(late, hidden)                                    # four files, then a restart of the stream finds a fifth
    stream = lambda: session_stream(spark, str(tmp_path / "src"), max_files=1).select(
        "athlete_id", "session_id", "event_time")
    first = run_history(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), **ORDER)
    n = first.count()
    os.rename(hidden, late)
    got = run_history(stream(), str(tmp_path / "out"), str(tmp_path / "ck"), **ORDER)
    want = ordered_history(spark)
    assert n < len(want) and {r["session_id"]: r["seq"] for r in got.collect()} == want and got.count() == len(want)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    from athlos.sources.tables import sessions
    from athlos.streaming.tables import batches_of, history_batch
    s = sessions(spark, SF).select("athlete_id", "session_id", "timestamp")
    path = str(tmp_path / "h")
    parts = [s.where(F.col("session_id") % 3 == k) for k in range(3)]
    for k in (0, 1, 1, 2, 2):                                  # batches 1 and 2 run twice
        history_batch(parts[k], k, path)
    got = spark.read.option("basePath", f"{path}/history").parquet(f"{path}/history")
    per = got.groupBy("athlete_id").agg(F.count("*").alias("n"), F.max("seq").alias("top"), F.count_distinct("seq").alias("k"))
    assert got.count() == s.count() and per.where("n != top OR n != k").count() == 0
    assert len(batches_of(spark, f"{path}/counters")) <= 2
    history_batch(parts[0], 3, path)                           # nothing new
    assert spark.read.option("basePath", f"{path}/history").parquet(f"{path}/history").count() == s.count()


def test_bundle_commits_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from athlos.ml import score
    from athlos.plans.parity import rule_bundle
    bundle = rule_bundle(spark, SF)
    path = str(tmp_path / "b")
    first = score.save_bundle(bundle, path)
    assert score.load_bundle(spark, path).labels == bundle.labels
    broken = rule_bundle(spark, SF)
    broken.comparison = None                                   # fails between the parts

    class Stops:
        sparkSession = spark                                   # noqa: N815

        @property
        def write(self):
            raise OSError("lost")
    broken.comparison = Stops()
    with pytest.raises(OSError):
        score.save_bundle(broken, path)
    again = score.load_bundle(spark, path)
    assert again.labels == bundle.labels and score._manifests(spark, path)[-1].endswith(first)
    bundle.best = "second"
    second = score.save_bundle(bundle, path)
    assert second != first and score.load_bundle(spark, path).best == "second"
    assert score.load_bundle(spark, path, first).best == "rule"          # a pinned version stays


def test_incremental_state_is_the_same_for_any_split(spark):
    r = np.random.default_rng(2)
    rows = [(f"d{i % 7}", f"c{r.integers(0, 300)}", None if i % 9 == 0 else f"e{i % 4}") for i in range(4000)]
    df = spark.createDataFrame(rows, "day string, big string, small string")
    whole = incremental.day_state(df, ["big", "small"], F.lit("all"))
    parts = incremental.merged(*[incremental.day_state(df.where(F.crc32("day") % 3 == k), ["big", "small"], F.col("day")) for k in range(3)])
    for state in (whole, parts):
        est = {x["part"]: x["estimate"] for x in incremental.distinct_estimates(state).collect()}
        assert abs(est["big"] - 300) <= 0.05 * 300 and est["small"] == 4
    assert sorted(map(tuple, incremental.class_sizes(whole, "small").collect())) == sorted(map(tuple, incremental.class_sizes(parts, "small").collect()))
    twice = incremental.merged(parts, whole)
    assert {x["part"]: x["estimate"] for x in incremental.distinct_estimates(twice).collect()} == est
