"""Bracketed selection: exact order statistics in two scans, whatever the values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from athlos.operators import clean, stats

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def columns():
    r = np.random.default_rng(8)
    n = 5000
    return {
        "normal": r.normal(0, 1, n), "ties": np.where(r.random(n) < 0.6, 3.0, r.integers(0, 9, n)).astype(float),
        "constant": np.full(n, 7.5), "skewed": np.exp(r.normal(0, 40, n)), "narrow": 1e9 + r.random(n) * 1e-3,
        "extreme": np.concatenate([[np.inf] * 40, [-np.inf] * 1300, r.normal(0, 1, n - 1340)]),
        "missing": np.where(r.random(n) < 0.5, np.nan, r.normal(0, 1, n)), "empty": np.full(n, np.nan),
    }


def expected(v):
    v = np.sort(v[~np.isnan(v)])
    if not len(v):
        return (None,) * len(PROBS)
    out = []
    for p in PROBS:
        h = p * (len(v) - 1)
        a, b = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
        out.append(a if a == b or h == int(h) else (1 - (h - int(h))) * a + (h - int(h)) * b)
    return tuple(out)


@pytest.fixture(scope="module")
def table(spark):
    data = columns()
    return spark.createDataFrame(list(zip(*[[float(x) for x in v] for v in data.values()])), ", ".join(f"{c} double" for c in data)).repartition(6)


@pytest.mark.parametrize("accuracy,listed", [(10_000, 1_000_000), (50, 1_000_000), (100, 10), (20, 0)])
def test_all_quantiles_are_exact(spark, table, monkeypatch, accuracy, listed):
    monkeypatch.setattr(stats, "BAND_ACCURACY", accuracy)
    monkeypatch.setattr(stats, "BAND_VALUES", listed)
    got = stats.exact_select(table, table.columns, PROBS)
    for c, v in columns().items():
        want = expected(v)
        assert got[c] == want if want[0] is None else np.array_equal(np.array(got[c]), np.array(want)) or got[c] == pytest.approx(want, rel=1e-15, abs=0), c


def test_two_scans_settle_every_rank(table, monkeypatch):
    scans = []
    real = stats._bracketed
    monkeypatch.setattr(stats, "_bracketed", lambda base, specs: scans.append(len(specs)) or real(base, specs))
    stats.exact_select(table, table.columns, (0.25, 0.5, 0.75))
    assert len(scans) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11])
def test_few_rows(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
    assert stats.exact_select(df, ["x"], PROBS)["x"] == expected(np.arange(n, dtype=float) ** 2)


def test_fused_chain_equals_the_steps(spark):
    r = np.random.default_rng(1)
    rows = [tuple(None if r.random() < 0.25 else float(v) for v in np.exp(r.normal(0, 2, 5))) for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(5)))
    for nums in (df.columns, ["c0", "c3"]):
        fused = clean.clip_filter_impute(df, nums)
        steps = clean.median_impute(clean.sparse_row_filter(clean.iqr_clip(df, nums)), nums)
        a, b = (sorted(map(tuple, x.select([F.coalesce(c, F.lit(-1.0)) for c in df.columns]).collect())) for x in (fused, steps))
        assert len(a) == len(b) < 400
        assert all(math.isclose(p, q, rel_tol=1e-12) for x, y in zip(a, b) for p, q in zip(x, y))


def test_modes_of_mixed_types_in_one_count(spark):
    df = spark.createDataFrame([("b", 2, None, "x"), ("a", 10, None, "x"), ("a", 2, None, None), ("b", 10, None, "y"), (None, None, None, "y")],
                               "s string, n int, e string, t string")
    assert stats.modes(df, ["s", "n", "e", "t"]) == {"s": "a", "n": 2, "e": None, "t": "x"}
    assert stats.modes(df.limit(0), ["s", "n"]) == {"s": None, "n": None}
