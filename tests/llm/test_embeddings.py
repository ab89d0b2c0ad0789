"""Vector codes and whitening against plain versions, on awkward tables."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from athlos.llm import vector_codes, vectors, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, z string, code int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", "b", 1) for i, v, k in rows], SCHEMA).repartition(5)


def good(rows, scale, shift=0):
    size = {}
    kept = []
    for i, v, k in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(scale * c) + shift for c in v], k))
            size[len(v)] = size.get(len(v), 0) + 1
    dims = max(size, key=lambda s: (size[s], s)) if size else 0
    return [r for r in kept if len(r[1]) == dims]


def awkward(n, dims, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(c) for c in r.normal(0, 0.2, dims)], int(r.integers(0, 3)) if i % 5 else None) for i in range(n)]
    rows += [(i, list(rows[7][1]), 1) for i in range(n, n + n // 2)]                    # a third of all rows are copies
    rows += [(3, list(rows[3][1]), None), (3, [0.5] * dims, 2), (None, [0.25] * dims, None), (None, [0.25] * dims, None)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.1] * (dims - 1) + [None], 1), (903, [float("nan")] + [0.1] * (dims - 1), 1),
             (904, [float("inf")] + [0.1] * (dims - 1), 2), (905, [-float("inf")] * dims, 2), (906, [0.5] * (dims + 3), 2)]
    return rows


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(good(rows, 256), key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], np.int32).tobytes()))
    dims = len(rows[0][1])
    width = -(-dims // parts)
    x = [v + [0] * (width * parts - dims) for _, v, _ in rows]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in x]
    book = [[list(r[p]) for r in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(r[p], e)), j) for j, e in enumerate(book[p])) for p in range(parts)] for r in cut]

    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for j in range(len(book[p])):
                mine = [r[p] for r, b in zip(cut, best) if b[p][1] == j]
                if mine:
                    book[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    best = assign()
    sha = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in b) for b in best]
    by = {}
    for (_, _, k), e in zip(rows, error):
        by[k] = by.get(k, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in b), e, by[k], sha) for (i, _, k), b, e in zip(rows, best, error)]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


@pytest.mark.parametrize("n,dims", [(150, 64), (40, 20), (8, 16)])
def test_vector_codes_match_plain_search(spark, n, dims):
    rows = awkward(n, dims)
    got = [tuple(r) for r in vector_codes.compress(table(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(plain_codes(rows), key=key)


def test_vector_codes_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [], None), (3, [float("nan")], 1)]):
        assert vector_codes.compress(table(spark, rows)).collect() == []
        assert whitening.whiten_table(table(spark, rows)).collect() == []


def test_cells_keep_every_nearest_entry_and_ties():
    r = np.random.default_rng(1)
    book = r.integers(-60, 60, (4, 50, 3))
    book[:, 10] = book[:, 40]                                            # equal entries: the lower index wins
    x = r.integers(-80, 80, (500, 4, 3))
    for most in (0, 10, 100_000):
        memo = vector_codes.Memo(book, most=most)
        for _ in range(2):
            code, error = memo.nearest(x)
            d = ((x[:, :, None, :] - book[None]) ** 2).sum(3)
            assert (code == d.argmin(2)).all() and (error == d.min(2)).all()
        assert len(memo.known) <= most
    one = vector_codes.Memo(book)
    one.nearest(x)
    first = one.worked_out
    one.nearest(x)
    assert one.worked_out == first                                       # the second pass comes from the memo
    cells = x.reshape(-1, 3) >> vector_codes.CELL_BITS
    left = vector_codes.survivors(cells, np.tile(np.arange(4), 500), book)
    assert 0 < left.sum() < 0.8 * left.size                              # and dominated entries are not evaluated


def test_vector_codes_sql_on_the_awkward_table(spark):
    rows = awkward(60, 32)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    want = [r[:5] for r in con.sql("SELECT vec_id, code, error, label_error, codebooks_sha256 FROM (" + vector_codes.SQL + ")").fetchall()]
    assert sorted(want, key=key) == sorted(plain_codes(rows), key=key)


@pytest.mark.parametrize("n,dims", [(300, 40), (100, 8)])
def test_whitening_matches_numpy(spark, n, dims):
    rows = awkward(n, dims)
    kept = good(rows, 64, 1_000_000)
    x = np.array([v for _, v, _ in kept], object)
    m, s = len(x), x.sum(0)
    y = ((x * m - s) / m).astype(float)
    v = y.T @ y / m
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = y @ u / np.sqrt(e)
    got = whitening.whiten_table(table(spark, rows)).collect()
    k = min(32, dims)
    assert len(got) == m * k and {r["component"] for r in got} == set(range(1, k + 1))
    assert {r["n"] for r in got} == {m} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    dev = [int(((r * m - s) ** 2).sum()) for r in x]
    by = {}
    for (i, _, _), d, w in zip(kept, dev, z):
        by.setdefault((i, d), []).append(w)
    for c in range(1, k + 1):
        mine = [r for r in got if r["component"] == c]
        assert sorted(((r["vec_id"] is None, r["vec_id"] or 0), r["deviation"]) for r in mine) == sorted(
            (((i is None), i or 0), d) for (i, _, _), d in zip(kept, dev))
        assert max(abs(r["explained"] - e[c - 1] / np.trace(v)) for r in mine) < 1e-9
        sign = np.sign(sum(r["whitened"] * by[(r["vec_id"], r["deviation"])][0][c - 1] for r in mine))
        assert max(abs(r["whitened"] * sign - by[(r["vec_id"], r["deviation"])][0][c - 1]) for r in mine) < 1e-6


def test_whitening_without_variance_and_extremes(spark):
    same = whitening.whiten_table(table(spark, [(i, [0.5, 0.25], 1) for i in range(4)])).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)
    line = whitening.whiten_table(table(spark, [(0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1)])).collect()
    assert sorted(abs(r["whitened"]) for r in line if r["component"] == 1) == pytest.approx([1, 1])
    assert all(r["whitened"] is None for r in line if r["component"] == 2)
    far = whitening.whiten_table(table(spark, [(0, [1e300, 0.0], 1), (1, [-1e300, 1.0], 1), (2, [0.0, 0.0], 1)])).collect()
    assert len(far) == 6 and all(r["deviation"] is not None for r in far)


def test_whitening_weights_of_one(spark):
    rows = [(i, [float(i % 4), float(i % 3)], 1) for i in range(24)] + [(99 + i, [0.0, 0.0], 1) for i in range(50)]
    one = whitening.whiten_table(table(spark, rows), weights="one").collect()
    plain = whitening.whiten_table(table(spark, [(i, [float(i % 4), float(i % 3)], 1) for i in range(12)])).collect()
    assert {r["n"] for r in one} == {12} and len(one) == 2 * len(rows)
    assert sorted({round(r["explained"], 12) for r in one}) == sorted({round(r["explained"], 12) for r in plain})


def test_exact_integers_beyond_a_long():
    x = np.array([[1 << 29, -(1 << 29)]], np.int64)
    w = np.array([1 << 40], np.int64)
    assert [int(v) for v in whitening._dot(w, x)] == [1 << 69, -(1 << 69)]
    y = whitening.centred(x, 1 << 40, [0, 0])
    assert int(y[0, 0]) == 1 << 69 and whitening.deviations(y) == [None]


def test_left_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT_ROWS", 5)
    monkeypatch.setattr(vectors, "HOT_SHARE", 10)
    rows = spark.range(100).select(F.col("id"), F.when(F.col("id") < 60, 1).when(F.col("id") < 90, F.col("id")).alias("k"))
    per = rows.where("k IS NOT NULL AND k != 70").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    got = {r["id"]: r["s"] for r in vectors.left_join(rows, per, "k", "n", 100, "id").collect()}
    assert got == {i: 1770 if i < 60 else (i if i < 90 and i != 70 else None) for i in range(100)}
