"""The string-kernel machine against plain loops, tolerance to gaps, awkward documents, held-out accuracy."""

import os
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from athlos.llm import common, toxicity  # noqa: E402

SF = "/root/testdata/sf0.1"


def plain_map(unit: bytes) -> dict:
    """All three-symbol subsequences within SPAN positions by three nested loops."""
    s = [0] + [int(toxicity.SYMBOL[b]) for b in unit] + [1]
    gap = (toxicity._MARK, toxicity._BLANK)
    out = {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                if not any(s[p] in gap for p in (i, j, k)):
                    t = (s[i], s[j], s[k])
                    out[t] = out.get(t, 0) + toxicity.DECAY ** (k - i - 2)
    size = sum(v * v for v in out.values()) ** 0.5
    return {t: v / size for t, v in out.items()}


def flat(words: list[bytes]):
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    return np.frombuffer(b"".join(words), np.uint8), end - size, end


WORDS = [b"idiot", b"IDIOT", b"idxiot", b"i.d.i.o.t", b"aaaaaaa", b"ab", b"a", "réeuxment".encode(), b"nation", b"...", b"x" * 24]


def test_kernel_matches_nested_loops():
    data, start, end = flat(WORDS)
    maps = toxicity.feature_map(*toxicity.symbols(data, start, end))
    got = toxicity.kernel(maps, len(WORDS), maps, len(WORDS))
    plain = [plain_map(w) for w in WORDS]
    want = np.array([[sum(v * b.get(t, 0) for t, v in a.items()) for b in plain] for a in plain])
    assert np.allclose(got, want)
    assert got[0, 1] == pytest.approx(1) and got[0, 3] > 0.8 > got[0, 2] > 0.3 > got[0, 8]


def test_decisions_match_plain_products():
    r = np.random.default_rng(5)
    data, start, end = flat(WORDS)
    for bias in (-0.3, 0.0, 0.4):
        m = toxicity.Machine(r.normal(0, 0.3, toxicity.TRIPLES).astype(np.float32), bias)
        want = [max(0.0, sum(v * float(m.v[(a << 12) | (b << 6) | c]) for (a, b, c), v in plain_map(w).items()) + bias) for w in WORDS]
        assert np.allclose(m.decide(data, start, end), want, atol=1e-5)


def units_of(text: str) -> list[str]:
    out = []
    for _, data, off in toxicity.pieces(pa.array([text])):
        start, end, _ = toxicity.spans(data, off)
        out += [data[a:b].tobytes().decode("utf8", "replace") for a, b in zip(start, end)]
    return out


def test_units():
    assert units_of("You, (idiot)! i d i o t or i-d-i-o-t.\n\n ... é") == ["You", "idiot", "i d i o t", "or", "i-d-i-o-t", ".", "é"]
    long = units_of("a" * 60)
    assert [len(u) for u in long] == [24, 24, 24, 24] and units_of("") == [] and units_of(" \n\t") == []


def test_newton_machine_finds_the_least_loss():
    r = np.random.default_rng(2)
    x, y = r.normal(0, 1, (200, 5)), np.where(r.random(200) < 0.3, 1.0, -1.0)
    x[:, 0] += y
    weight = r.random(200)
    w = toxicity.newton_svm(x, y, weight, 0.7)

    def loss(w):
        return 0.5 * (w[:-1] ** 2).sum() + 0.5e-6 * w[-1] ** 2 + 0.7 * sum(
            c * max(0.0, 1 - t * (float(a @ w[:-1]) + w[-1])) ** 2 for a, t, c in zip(x, y, weight))

    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-3


def test_long_texts_are_scored_in_pieces(monkeypatch):
    model = toxicity.fit(pa.array(["you idiot. go on", "a fine day", "such an idiot", "nice words here"] * 3), np.array([1, 0, 1, 0] * 3), 0.5)
    text = ("a fine day " * 30_000 + "you idiot ") * 2
    whole = model.features(pa.array([text]))
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 5000)
    assert np.allclose(model.features(pa.array([text])), whole)
    pieces = [(len(d), o[-1]) for _, d, o in toxicity.pieces(pa.array([text, "", "x" * 12_345, None, "last"]))]
    assert max(a for a, _ in pieces) <= 5000 and sum(a for a, _ in pieces) == len(text) + 12_345 + 4


def test_twenty_megabytes_in_bounded_memory():
    import tracemalloc
    model = toxicity.fit(pa.array(["you idiot", "a fine day"] * 4), np.array([1, 0] * 4), 0.5)
    text = pa.array(["it was a fine day and then " * 780_000 + " idiot"])
    tracemalloc.start()
    got = model.score(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1 and peak < 250e6


def test_awkward_documents_and_labels(spark):
    docs = cases.documents(spark)
    ids = [r[0] for r in docs.select("doc_id").distinct().collect() if r[0] is not None]
    labels = spark.createDataFrame([(i, None, i % 3) for i in ids] + [(ids[0], 1, None), (None, 1, 1), (ids[1], 0, 1), (ids[1], 0, 0)],
                                   "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    common.bound_batches(spark)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.0]
    one = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).select("score").distinct().collect()
    assert [r[0] for r in one] == [1.0]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).collect() == []


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = common.read(spark, SF, "documents").where("doc_id < 2500")
    labels = common.read(spark, SF, "labels").where("doc_id < 2500")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert np.array_equal(a.machine.v, b.machine.v) and np.array_equal(a.head, b.head)


def test_held_out_accuracy_and_gapped_insults(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] == r["toxic"] == 1 for r in got)
    assert hit >= 0.93 * sum(r["toxic"] == 1 for r in got)
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in got) <= 0.01 * len(got)
    word = "idiot"
    said = [word, word.upper(), "i.d.i.o.t", "i d i o t", "id-iot", "*idiot*", "idiots", "the", "nation", "happy"]
    scores = model.score(pa.array([f"Of the {w} and the {w}." for w in said]))
    assert (scores[:7] >= 0.3).all() and (scores[7:] < 0.1).all()
