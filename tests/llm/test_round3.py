"""Byte BPE digests of whole and very long texts, the classifier against plain loops."""

import hashlib
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from athlos.llm import bpe, classifier, common  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as p
    import tiktoken
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(bpe.default_vocabulary()))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(reference, text):
    ids = reference.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_digests_match_the_rank_library(spark, reference):
    common.bound_batches(spark)
    docs = cases.documents(spark)
    r = random.Random(9)
    parts = ["word ", "two  ", "\n", " ", "é漢 ", "12 ", "x", "\t ", "'s ", " tail"]
    long = "".join(r.choices(parts, k=600_000))                          # over two parts of a text
    rows = [(1, long), (2, " " + long[:1_200_000]), (3, "a" * 1_500_000 + " b"), (4, None), (5, " "), (6, "")]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [tuple(x) for x in every.collect()]
    got = sorted(map(tuple, bpe.digests(every, bpe.default_vocabulary()).collect()), key=repr)
    assert got == sorted(((d, *digest(reference, t)) for d, t in texts), key=repr)
    assert bpe.digests(docs.limit(0), bpe.default_vocabulary()).count() == 0


def test_piece_cache_keeps_what_is_met_again(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    enc = bpe.Encoder(bpe.tokenizer_json(bpe.load_ranks(bpe.default_vocabulary())))
    r = random.Random(2)
    for _ in range(40):
        texts = [" ".join(r.choice(["the", "of", f"w{r.randint(0, 400)}"]) for _ in range(12)) for _ in range(3)]
        assert [x.tolist() for x in enc.encode(texts)] == [reference.encode_ordinary(t) for t in texts]
        assert len(enc.young) <= 20 + 40 and len(enc.old) <= 60


def test_classifier_score_matches_plain_loops():
    r = np.random.default_rng(3)
    model = classifier.Model(r.normal(0, 1, 1 << classifier.BUCKETS_LOG2).astype(np.float32), 0.2)
    texts = ["one two two three", "Ünï çode 漢字 漢字", "", None, "a", "spam spam spam"]
    got = model.score(pa.array(texts))
    for t, s in zip(texts, got):
        words = cases.space_words(t)
        units = [w.encode() for w in words] + [classifier.AGAIN for a, b in zip(words, words[1:]) if a == b]
        total = count = 0
        for u in units:
            ids, _ = classifier.word_features([u])
            total += float(model.table[ids].astype(float).sum())
            count += len(ids)
        assert s == pytest.approx(1 / (1 + np.exp(-(total / max(count, 1) + 0.2))), abs=1e-6)


def test_features_of_a_word_are_its_own_hash_and_its_grams():
    ids, off = classifier.word_features([b"cat", "né".encode()])
    marked = ["<cat>", "<né>"]
    for k, m in enumerate(marked):
        grams = [m[i:i + n] for n in classifier.GRAMS for i in range(len(m) - n + 1)]
        assert off[k + 1] - off[k] == 1 + len(grams)
    again, _ = classifier.word_features(["né".encode()])
    assert ids[off[1]:off[2]].tolist() == again.tolist()


def test_one_step_follows_the_numeric_gradient(monkeypatch):
    """A single document for one epoch: the change of the softmax weights is the rate times the loss gradient."""
    monkeypatch.setattr(classifier, "EPOCHS", 1)
    rows = pa.table({"doc_id": [1, 2], "label": pa.array([1, 0], pa.int32()),
                     "words": pa.array([[b"good", b"fine"], [b"bad"]], pa.list_(pa.binary())),
                     "counts": pa.array([[1, 2], [1]], pa.list_(pa.int32()))})
    model = classifier.fit(rows)
    # plain replay of the two steps with float64 and numeric differences
    rng = np.random.default_rng(classifier.SEED)
    v = ((rng.random((1 << classifier.BUCKETS_LOG2, classifier.DIM), dtype=np.float32) - np.float32(0.5)) / np.float32(classifier.DIM)).astype(float)
    soft, bias = np.zeros((2, classifier.DIM)), np.zeros(2)
    data = [([(b"good", 1), (b"fine", 2)], 1), ([(b"bad", 1)], 0)]

    def loss(soft, bias, x, y):
        z = soft @ x + bias
        return -(z[y] - np.log(np.exp(z).sum()))
    for step, k in enumerate(rng.permutation(2)):
        bag, y = data[k]
        ids = np.concatenate([np.repeat(classifier.word_features([w])[0], c) for w, c in bag])
        feature, n = np.unique(ids, return_counts=True)
        weight = n / n.sum()
        x = weight @ v[feature]
        rate = classifier.RATE * (1 - step / 2) * 0.5 / 0.5
        grad, eps = np.zeros_like(soft), 1e-6
        gx = np.zeros(classifier.DIM)
        for i in range(2):
            for j in range(classifier.DIM):
                e = np.zeros_like(soft)
                e[i, j] = eps
                grad[i, j] = (loss(soft + e, bias, x, y) - loss(soft - e, bias, x, y)) / (2 * eps)
        for j in range(classifier.DIM):
            e = np.zeros(classifier.DIM)
            e[j] = eps
            gx[j] = (loss(soft, bias, x + e, y) - loss(soft, bias, x - e, y)) / (2 * eps)
        gb = np.array([(loss(soft, bias + np.eye(2)[i] * eps, x, y) - loss(soft, bias - np.eye(2)[i] * eps, x, y)) / (2 * eps) for i in range(2)])
        soft, bias = soft - rate * grad, bias - rate * 0.1 * gb
        v[feature] -= (rate * weight * min(len(feature), 200))[:, None] * gx
    assert np.allclose(model.table, v @ (soft[1] - soft[0]), atol=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)
