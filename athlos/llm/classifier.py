"""Quality classifier: supervised subword embeddings trained with numpy stochastic gradient descent.

A document is the average of learned vectors of its features: each word occurrence counts for the hashed word and for
the hashed character n-grams (3 to 5 characters, with word boundaries) of the word, and a word that repeats the one
before it also for a pseudo-word. A softmax over the average gives
the class. Training runs on a bounded sample of labelled documents (``SAMPLE_ROWS`` rows with the smallest seeded
hashes, of texts up to ``SAMPLE_BYTES``, each reduced to its distinct words and counts on the executors). Scoring folds the vectors and the softmax
weights of the two classes into one number per hash bucket, so each task loads one small table and scores whole texts.

Defined cases: null or empty text scores the bias alone; a null ``doc_id`` is not held out and has no label; documents
labelled more than once train with each label (of rows that share a doc_id, the smallest text); null labels are ignored; without any label every score is 0.5; an empty
table gives an empty result; extra columns are ignored. ``lang``, ``source``, ``doc_id`` and labels are no features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

SAMPLE_ROWS = 6000          # labelled documents the model is fitted on, at most
SAMPLE_BYTES = 1 << 17      # rows with longer texts are not in the sample; the rows in it send all their words
BUCKETS_LOG2 = 17
DIM = 16
GRAMS = (3, 4, 5)
EPOCHS = 4
RATE = 0.4
SEED = 7
CUTOFF = 0.7
AGAIN = b" again"           # pseudo-word of a word that repeats the one before it; no word holds a space


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, offsets): the word's own bucket and those of its character n-grams, word after word."""
    marked = [b"<" + w + b">" for w in words]
    data = np.frombuffer(b"".join(marked), np.uint8)
    size = np.array([len(m) for m in marked], np.int64)
    end = np.cumsum(size)
    start = end - size
    shift = np.uint64(64 - BUCKETS_LOG2)
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.append(chars, len(data))
    row = np.searchsorted(end, chars, "right")
    ids, rows = [textkit.hash_spans(data, start, end)], [np.arange(len(words))]
    for n in GRAMS:
        if len(chars) >= n:
            at = np.arange(len(chars) - n + 1)
            at = at[row[at] == row[at + n - 1]]
            ids.append(textkit.mix(textkit.hash_spans(data, edge[at], edge[at + n]) + textkit._M1))
            rows.append(row[at])
    ids, rows = np.concatenate(ids) >> shift, np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return ids[order].astype(np.int32), np.searchsorted(rows[order], np.arange(len(words) + 1))


def bags(col: pa.Array):
    """Per chunk: (first row, rows, distinct words, word of each occurrence, row of each occurrence)."""
    for first, data, off in textkit.chunks(col):
        start, end, row = textkit.words(data, off, textkit.SPACE)
        _, at, which = np.unique(textkit.hash_spans(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        again = row[1:][(which[1:] == which[:-1]) & (row[1:] == row[:-1])]
        yield (first, len(off) - 1, [raw[start[i]:end[i]] for i in at] + [AGAIN],
               np.append(which, np.full(len(again), len(at))), np.append(row, again))


@dataclass
class Model:
    """Score of a document: sigmoid(mean of ``table`` over its features + ``bias``)."""

    table: np.ndarray
    bias: float

    def score(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col))
        for first, n, words, which, row in bags(col):
            total, count = np.zeros(n), np.zeros(n)
            if len(words):
                ids, off = word_features(words)
                value = np.add.reduceat(self.table[ids], off[:-1])
                size = np.diff(off)
                total = np.bincount(row, value[which], n)
                count = np.bincount(row, size[which], n)
            out[first:first + n] = 1 / (1 + np.exp(-(total / np.maximum(count, 1) + self.bias)))
        return out


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, words array<binary>, counts array<int>) of the sampled labelled documents outside the held-out fold."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    lab = lab.orderBy(F.xxhash64(F.lit(SEED), "doc_id", "label"), "doc_id", "label").limit(rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.where(F.col("text").isNull() | (F.octet_length("text") <= SAMPLE_BYTES))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                words, counts = _bag_of(b.column("text").slice(i, 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, 1), b.column("label").slice(i, 1), pa.array([words], pa.list_(pa.binary())),
                     pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "label", "words", "counts"])

    # the sample is the bounded side; texts are hashed past it, never sorted
    return (text.join(F.broadcast(lab), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
            .mapInArrow(run, "doc_id long, label int, words array<binary>, counts array<int>"))


def _bag_of(col: pa.Array) -> tuple[list[bytes], list[int]]:
    for _, _, words, which, _ in bags(col):
        count = np.bincount(which, minlength=len(words))
        top = np.flatnonzero(count)
        return [words[i] for i in top], count[top].tolist()
    return [], []


def _vocabulary_features(vocab: pa.Array, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``word_features`` of many words, a slice at a time."""
    ids, size = [], []
    for a in range(0, len(vocab), step):
        f, off = word_features(vocab.slice(a, step).to_pylist())
        ids.append(f)
        size.append(np.diff(off))
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(size))])


def fit(rows: pa.Table) -> Model:
    """Stochastic gradient descent on the softmax loss, one document at a time, classes weighted to equal mass.

    The sample stays in Arrow and numpy arrays; a document's features are laid out when its turn comes.
    """
    label = rows.column("label").to_numpy()
    if len(np.unique(label)) < 2:
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0)
    words = rows.column("words").combine_chunks()
    counts = rows.column("counts").combine_chunks()
    edge = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
    coded = words.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    which, count = coded.indices.to_numpy(), counts.flatten().to_numpy().astype(np.float32)
    if not len(which):
        return Model(np.zeros(1 << BUCKETS_LOG2, np.float32), 0.0)
    ids, off = _vocabulary_features(coded.dictionary)
    size = np.diff(off)
    rng = np.random.default_rng(SEED)
    vectors = (rng.random((1 << BUCKETS_LOG2, DIM), dtype=np.float32) - np.float32(0.5)) / np.float32(DIM)
    soft, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    mass = np.bincount(label, minlength=2) / len(label)
    steps, done = EPOCHS * len(label), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(label)):
            y, w, c = int(label[k]), which[edge[k]:edge[k + 1]], count[edge[k]:edge[k + 1]]
            n = size[w]
            at = np.repeat(off[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
            feature, inverse = np.unique(ids[at], return_inverse=True)
            weight = np.bincount(inverse, np.repeat(c, n), len(feature)).astype(np.float32)
            weight /= max(weight.sum(), 1)
            rate = np.float32(RATE * (1 - done / steps) * 0.5 / mass[y])
            done += 1
            x = weight @ vectors[feature]
            z = soft @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = soft.T @ p
            soft -= rate * np.outer(p, x)
            bias -= rate * np.float32(0.1) * p
            # an average spreads one step over the document's features; rescale it to reach them
            vectors[feature] -= (rate * weight * min(len(feature), 200))[:, None] * step
    return Model((vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    found = sample(docs, labels, label, rows).toArrow()                  # at most ``rows`` word lists
    return fit(found.sort_by([("doc_id", "ascending"), ("label", "ascending")]))       # the same order on every run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)             # one number per bucket
    udf = F.arrow_udf(lambda col: pa.array(shared.value.score(col)), "double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       udf(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUTOFF).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
