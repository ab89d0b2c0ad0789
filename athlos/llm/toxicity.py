"""Toxicity by a support vector machine over a gap-tolerant subsequence string kernel with Nyström landmarks.

Kernel. A unit (a word between marks for its two ends, or a run of single characters such as ``i d i o t``) is mapped to
all its subsequences of three symbols that lie within ``SPAN`` positions; each occurrence weighs ``DECAY`` to the number
of skipped symbols. Blanks and punctuation take up a position but are never part of a subsequence. The kernel of two units is the inner product of the maps over the product of their lengths, so
``idxiot``, ``i.d.i.o.t`` and ``IDIOT`` stay close to ``idiot``.

Training. Labelled documents are cut into sentences. A sentence stands for its highest-scoring unit; all sentences of
documents without toxicity are negative, the highest sentences of a toxic document positive, and the choice is repeated
with each fitted machine. A unit enters the machine by its kernel values with ``LANDMARKS`` landmark units under the
inverse root of their Gram matrix (Nyström), the machine is a squared-hinge one fitted by Newton steps in numpy. Its
decision is folded into one number per triple of symbols. A logistic head turns a document's sums of positive decisions
into a score. The fit sees at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, of texts up to ``SAMPLE_BYTES``, none of
them held out. Scoring reads whole texts, in pieces of about one megabyte cut at white space.

Defined cases: a null or empty text scores as one without any unit; a null ``doc_id`` is not held out and has no label;
of rows that share a doc_id each trains with each of its labels; labels other than 0 and 1 are ignored; with one class or
none every score is the share of toxic labels (0.0 without any); an empty table gives no rows; extra columns are
ignored. ``lang``, ``source``, ``doc_id`` and labels are no features. A run of over ``PIECE_BYTES`` bytes without white
space is cut there; a unit of over ``UNIT_BYTES`` bytes counts as overlapping windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

TOXIC_ROWS, CLEAN_ROWS = 3000, 6000     # labelled rows of the fit, at most
SAMPLE_BYTES = 1 << 15                  # rows with longer texts are not among them
LANDMARKS = 128
ROUNDS = 4
BEST = 3                                # sentences of a toxic document taken as positive, at most
SPAN, DECAY = 7, 0.6
UNIT_BYTES, UNIT_STEP = 24, 12
PIECE_BYTES = 1 << 20
COST = 1.0
SEED = 11
CUTOFF = 0.3

_BITS = 6                               # symbols of six bits: ends, letters, digits, blanks, marks, bytes beyond ASCII
_LEFT, _RIGHT, _DIGIT, _BLANK, _MARK, _HIGH = 0, 1, 28, 29, 30, 31
SYMBOL = np.full(256, _MARK, np.int32)
SYMBOL[[0x20, *range(0x09, 0x0E)]] = _BLANK
SYMBOL[0x30:0x3A] = _DIGIT
for _first in (0x41, 0x61):
    SYMBOL[_first:_first + 26] = np.arange(2, 28)
SYMBOL[0x80:0xC0] = _HIGH + (np.arange(64) & 31)        # capitals of Latin-1 fall on their small letters
SYMBOL[0xC0:] = 63
_LOOSE = (SYMBOL == _MARK) | (SYMBOL == _BLANK)         # stripped from both ends of a word
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
TRIPLES = 1 << (3 * _BITS)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 4 == 2, F.lit(False))


def pieces(col: pa.Array):
    """Groups of (row of each piece, bytes, offsets); a group has about PIECE_BYTES, a longer text is cut at white space."""
    data, off = textkit.flat(col)
    row, edge = [], [0]
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        while b - a > PIECE_BYTES:
            blank = np.flatnonzero(textkit.SPACE[data[a + PIECE_BYTES // 2:a + PIECE_BYTES]])
            a += PIECE_BYTES // 2 + int(blank[-1]) + 1 if len(blank) else PIECE_BYTES
            row.append(k)
            edge.append(a)
        row.append(k)
        edge.append(b)
    row, edge = np.array(row, np.int64), np.array(edge, np.int64)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + PIECE_BYTES, "right")) - 1)
        yield row[a:b], data[edge[a]:edge[b]], edge[a:b + 1] - edge[a]
        a = b


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of the units: stripped words, runs of single characters, windows of long ones."""
    start, end, row = textkit.words(data, off, textkit.SPACE)
    for _ in range(8):                                                   # strip marks; more than eight stay as symbols
        loose = (end - start > 1) & _LOOSE[data[start]] if len(start) else np.zeros(0, bool)
        start = start + loose
        tail = (end - start > 1) & _LOOSE[data[end - 1]] if len(start) else loose
        end = end - tail
        if not loose.any() and not tail.any():
            break
    if not len(start):
        return start, end, row
    one = end - start == 1
    joined = np.zeros(len(start), bool)
    joined[1:] = one[1:] & one[:-1] & (row[1:] == row[:-1]) & (start[1:] - end[:-1] <= 3)
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(start)) - 1
    start, end, row = start[first], end[last], row[first]
    long = end - start > UNIT_BYTES
    if long.any():
        n = np.where(long, -(-(end - start - UNIT_BYTES) // UNIT_STEP) + 1, 1)
        at = np.repeat(np.arange(len(start)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = start[at] + nth * UNIT_STEP
        end, row = np.minimum(np.where(long[at], start + UNIT_BYTES, end[at]), end[at]), row[at]
    return start, end, row


def units(data: np.ndarray, off: np.ndarray):
    """(start and end of distinct units, unit of each occurrence, piece of each occurrence, where it begins)."""
    start, end, row = spans(data, off)
    _, at, which = np.unique(textkit.hash_spans(textkit.LOWER[data], start, end), return_index=True, return_inverse=True)
    return start[at], end[at], which, row, start


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all units with end marks, offsets)."""
    n = end - start + 2
    off = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(off[-1], np.int32)
    unit = np.repeat(np.arange(len(n)), n)
    at = np.arange(off[-1]) - off[unit] - 1 + start[unit]
    out[:] = SYMBOL[data[np.clip(at, 0, max(len(data) - 1, 0))]] if len(data) else 0
    out[off[:-1]], out[off[1:] - 1] = _LEFT, _RIGHT
    return out, off


def triples(sym: np.ndarray, off: np.ndarray):
    """(first position, triple id, weight) of every occurrence, one pair of gaps after the other."""
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(sym))        # symbols to the end of the unit
    gap = (sym == _MARK) | (sym == _BLANK)
    any_gap = gap.any()
    for a, b in GAPS:
        at = np.flatnonzero(left > a + b)
        if any_gap:
            at = at[~(gap[at] | gap[at + a] | gap[at + a + b])]
        yield at, (sym[at] << 2 * _BITS) | (sym[at + a] << _BITS) | sym[at + a + b], DECAY ** (a + b - 2)


def feature_map(sym: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, triple, value) of the map of every unit, scaled to length one."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key, value = [np.zeros(0, np.int64)], [np.zeros(0)]
    for at, t, w in triples(sym, off):
        key.append(owner[at] * TRIPLES + t)
        value.append(np.full(len(at), w))
    key, which = np.unique(np.concatenate(key), return_inverse=True)
    total = np.bincount(which, np.concatenate(value), len(key))
    unit = key // TRIPLES
    size = np.sqrt(np.bincount(unit, total * total, len(off) - 1))
    return unit, key % TRIPLES, total / size[unit]


@dataclass
class Machine:
    """Decision of a unit: <v, map> + bias; unit of length one in the space of triples."""

    v: np.ndarray
    bias: float

    def decide(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """max(0, decision) of each unit. The length of a map is at least that of its occurrences without repeats, so
        a unit that is not positive under that length needs no exact one."""
        sym, off = symbols(data, start, end)
        total, least = np.zeros(len(sym)), np.zeros(len(sym))
        for at, t, w in triples(sym, off):
            total[at] += w * self.v[t]
            least[at] += w * w
        if not len(start):
            return np.zeros(0)
        total, least = np.add.reduceat(total, off[:-1]), np.sqrt(np.add.reduceat(least, off[:-1]))
        out = np.zeros(len(start))
        maybe = np.flatnonzero((total + self.bias * least > 0) | (self.bias > 0)) if self.bias <= 0 else np.arange(len(start))
        if len(maybe):
            unit, t, value = feature_map(*symbols(data, start[maybe], end[maybe]))
            out[maybe] = np.maximum(np.bincount(unit, value * self.v[t], len(maybe)) + self.bias, 0)
        return out


FEATURES = 4


def gathered(decision: np.ndarray, which: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per piece: greatest decision, their sum, their number, units; pieces of one text add up (the first by maximum)."""
    out = np.zeros((n, FEATURES))
    hit = np.flatnonzero(decision[which] > 0)
    value = decision[which[hit]]
    np.maximum.at(out[:, 0], row[hit], value)
    out[:, 1] = np.bincount(row[hit], value, n)
    out[:, 2] = np.bincount(row[hit], minlength=n)
    out[:, 3] = np.bincount(row, minlength=n)
    return out


def shaped(f: np.ndarray) -> np.ndarray:
    """Inputs of the logistic head."""
    rate = f[:, 1] / np.maximum(f[:, 3], 1)
    return np.column_stack([np.minimum(f[:, 0], 1.5), np.log1p(f[:, 1]), np.log1p(f[:, 2]), np.log1p(100 * rate)])


@dataclass
class Model:
    """Machine, and the weights of the logistic head (constant last)."""

    machine: Machine | None
    head: np.ndarray

    def features(self, col: pa.Array) -> np.ndarray:
        out = np.zeros((len(col), FEATURES))
        for rows, data, off in pieces(col):
            start, end, which, row, _ = units(data, off)
            f = gathered(self.machine.decide(data, start, end), which, row, len(rows))
            np.maximum.at(out[:, 0], rows, f[:, 0])
            for k in range(1, FEATURES):
                out[:, k] += np.bincount(rows, f[:, k], len(col))
        return out

    def score(self, col: pa.Array) -> np.ndarray:
        if self.machine is None:
            return np.full(len(col), self.head[-1])
        return _sigmoid(np.column_stack([shaped(self.features(col)), np.ones(len(col))]) @ self.head)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = COST, steps: int = 50) -> np.ndarray:
    """Weights (bias last) that minimise |w|^2 / 2 + cost * sum(weight * max(0, 1 - y (wx + b))^2); y is -1 or 1."""
    x = np.column_stack([x, np.ones(len(x))])
    keep = np.ones(x.shape[1])
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: 0.5 * (keep * w * w).sum() + cost * (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum()
    now = loss(w)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa, ca = x[on], cost * weight[on]
        gradient = keep * w - 2 * (xa * (ca * y[on] * slack[on])[:, None]).sum(0)
        if np.abs(gradient).max() < 1e-7 * max(1.0, cost * weight.sum()):
            break
        step = np.linalg.solve(np.diag(keep) + 2 * (xa * ca[:, None]).T @ xa, gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        before, now = now, loss(w)
        if before - now <= 1e-10 * before:
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Newton's logistic regression, constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(x.shape[1]),
                               x.T @ (weight * (p - y)) + ridge * len(x) * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Bags:
    """Units and sentences of the sampled documents."""

    def __init__(self, texts: pa.Array):
        parts, first = [], 0
        words: dict[bytes, int] = {}
        for rows, data, off in pieces(texts):
            start, end, which, row, at = units(data, off)
            low = textkit.LOWER[data].tobytes()
            ids = np.array([words.setdefault(low[a:b], len(words)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
            stop = np.cumsum(_STOP[data])
            sentence = stop[at] + first if len(at) else at
            first += (int(stop[-1]) if len(stop) else 0) + 1
            parts.append((rows[row].astype(np.int32), sentence.astype(np.int32), ids[which].astype(np.int32)))
        doc, sentence, unit = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int32)]) for k in range(3))
        del parts
        # a sentence belongs to one document: the pair names it, and it begins where either changes
        new = np.concatenate([[True], (np.diff(sentence) != 0) | (np.diff(doc) != 0)]) if len(doc) else np.zeros(0, bool)
        self.sentence = np.cumsum(new, dtype=np.int32)
        self.doc, self.unit, self.words = doc, unit, list(words)
        self.data = np.frombuffer(b"".join(self.words), np.uint8)
        size = np.array([len(w) for w in self.words], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.documents = len(texts)

    def maps(self, of: np.ndarray):
        return feature_map(*symbols(self.data, self.start[of], self.end[of]))

    def best_units(self, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, unit): of each document's ``most`` highest sentences the unit that scores highest."""
        if not len(self.unit):
            return self.doc, self.unit
        at = np.flatnonzero(np.diff(self.sentence, prepend=0))           # sentences lie one after the other
        v = value.astype(np.float32)[self.unit]
        top = np.maximum.reduceat(v, at)
        unit = np.minimum.reduceat(np.where(v == top[self.sentence - 1], self.unit, len(value)), at)
        order = np.lexsort([unit, -top, self.doc[at]])
        doc, unit = self.doc[at][order], unit[order]
        fresh = np.concatenate([[True], np.diff(doc) > 0])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))
        keep = np.arange(len(doc)) - start < most
        return doc[keep], unit[keep]


def kernel(a: tuple, n: int, b: tuple, m: int) -> np.ndarray:
    """Kernel matrix of n units (map a) with m units (map b)."""
    seen, column = np.unique(b[1], return_inverse=True)
    table = np.zeros((len(seen), m))
    table[column, b[0]] = b[2]
    at = np.searchsorted(seen, a[1])
    hit = np.flatnonzero(seen[np.minimum(at, len(seen) - 1)] == a[1])
    out = np.zeros((n, m))
    step = 1 << 14
    for k in range(0, len(hit), step):
        h = hit[k:k + step]
        part = table[at[h]] * a[2][h][:, None]
        cut = np.flatnonzero(np.concatenate([[True], np.diff(a[0][h]) > 0]))
        out[a[0][h][cut]] += np.add.reduceat(part, cut, axis=0)
    return out


def landmarks(bags: Bags, odds: np.ndarray, common_first: np.ndarray, most: int = LANDMARKS) -> np.ndarray:
    """Three quarters of the landmarks mark toxic documents most, the rest are the commonest units."""
    marked = np.argsort(-odds, kind="stable")[:most * 3 // 4]
    rest = common_first[~np.isin(common_first, marked)][:most - len(marked)]
    return np.concatenate([marked, rest])


def fit(texts: pa.Array, label: np.ndarray, share: float) -> Model:
    """``share`` is the toxic share of all labelled rows that may train; the sample is weighted back to it."""
    if len(np.unique(label)) < 2:
        return Model(None, np.array([share]))
    bags = Bags(texts)
    n = len(bags.words)
    if n < 2:
        return Model(None, np.array([share]))
    pair = np.unique(bags.doc.astype(np.int64) * n + bags.unit)
    toxic = np.bincount(pair % n, label[pair // n] == 1, n)
    clean = np.bincount(pair % n, label[pair // n] == 0, n)
    odds = np.sqrt(toxic) * np.log((toxic + 0.1) / ((label == 1).sum() + 1) * ((label == 0).sum() + 1) / (clean + 0.1))
    odds[toxic == 0] = -1.0
    marks = landmarks(bags, odds, np.argsort(-(toxic + clean), kind="stable"))
    at = bags.maps(marks)
    gram = kernel(at, len(marks), at, len(marks))
    values, vectors = np.linalg.eigh(gram)
    root = (vectors[:, values > 1e-8] / np.sqrt(values[values > 1e-8])) @ vectors[:, values > 1e-8].T
    machine, value, negative = None, odds, np.zeros(0, np.int64)
    for k in range(ROUNDS):
        doc, unit = bags.best_units(value, BEST)
        up = label[doc] == 1
        top = np.concatenate([[True], np.diff(doc) > 0])                 # a toxic document's first, others if positive
        positive = unit[up & (top | (value[unit] > 0))]
        negative = np.unique(np.concatenate([negative, unit[~up]]))
        ids, times = np.unique(positive, return_counts=True)
        pool = np.concatenate([ids, negative])
        x = kernel(bags.maps(pool), len(pool), at, len(marks)) @ root
        y = np.concatenate([np.ones(len(ids)), -np.ones(len(negative))])
        weight = np.concatenate([times / times.sum(), np.maximum(clean[negative], 1) / np.maximum(clean[negative], 1).sum()])
        w = newton_svm(x, y, weight * len(label), COST)
        beta = root @ w[:-1]
        v = np.zeros(TRIPLES)
        np.add.at(v, at[1], at[2] * beta[at[0]])
        machine = Machine(v.astype(np.float32), float(w[-1]))
        value = np.concatenate([machine.decide(bags.data, bags.start[a:a + 20_000], bags.end[a:a + 20_000])
                                for a in range(0, n, 20_000)])
    f = gathered(value, bags.unit, bags.doc, bags.documents)
    weight = np.where(label == 1, share / (label == 1).mean(), (1 - share) / (label == 0).mean())
    return Model(machine, logistic(shaped(f), label, weight))


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> tuple[DataFrame, float]:
    """((doc_id, label, text) of the rows of the fit, toxic share of all rows that might be)."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    share = lab.agg(F.avg("label")).first()[0]
    picked = [lab.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n) for k, n in enumerate(rows)]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.where(F.octet_length("text") <= SAMPLE_BYTES)
    return text.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "label", "text"), share or 0.0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: tuple[int, int] = (CLEAN_ROWS, TOXIC_ROWS)) -> Model:
    picked, share = sample(docs, labels, label, rows)
    found = picked.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])   # bounded, one order on every run
    return fit(found.column("text").combine_chunks() if found.num_rows else pa.array([], pa.string()),
               found.column("label").to_numpy(), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)             # one number per triple of symbols: 1 MB
    udf = F.arrow_udf(lambda col: pa.array(shared.value.score(col)), "double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       udf(F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= CUTOFF).cast("int"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
