"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and items become sequences of words (lower-cased A-Z; letters, digits and non-ASCII). A pattern is a window of
``WINDOW`` consecutive item words; an item with fewer words is one pattern. Patterns of one length form a table:

* a shift table over blocks of ``BLOCK`` words says how far a search window may jump, so most positions are never
  looked at;
* a block with shift 0 ends some pattern: the hash of that suffix selects the bucket of patterns to test;
* each of them is compared word for word, as bytes.

A batch of texts is cut into overlapping lanes which all jump in lock step, so the jumps are vectorised.

The benchmark is cut into blocks of about ``BLOCK_BYTES`` of item text, dealt by hash. One projection searches all of
them, without a shuffle, and adds their hit word positions per document. So the driver and each Python worker hold the
tables of the whole benchmark; ``BLOCK_BYTES`` bounds neither, only (about) a single broadcast.

Defined cases: null text has no words; items without words match nothing; items with the same text, or repeated
item rows, all count by their ``item_id`` (a null ``item_id`` hits words but adds no name); repeated documents are
judged alone; empty tables give empty or clean results; extra columns are ignored by ``scan`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

WINDOW = 10
BLOCK = 2
LANE = 512
BLOCK_BYTES = 16 << 20


def item_words(text: str | bytes | None) -> list[bytes]:
    raw = np.frombuffer((text.encode("utf-8") if isinstance(text, str) else text) or b"", np.uint8) if text else \
        np.zeros(0, np.uint8)
    low = textkit.LOWER[raw]
    start, end, _ = textkit.words(low, np.array([0, len(low)]), textkit.ALNUM)
    b = low.tobytes()
    return [b[x:y] for x, y in zip(start, end)]


class Table:
    """Patterns of one length ``m``: shift table, suffix buckets, words."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list]):
        self.m, self.block = m, min(BLOCK, m)
        self.words = list(patterns)
        self.items = [sorted(set(patterns[w])) for w in self.words]
        flat = np.frombuffer(b" ".join(x for w in self.words for x in w) + b" ", np.uint8)
        cut = np.flatnonzero(flat == 32)
        start = np.concatenate([[0], cut[:-1] + 1])
        self.hashes = textkit.hash_spans(flat, start, cut).reshape(len(self.words), m)
        # SHIFT: distance of a block's last occurrence in any pattern to the pattern's end
        jump: dict[int, int] = {}
        for k in range(m - self.block + 1):
            dist = m - self.block - k
            for b in self._blocks(self.hashes[:, k:k + self.block]).tolist():
                jump[b] = min(jump.get(b, m), dist)
        self.keys = np.array(sorted(jump), np.uint64)
        self.jumps = np.array([jump[int(k)] for k in self.keys], np.int64)
        self.far = m - self.block + 1
        self.bits = max(16, 3 + int(len(self.keys)).bit_length())
        # hashed SHIFT table: the least jump of all blocks in a cell
        self.shift = np.full(1 << self.bits, self.far, np.int64)
        np.minimum.at(self.shift, (self.keys >> np.uint64(64 - self.bits)).astype(np.int64), self.jumps)
        tails = self._blocks(self.hashes[:, m - self.block:])
        self.order = np.argsort(tails, kind="stable")
        self.tails = tails[self.order]

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint64)
        for k in range(h.shape[1]):
            out = textkit.mix(out ^ h[:, k]) + textkit._M1
        return out

    def search(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of the positions whose suffix bucket and word hashes agree."""
        m, n = self.m, len(h)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = np.arange(0, n - m + 1, LANE)                # lanes of window starts
        at, stop = lead + m - 1, np.minimum(lead + LANE, n - m + 1) + m - 1
        hits, which = [], []
        while len(at):
            tail = self._blocks(np.stack([h[at - self.block + 1 + k] for k in range(self.block)], axis=1))
            jump = self.shift[(tail >> np.uint64(64 - self.bits)).astype(np.int64)]
            maybe = np.flatnonzero(jump == 0)
            if len(maybe):
                lo = np.searchsorted(self.tails, tail[maybe], "left")
                hi = np.searchsorted(self.tails, tail[maybe], "right")
                start = at[maybe] - m + 1
                while True:
                    live = lo < hi
                    if not live.any():
                        break
                    start, lo, hi = start[live], lo[live], hi[live]
                    p = self.order[lo]
                    same = np.ones(len(start), bool)
                    for k in range(m):
                        same &= h[start + k] == self.hashes[p, k]
                    same &= row[start] == row[start + m - 1]
                    hits.append(start[same])
                    which.append(p[same])
                    lo = lo + 1
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(hits), np.concatenate(which)


def tables(items: list[tuple[str | None, bytes]]) -> list[Table]:
    """Pattern tables of (item_id, text) rows, one per pattern length."""
    by: dict[int, dict[tuple[bytes, ...], list]] = {}
    for name, text in items:
        w = item_words(text)
        m = min(WINDOW, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[k:k + m]), []).append("" if name is None else name)
    return [Table(m, p) for m, p in sorted(by.items())]


def occurrences(col: pa.Array, tabs: list[Table]):
    """Per text: (row, number of words, hit word flags, names of the items found)."""
    for first, data, off in textkit.chunks(col):
        low = textkit.LOWER[data]
        start, end, row = textkit.words(low, off, textkit.ALNUM)
        h = textkit.hash_spans(low, start, end)
        mark = np.zeros(len(h) + 1, np.int64)
        names: dict[int, set] = {}
        raw = low.tobytes()
        for t in tabs:
            at, which = t.search(h, row)
            for s, p in zip(at.tolist(), which.tolist()):
                if all(raw[start[s + k]:end[s + k]] == w for k, w in enumerate(t.words[p])):
                    mark[s] += 1
                    mark[s + t.m] -= 1
                    names.setdefault(int(row[s]), set()).update(t.items[p])
        hit = np.cumsum(mark[:-1]) > 0
        at = textkit.rows_of(row, len(off) - 1)
        for i in range(len(off) - 1):
            yield first + i, int(at[i + 1] - at[i]), hit[at[i]:at[i + 1]], names.get(i, ())


def _blocks(benchmark: DataFrame) -> list[int]:
    """Block numbers to search: items are dealt over blocks of about ``BLOCK_BYTES`` by their hash."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return list(range(max(1, -(-2 * int(size) // BLOCK_BYTES)) if size > BLOCK_BYTES else 1))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


_FOUND = "n_words long, hit array<int>, items array<string>"


def _finder(tabs):
    def find(col: pa.Array) -> pa.Array:
        n, hits, names = [], [], []
        for _, count, flags, found in occurrences(col, tabs.value):
            n.append(count)
            hits.append(np.flatnonzero(flags).astype(np.int32).tolist())
            names.append(sorted(x for x in found if x))
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
            names=["n_words", "hit", "items"])
    return F.arrow_udf(find, f"struct<{_FOUND.replace(' long', ':bigint').replace(' array', ':array')}>")


def found_in(docs: DataFrame, benchmark: DataFrame):
    """Column expressions, one per benchmark block: struct(n_words, hit word positions, item ids) of ``text``."""
    sc = docs.sparkSession.sparkContext
    items, blocks = _items(benchmark), _blocks(benchmark)
    out = []
    for k in blocks:
        part = items if len(blocks) == 1 else items.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(len(blocks))) == k)
        tabs = sc.broadcast(tables([(r[0], r[1]) for r in part.collect()]))          # about BLOCK_BYTES of text
        out.append(_finder(tabs)(F.col("text").cast("string")))
    return out


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, hit (positions of hit words), items (sorted item ids)."""
    found = found_in(docs, benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[f.alias(f"f{k}") for k, f in enumerate(found)])
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.array(
        *[F.col(f"f{k}.{c}") for k in range(len(found))]))))
    return rows.select("doc_id", F.col("f0.n_words").alias("n_words"), union("hit").alias("hit"),
                       union("items").alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs."""
    clean = F.lit(True)
    for f in found_in(docs, benchmark):
        clean = clean & (F.size(f["hit"]) == 0)
    return docs.where(clean)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS x FROM documents),
b AS (SELECT item_id, {_WORDS} AS x FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(x), {WINDOW}) AS m, array_to_string(x[i:i + least(len(x), {WINDOW}) - 1], ' ') AS g
      FROM (SELECT item_id, x, unnest(range(1, greatest(len(x) - {WINDOW} + 2, 2))) AS i FROM b WHERE len(x) > 0)),
w AS (SELECT doc_id, m, i, array_to_string(x[i:i + m - 1], ' ') AS g FROM (
        SELECT doc_id, x, m, unnest(range(1, len(x) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(x) >= m)),
h AS (SELECT doc_id, item_id, i, w.m FROM w JOIN p ON w.m = p.m AND w.g = p.g),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(x)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
