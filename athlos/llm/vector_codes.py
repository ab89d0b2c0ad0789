"""Vector code compression: product codes whose nearest-entry search is memoised by grid cell.

Each part of a vector falls into a coarse cell of the integer grid (``CELL_BITS`` low bits dropped per component). For
the cell's box every codebook entry has a least and a greatest squared distance; an entry whose least exceeds the
smallest greatest of all entries is nearest to no point of the box. What remains is cached under the cell, and only
those entries are evaluated exactly. All arithmetic is on integers, so the result does not depend on the partitioning,
and equals a search over all entries. The cache lives in one task and stops growing at ``MEMO_CELLS`` cells; cells
beyond that are worked out again.

Defined cases: rows whose vector is null, empty or holds a null or non-finite component go, and so do rows whose length
is not the most frequent one (the longest of equally frequent ones). floor(256 * c) stays within +-2^24. A length that
16 does not divide is filled up with zeros. Fewer than 64 rows make a smaller codebook; the first entries come in order
of (vec_id, vector), null ids last. Repeated rows stay; ``label_error`` takes null labels together. Other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit, vectors

SCALE, MOST = 256, 1 << 24
PARTS, ENTRIES, ROUNDS = 16, 64, 2
CELL_BITS = 4
MEMO_CELLS = 200_000
PAIR_NUMBERS = 1 << 20      # integers of the exact evaluations that one step holds


def survivors(cells: np.ndarray, parts: np.ndarray, book: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Which entries (columns) may be nearest to some point of each cell's box (rows); equal distances survive."""
    lo = (cells << bits)[:, None, :]
    hi = lo + (1 << bits) - 1
    entry = book[parts]
    near = np.maximum(np.maximum(lo - entry, entry - hi), 0)
    far = np.maximum(np.abs(entry - lo), np.abs(entry - hi))
    near, far = (near * near).sum(2), (far * far).sum(2)
    return near <= far.min(1)[:, None]


class Memo:
    """Surviving entries of the cells met so far, packed to bits, for one codebook."""

    def __init__(self, book: np.ndarray, bits: int = CELL_BITS, most: int = MEMO_CELLS):
        self.book, self.bits, self.most, self.known, self.worked_out = book, bits, most, {}, 0

    def of(self, cells: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Packed survivors of each (part, cell) row."""
        key = np.ascontiguousarray(np.column_stack([parts, cells]).astype(np.int32))
        names = [r.tobytes() for r in key]
        fresh = np.array([i for i, k in enumerate(names) if k not in self.known], np.int64)
        new = {}
        step = max(1, PAIR_NUMBERS // self.book[0].size)
        for a in range(0, len(fresh), step):
            at = fresh[a:a + step]
            bits = np.packbits(survivors(cells[at], parts[at], self.book, self.bits), axis=1)
            new.update((names[i], b.tobytes()) for i, b in zip(at.tolist(), bits))
        self.worked_out += len(fresh)
        out = b"".join(new[k] if k in new else self.known[k] for k in names)
        if len(self.known) + len(new) <= self.most:
            self.known.update(new)
        return np.frombuffer(out, np.uint8).reshape(len(names), -1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per row and part of x (rows, parts, components); ties to the lower entry."""
        rows, parts, dims = x.shape
        entries = self.book.shape[1]
        if not rows:
            return np.zeros((0, parts), np.int64), np.zeros((0, parts), np.int64)
        point, part = x.reshape(-1, dims), np.tile(np.arange(parts), rows)
        cell = point >> self.bits
        h = textkit.mix(part.astype(np.uint64) + textkit._M1)
        for k in range(dims):
            h = textkit.mix(h ^ cell[:, k].astype(np.uint64)) + textkit._M1
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        same = (part == part[first][which]) & (cell == cell[first][which]).all(1)
        alike = np.flatnonzero(~same)                                    # two cells under one hash: each for itself
        which[alike] = len(first) + np.arange(len(alike))
        first = np.concatenate([first, alike])
        bits = self.of(cell[first], part[first])
        left = np.unpackbits(bits, axis=1, count=entries).astype(bool)
        count, (_, entry) = left.sum(1), np.nonzero(left)
        start = np.cumsum(count) - count
        best = np.empty(len(point), np.int64)
        error = np.empty(len(point), np.int64)
        step = max(1, PAIR_NUMBERS // (entries * dims))
        for a in range(0, len(point), step):
            w = which[a:a + step]
            n = count[w]
            item = np.repeat(np.arange(len(w)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            e = entry[np.repeat(start[w], n) + at]
            d = point[a:a + step][item] - self.book[part[a:a + step][item], e]
            d = (d * d).sum(1)
            least = np.minimum.reduceat(d, np.cumsum(n) - n)
            hit = np.flatnonzero(d == least[item])
            _, lowest = np.unique(item[hit], return_index=True)          # entries ascend within an item
            best[a:a + step], error[a:a + step] = e[hit[lowest]], least
        return best.reshape(rows, parts), error.reshape(rows, parts)


def split(x: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """(rows, parts, components); zeros fill the last part up."""
    short = -x.shape[1] % parts
    if short:
        x = np.column_stack([x, np.zeros((len(x), short), x.dtype)])
    return x.reshape(len(x), parts, -1)


def first_book(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, components) from the rows with the smallest ids."""
    top = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).toArrow()           # at most ``entries`` rows
    x = vectors.unpack(top.column("x").combine_chunks() if top.num_rows else pa.array([], pa.binary()), dims)
    return np.ascontiguousarray(split(x, parts).transpose(1, 0, 2))


def improved(rows: DataFrame, book: np.ndarray, dims: int) -> np.ndarray:
    """One round: assign every part, then the floored mean of each entry's parts; unused entries stay."""
    shared = rows.sparkSession.sparkContext.broadcast(book)
    parts, entries, width = book.shape

    def run(batches):
        memo = Memo(shared.value)
        total = np.zeros((parts * entries, width + 1), np.int64)
        for b in batches:
            x = split(vectors.unpack(b.column("x"), dims), parts)
            code, _ = memo.nearest(x)
            at = (np.arange(parts) * entries + code).ravel()
            np.add.at(total, at, np.column_stack([np.ones(len(at), np.int64), x.reshape(-1, width)]))
        used = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         names=["at", "v"])

    found = vectors.summed(rows.select("x").mapInArrow(run, "at int, v array<bigint>"), ["at"], "v")
    total = np.zeros((parts * entries, width + 1), np.int64)
    for r in found.collect():                                            # one row per codebook component
        total[r["at"], r["pos"]] = r["total"]
    count, s = total[:, :1], total[:, 1:]
    return np.where(count > 0, s // np.maximum(count, 1), book.reshape(-1, width)).reshape(book.shape)


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, book: np.ndarray, dims: int) -> DataFrame:
    """The columns of ``rows`` but x, with code and error."""
    shared = rows.sparkSession.sparkContext.broadcast(book)
    keep = [c for c in rows.columns if c != "x"]

    def run(batches):
        memo = Memo(shared.value)
        for b in batches:
            code, error = memo.nearest(split(vectors.unpack(b.column("x"), dims), len(shared.value)))
            text = [r.tobytes().hex() for r in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(text, pa.string()), pa.array(error.sum(1))],
                                             names=[*keep, "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "x").mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["code string", "error long"]))


def train(rows: DataFrame, dims: int, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    book = first_book(rows, dims, parts, entries)
    for _ in range(rounds):
        book = improved(rows, book, dims)
    return book


def compress(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row."""
    spark = table.sparkSession
    common.bound_batches(spark)
    rows = vectors.packed(table, ["vec_id", "label"], SCALE, 0, MOST)
    dims, total = vectors.usual_length(rows.groupBy(F.length("x").alias("bytes")).agg(F.count("*").alias("n")))
    if not total:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    rows = rows.where(F.length("x") == dims * 4)
    book = train(rows, dims)
    name = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = common.checkpointed(encode(rows, book, dims).select("vec_id", name.alias("name"), "code", "error"))
    per_label = coded.groupBy("name").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return vectors.left_join(coded, per_label, "name", "n", total, "vec_id").select(
        F.col("vec_id").cast("long").alias("vec_id"), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(common.read(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """SQL of one round: distances to codebook k, nearest entries, codebook k + 1."""
    return f"""
near{k} AS (SELECT rid, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT i.rid, i.part, b.entry, sum((i.v - b.v) * (i.v - b.v)) AS d FROM item i JOIN book{k} b USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part),
sums{k} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS c FROM item JOIN near{k} USING (rid, part) GROUP BY ALL),
book{k + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN c IS NULL THEN b.v ELSE (s - ((s % c) + c) % c) // c END AS v
  FROM book{k} b LEFT JOIN sums{k} USING (part, entry, pos)),"""


SQL = f"""
WITH good AS (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
usual AS (SELECT len(x) AS dims FROM good GROUP BY 1 ORDER BY count(*) DESC, dims DESC LIMIT 1),
kept AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS rid FROM good, usual WHERE len(x) = dims),
item AS (SELECT rid, k // width AS part, k % width AS pos, coalesce(x[k + 1], 0) AS v FROM (
    SELECT rid, x, (dims + {PARTS - 1}) // {PARTS} AS width, unnest(range(((dims + {PARTS - 1}) // {PARTS}) * {PARTS})) AS k FROM kept)),
book0 AS (SELECT part, rid - 1 AS entry, pos, v FROM item WHERE rid <= {ENTRIES}),{"".join(_round(k) for k in range(ROUNDS))}
last AS (SELECT rid, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (
    SELECT i.rid, i.part, b.entry, sum((i.v - b.v) * (i.v - b.v)) AS d FROM item i JOIN book{ROUNDS} b USING (part, pos) GROUP BY ALL)
  GROUP BY rid, part),
coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM last GROUP BY rid),
book AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), book
"""
