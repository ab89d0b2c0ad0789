"""Line deduplication by a segment-partition edit join.

Non-blank lines (split at \\n) are compared across the corpus. A line goes if an earlier one, by (doc_id, text hash, line
number), equals it, or if both have at least ``MIN_BYTES`` UTF-8 bytes and are within ``EDITS`` byte edits. Blank lines
stay.

1. Equal lines meet by a 128-bit hash: a grouped minimum gives each distinct line its first place.
2. A line of length l is cut into ``EDITS`` + 1 segments. Two lines within that distance share a segment unchanged, so
   each line is indexed under (l, segment number, segment) and probes the indexes of lengths l - EDITS to l with the
   few substrings that can match there (the shift is bounded from both ends). Keys are 64-bit hashes; a line's id holds
   the parity of its hashed byte pairs, and an edit changes at most four parities, so ids rule out most chance
   meetings inside the join.
3. Round one compares each probe with one line per key, and the lines of a key of more than ``CROWD`` also with the
   earliest of them, so that the true copies of a line settle at once. Round two compares the other lines of a key, but
   only pairs with a line that has no earlier neighbour yet; in crowded keys two more signatures, parities of single
   bytes and of byte pairs, rule pairs out inside the join.
4. Banded bit-parallel edit distance on the bytes confirms each pair. Different lines that share an id are told apart
   by the second hash; they are compared whatever their keys.
5. Removed line numbers go back to their documents.

Defined cases: null or empty text has no lines; rows that share doc_id and text are one document; a null doc_id
comes first; ``remove`` drops documents that lose every non-blank line and keeps all columns (``n_chars`` follows the
text); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

EDITS = 2
MIN_BYTES = 32              # least length of a line that is compared by edits; equal lines of any length meet
CROWD = 24                  # lines of a key from which more signatures are worth their join
PARITIES = 40               # low bits of a line id: parities of byte pairs; then 8 bits of length, 16 of a hash
_ODD = 0xD6E8FEB86659FD93
_POWER: dict[str, np.ndarray] = {}


def _power(n: int, name: str, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between chunks."""
    got = _POWER.get(name)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        _POWER[name] = got = np.multiply.accumulate(got)
    return got[:n]


def split_lines(data: np.ndarray, off: np.ndarray, least: int = 0):
    """(start, end, row, number) of the lines of at least ``least`` bytes; numbers count all lines of a text from 0."""
    cut, ends = np.flatnonzero(data == 10), off[1:]
    row = np.concatenate([np.searchsorted(ends, cut, "right"), np.arange(len(ends))])
    closes = np.arange(len(row)) >= len(cut)                  # a line ends at a \\n or where its text ends
    order = np.lexsort((closes, row))
    bound, row, closes = np.concatenate([cut, ends])[order], row[order], closes[order]
    start = np.empty(len(bound), np.int64)
    if len(bound):
        start[0] = 0
        start[1:] = np.where(closes[:-1], bound[:-1], bound[:-1] + 1)
    number = np.arange(len(bound)) - np.searchsorted(row, row)
    keep = bound - start >= least
    return start[keep], bound[keep], row[keep], number[keep]


_BYTE_BIT = np.int64(1) << (textkit.mix(np.arange(256, dtype=np.uint64) + np.uint64(11)) % np.uint64(62)).astype(np.int64)
_WIDE_PAIR_BIT = np.int64(1) << (textkit.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(13)) % np.uint64(62)).astype(np.int64)
_PAIR_BIT = np.uint64(1) << (textkit.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(7)) % np.uint64(PARITIES))


class Lines:
    """Hashes of the eligible lines of a chunk."""

    def __init__(self, data: np.ndarray, off: np.ndarray, least: int = MIN_BYTES):
        lines = split_lines(data, off, least)
        if least < MIN_BYTES:
            ink = np.concatenate([[0], np.cumsum(~textkit.SPACE[data])])
            keep = (lines[1] - lines[0] >= MIN_BYTES) | (ink[lines[1]] > ink[lines[0]])
            lines = [x[keep] for x in lines]
        self.start, self.end, self.row, self.number = lines
        n = len(data)
        value = (data.astype(np.uint64) + np.uint64(1)) * _power(n, "up", _ODD)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        self.back = _power(n + 1, "down", pow(_ODD, -1, 1 << 64))
        self.data = data

    def hash(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return textkit.mix((self.total[start + size] - self.total[start]) * self.back[start] + size.astype(np.uint64))

    def ids(self) -> np.ndarray:
        """16 bits of a hash, 8 of the length, and the parities of the hashed byte pairs."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        pair = self.data[:-1].astype(np.uint16) << np.uint16(8) | self.data[1:]
        run = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(_PAIR_BIT[pair])])
        size = self.end - self.start
        return (self.hash(self.start, size) >> np.uint64(48) << np.uint64(48) | (size & 255).astype(np.uint64) << np.uint64(PARITIES)
                | run[self.end - 1] ^ run[self.start])

    def index_keys(self):
        """(line, key) of the segments."""
        size = self.end - self.start
        for i in range(EDITS + 1):
            at, length = segment(size, i)
            yield np.arange(len(size)), self._key(self.start + at, length, size, i)

    def probe_keys(self):
        """(line, key) of the substrings that can equal a segment of a line of the same or smaller length; those that are
        the line's own segments are its index keys."""
        size = self.end - self.start
        for gap in range(EDITS + 1):
            other = size - gap
            for i in range(EDITS + 1):
                at, length = segment(other, i)
                for shift in range(-EDITS, EDITS + 1):
                    if gap == shift == 0:
                        continue                              # the line's own index key
                    if abs(shift) <= i and abs(shift - gap) <= EDITS - i:
                        ok = np.flatnonzero((at + shift >= 0) & (at + shift + length <= size))
                        yield ok, self._key((self.start + at + shift)[ok], length[ok], other[ok], i)

    def _key(self, start, length, size, i):
        return textkit.mix(self.hash(start, length) ^ textkit.mix(size.astype(np.uint64) * np.uint64(EDITS + 1) + np.uint64(i)))


def segment(size: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, length) of segment ``i`` of lines of the given sizes: even, the last ones a byte longer."""
    parts = EDITS + 1
    base, extra = size // parts, size % parts
    longer_before = np.maximum(i - (parts - extra), 0)
    return base * i + longer_before, base + (i >= parts - extra)


def within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel over the band of 2 * most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    k, n = 0, min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")           # common ends cost no edits
    k = n - (x.bit_length() + 7) // 8
    a, b = a[k:], b[k:]
    n = min(len(a), len(b))
    x = int.from_bytes(a[len(a) - n:], "little") ^ int.from_bytes(b[len(b) - n:], "little")
    k = n - (x.bit_length() + 7) // 8
    a, b = a[:len(a) - k], b[:len(b) - k]
    if not a or not b:
        return len(a) + len(b) <= most
    n, width = len(a), 2 * most + 1
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # bit k of column j stands for row j - most + k; the window slides down one row per column
    up, down = mask >> most << most, 0
    score = min(most, n)
    for j, c in enumerate(b, 1):
        low = j - most - 1
        hits = where.get(c, 0)
        eq = (hits >> low if low >= 0 else hits << -low) & mask
        diag = ((((eq & up) + up) ^ up) | eq | down) & mask
        right_up = (down | ~(diag | up)) & mask
        right_down = diag & up
        if j + most <= n:
            score += not diag >> (width - 1) & 1                              # along the lowest diagonal
        else:
            bit = n - j + most                                                # then along the last row
            score += (right_up >> bit & 1) - (right_down >> bit & 1)
        up = (right_down | ~(diag >> 1 | right_up)) & mask
        down = diag >> 1 & right_up
    return score <= most


# ---------------------------------------------------------------- Spark

def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"),
                       F.col("text").cast("string").alias("text"))


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _second(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second, independent 64-bit hash of the lines."""
    raw = data.tobytes()
    return np.array([int.from_bytes(hashlib.blake2b(raw[s:e], digest_size=8).digest(), "little", signed=True)
                     for s, e in zip(start.tolist(), end.tolist())], np.int64)


def _distinct(x: Lines, ids: np.ndarray) -> np.ndarray:
    """Positions of the different lines of a chunk; only lines that share an id need their second hash for that."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    equal = ids[order][1:] == ids[order][:-1]
    shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    many = order[shared]
    check = _second(x.data, x.start[many], x.end[many])
    by = np.lexsort((check, ids[many]))
    many, check = many[by], check[by]
    new = np.ones(len(many), bool)
    new[1:] = (ids[many][1:] != ids[many][:-1]) | (check[1:] != check[:-1])
    return np.sort(np.concatenate([order[~shared], many[new]]))


def _listed(x: Lines, at: np.ndarray, keys) -> pa.ListArray:
    """One list of keys per line of ``x``: those of the lines at the places ``at``, empty lists for the others."""
    part = object.__new__(Lines)
    part.__dict__.update(x.__dict__, start=x.start[at], end=x.end[at])
    found = list(keys(part))
    value, there = np.zeros((len(at), len(found)), np.uint64), np.zeros((len(at), len(found)), bool)
    for k, (line, key) in enumerate(found):
        value[line, k], there[line, k] = key, True
    size = np.zeros(len(x.start) + 1, np.int32)
    size[at + 1] = there.sum(1)
    return pa.ListArray.from_arrays(np.cumsum(size, dtype=np.int32), pa.array(value[there].view(np.int64)))


def places(rows: DataFrame, exact_from: int = 1) -> DataFrame:
    """(id, check, doc_id, text_key, line, own, ask) of every eligible line, in one pass over the texts. A chunk's first
    occurrence of a line that is compared by edits carries its keys: ``own`` of its segments, ``ask`` of its probes."""
    def run(batches):
        for b in batches:
            for first, data, off in textkit.chunks(b.column("text")):
                x = Lines(data, off, min(exact_from, MIN_BYTES))
                ids, check = x.ids(), _second(data, x.start, x.end)
                order = np.lexsort((check, ids))
                new = np.ones(len(order), bool)
                new[1:] = (ids[order][1:] != ids[order][:-1]) | (check[order][1:] != check[order][:-1])
                new = np.sort(order[new])
                new = new[x.end[new] - x.start[new] >= MIN_BYTES]
                at = pa.array(first + x.row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64)), pa.array(check), b.column("doc_id").take(at), b.column("text_key").take(at),
                     pa.array(x.number, pa.int32()), _listed(x, new, Lines.index_keys), _listed(x, new, Lines.probe_keys)],
                    names=["id", "check", "doc_id", "text_key", "line", "own", "ask"])
        common.release()

    return rows.mapInArrow(run, "id long, check long, doc_id long, text_key long, line int, own array<long>, ask array<long>")


def _can_match(a: str, b: str) -> Column:
    """Parities allow the pair; lines of one length meet from both sides, so one of the two meetings counts."""
    x = F.col(a).bitwiseXOR(F.col(b))
    return ((F.bit_count(x.bitwiseAND((1 << PARITIES) - 1)) <= 4 * EDITS)
            & ((F.shiftright(x, PARITIES).bitwiseAND(255) != 0) | (F.col(a) < F.col(b))))


def _slot(ids: np.ndarray) -> np.ndarray:
    """Bitmap slot of an id: its hash bits and its lowest parities."""
    return ((ids >> np.uint64(48) << np.uint64(6)) | ids & np.uint64(63)).astype(np.int64)


def _bodies(need: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, check, body) of all lines whose id is in the one column of ``need`` (distinct)."""
    need = common.checkpointed(need)
    slots = common.bitmap(need.select(F.expr("shiftleft(shiftrightunsigned(id, 48), 6) | (id & 63)").alias("s")))

    def run(batches):
        for b in batches:
            for _, data, off in textkit.chunks(b.column("text")):
                x = Lines(data, off)
                ids = x.ids()
                first = np.flatnonzero(common.in_bitmap(slots.value, _slot(ids)))
                x.start, x.end, ids = x.start[first], x.end[first], ids[first]
                first = _distinct(x, ids)
                x.start, x.end, raw = x.start[first], x.end[first], data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first].view(np.int64)), pa.array(_second(data, x.start, x.end)),
                     pa.array([raw[s:e] for s, e in zip(x.start.tolist(), x.end.tolist())], pa.binary())],
                    names=["id", "check", "body"])
        common.release()

    lines = (rows.select("text").mapInArrow(run, "id long, check long, body binary")
             .join(need.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id", "check"]))
    return common.checkpointed(lines)


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(ida, checka, idb, checkb) of the id pairs (ida, idb) whose lines are within ``EDITS`` edits."""
    side = lambda x: lines.select(F.col("id").alias(f"id{x}"), F.col("check").alias(f"check{x}"),
                                  F.col("body").alias(f"body{x}"))
    near = F.arrow_udf(lambda a, b: pa.array([within(x, y, EDITS) for x, y in zip(a.to_pylist(), b.to_pylist())],
                                             pa.bool_()), "boolean")
    return (pairs.join(side("a"), "ida").join(side("b"), "idb")
            .where((F.col("ida") != F.col("idb")) | (F.col("checka") < F.col("checkb"))).where(near("bodya", "bodyb"))
            .select("ida", "checka", "idb", "checkb"))


def _ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("ida").alias("id")).union(pairs.select("idb")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("ida", "idb").alias("ida"), F.greatest("ida", "idb").alias("idb")).distinct()


def _parities(body: pa.Array) -> pa.Array:
    """Two signatures of a line: parities of its single bytes and of its byte pairs, 62 classes each."""
    out = []
    for b in body.to_pylist():
        x = np.frombuffer(b, np.uint8)
        pair = x[:-1].astype(np.uint16) << np.uint16(8) | x[1:]
        out.append([int(np.bitwise_xor.reduce(_BYTE_BIT[x])), int(np.bitwise_xor.reduce(_WIDE_PAIR_BIT[pair]))])
    return pa.array(out, pa.list_(pa.int64()))


def _signed(members: DataFrame, lines: DataFrame) -> DataFrame:
    """``members`` with ``sign``, their lines' parities; NULL where several lines share an id."""
    sign = F.arrow_udf(_parities, "array<long>")
    one = lines.groupBy("id").agg(F.count("*").alias("n"), F.min("body").alias("body")).where("n = 1")
    return members.join(one.select("id", sign("body").alias("sign")), "id", "left")


def _met(members: DataFrame) -> DataFrame:
    """Pairs of a probe and a line under one key that may match and of which one has no earlier neighbour yet.

    An edit changes at most two single-byte parities and four of byte pairs.
    """
    ask = members.where("probe").select("key", F.col("id").alias("ida"), F.col("settled").alias("sa"), F.col("sign").alias("ga"))
    have = members.where("NOT probe").select("key", F.col("id").alias("idb"), F.col("settled").alias("sb"), F.col("sign").alias("gb"))
    off = lambda k: F.bit_count(F.col("ga")[k].bitwiseXOR(F.col("gb")[k]))
    alike = F.coalesce((off(0) <= 2 * EDITS) & (off(1) <= 4 * EDITS), F.lit(True))
    return _ordered(ask.join(have, "key").where((F.col("ida") != F.col("idb")) & _can_match("ida", "idb")
                                                & ~(F.col("sa") & F.col("sb")) & alike))


def _bounds(first: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, check, bound): the earliest first place among a line's confirmed neighbours."""
    both = edges.union(edges.select("idb", "checkb", "ida", "checka"))
    other = first.select(F.col("id").alias("idb"), F.col("check").alias("checkb"), F.col("place").alias("bound"))
    return (both.join(other, ["idb", "checkb"]).groupBy(F.col("ida").alias("id"), F.col("checka").alias("check"))
            .agg(F.min("bound").alias("bound")))


def _early(first: DataFrame, edges: DataFrame, twins: DataFrame) -> DataFrame:
    """(id, settled): lines with an earlier confirmed neighbour."""
    return (_bounds(first, edges).join(first, ["id", "check"]).where(F.col("bound") < F.col("place"))
            .select("id").distinct().join(twins, "id", "left_anti").withColumn("settled", F.lit(True)))


def removed_lines(docs: DataFrame, exact_from: int = 1) -> DataFrame:
    """(doc_id, text_key, gone: array of line numbers) of the documents that lose lines."""
    rows = _keyed(docs)
    seen = common.checkpointed(places(rows, exact_from))
    place = F.struct("doc_id", "text_key", "line")
    first = common.checkpointed(seen.groupBy("id", "check").agg(F.min(place).alias("place"), F.max(place).alias("last")))
    # ids of several lines: each of their lines meets the others here, and none counts as settled for another
    twins = common.checkpointed(first.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    index = seen.select(F.explode("own").alias("key"), "id")
    pivots = index.groupBy("key").agg(F.min("id").alias("p"), F.max("id").alias("q"), F.count("*").alias("n"))
    live = common.checkpointed(seen.select(F.explode(F.concat("own", "ask")).alias("key"), "id").join(pivots, "key").where("NOT (p = q AND p = id)"))
    star = _ordered(live.where((F.col("id") != F.col("p")) & (_can_match("id", "p") | _can_match("p", "id")))
                    .select(F.col("id").alias("ida"), F.col("p").alias("idb")))
    many = live.where(F.col("n") > CROWD).select("key").distinct()       # n counts a line once per chunk that has it
    lines = common.checkpointed(index.join(many, "key", "left_semi").distinct())
    crowd = common.checkpointed(lines.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > CROWD).select("key"))
    members = common.checkpointed(lines.join(crowd, "key", "left_semi").withColumn("probe", F.lit(False)).union(
        live.join(crowd, "key", "left_semi").select("key", "id").distinct().withColumn("probe", F.lit(True))))
    crowded = bool(members.limit(1).count())
    earliest = first.groupBy("id").agg(F.min("place").alias("place"))
    star = star.union(twins.select(F.col("id").alias("ida"), F.col("id").alias("idb")))
    if crowded:
        # the earliest line of a crowded key meets all others, so its true copies settle at once
        ranked = members.join(earliest, "id")
        hubs = ranked.where("NOT probe").groupBy("key").agg(F.min_by("id", "place").alias("hub"))
        hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        met = members.withColumn("salt", F.pmod("id", F.lit(32)).cast("int")).join(hubs, ["key", "salt"])
        star = star.union(_ordered(met.where((F.col("id") != F.col("hub")) & (_can_match("id", "hub") | _can_match("hub", "id")))
                                   .select(F.col("id").alias("ida"), F.col("hub").alias("idb"))))
    star = common.checkpointed(star.distinct())
    bodies = _bodies(_ids_of(star).union(members.select("id")).distinct(), rows)
    found = common.checkpointed(_near(star, bodies))
    early = _early(first, found, twins)
    settled = lambda d: d.join(early, "id", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    few = live.where(F.col("p") != F.col("q")).select("key", "id").distinct()
    if crowded:
        few = few.join(crowd, "key", "left_anti")
    rest = _met(settled(few.withColumn("probe", F.lit(True)).union(
        index.join(few.select("key").distinct(), "key", "left_semi").distinct().withColumn("probe", F.lit(False))))
        .withColumn("sign", F.lit(None).cast("array<long>")))
    if crowded:
        rest = rest.union(_met(_signed(settled(members), bodies)))
    rest = common.checkpointed(rest.distinct().join(star, ["ida", "idb"], "left_anti"))
    more = common.checkpointed(_ids_of(rest).join(bodies.select("id").distinct(), "id", "left_anti"))
    if more.limit(1).count():
        bodies = bodies.union(_bodies(more, rows))
    edges = found.union(_near(rest, bodies))
    bound = (first.join(_bounds(first, edges), ["id", "check"], "left")
             .withColumn("bound", F.least("place", F.coalesce("bound", "place")))
             .where(F.col("last") > F.col("bound")).select("id", "check", "bound"))
    return (seen.join(bound, ["id", "check"]).where(F.struct("doc_id", "text_key", "line") > F.col("bound"))
            .groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone")))


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    lines, removed, kept = [], [], []
    for t, g in zip(text.to_pylist(), gone.to_pylist()):
        parts, drop = (t or "").split("\n"), set(g or ())
        lines.append(len(parts) if t else 0)
        removed.append(len(drop))
        kept.append(t if not drop else "\n".join(p for i, p in enumerate(parts) if i not in drop))
    return pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                      names=["n_lines", "n_removed", "kept"])


def _uncut(text: Column) -> Column:
    """What ``_cut`` gives for a text that loses nothing, without a Python worker."""
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    n = F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, F.lit(0)).otherwise(breaks + 1)
    return F.struct(n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), text.alias("kept"))


def _with_cut(docs: DataFrame, name: str, exact_from: int) -> DataFrame:
    """``docs`` with a struct column (n_lines, n_removed, kept text). Texts that lose nothing are neither shuffled nor sent
    to Python."""
    gone = common.checkpointed(removed_lines(docs, exact_from).select(
        F.col("doc_id").alias(f"{name}_id"), F.col("text_key").alias(f"{name}_key"), F.col("gone").alias(f"{name}_gone")))
    touched = common.may_hold(gone.select(f"{name}_key"))
    udf = F.arrow_udf(_cut, "struct<n_lines:bigint,n_removed:bigint,kept:string>")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}_id")) & (_text_key() == F.col(f"{name}_key"))
    text = F.col("text").cast("string")
    flagged = docs.withColumn(f"{name}_maybe", touched(_text_key()))
    part = (flagged.where(f"{name}_maybe").join(gone.hint("shuffle_hash"), on, "left")
            .withColumn(name, udf(text, F.col(f"{name}_gone"))))
    whole = flagged.where(f"NOT {name}_maybe").withColumn(name, _uncut(text))
    return part.select(*docs.columns, name).union(whole.select(*docs.columns, name))


def dedupe_lines(docs: DataFrame, exact_from: int = 1) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (what is left)."""
    name = common.fresh(docs, "line_cut")
    return _with_cut(docs, name, exact_from).select(F.col("doc_id").cast("long").alias("doc_id"), f"{name}.n_lines",
                                        f"{name}.n_removed", F.col(f"{name}.kept").alias("text"))


def remove(docs: DataFrame, exact_from: int = 1) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; documents left blank by that go."""
    name = common.fresh(docs, "line_cut")
    cut = _with_cut(docs, name, exact_from).where((F.col(f"{name}.n_removed") == 0) | F.col(f"{name}.kept").rlike(r"\S"))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(F.col(f"{name}.kept").alias(c))
        elif c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            out.append(F.when(F.col(f"{name}.n_removed") > 0, F.length(f"{name}.kept").cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return cut.select(*out)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_lines(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op1_line_dedup_all_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same query; exact copies of every non-blank line go in ``op1_line_dedup`` as well."""
    return op1_line_dedup(spark, sf_dir)


SQL = f"""
WITH l AS (SELECT doc_id, i, t, strlen(t) AS n FROM (
        SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS t
        FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''))),
f AS (SELECT t, n, min((doc_id, i)) AS place FROM l
      WHERE n >= {MIN_BYTES} OR regexp_matches(t, '[^\\x20\\x09-\\x0D]') GROUP BY t, n),
p AS (SELECT a.t, b.place FROM f a JOIN f b ON a.n >= {MIN_BYTES} AND b.n >= {MIN_BYTES}
      AND b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND levenshtein(a.t, b.t) <= {EDITS}),
e AS (SELECT t, min(place) AS bound FROM (SELECT t, place FROM f UNION ALL SELECT t, place FROM p) GROUP BY t),
r AS (SELECT l.doc_id, l.i, l.t, e.bound IS NOT NULL AND (l.doc_id, l.i) > e.bound AS gone FROM l LEFT JOIN e ON l.t = e.t),
k AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
        string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""
