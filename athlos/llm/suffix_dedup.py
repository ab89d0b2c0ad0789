"""Removal of repeated byte strings by suffix sorting.

A byte goes if it lies in a string of ``WIDTH`` bytes that also starts anywhere else in the corpus. Sorting every
suffix of the corpus is not needed: a repeated string contains the same anchors wherever it stands.

1. Anchors are the minimizers of ``GRAM``-byte hashes over each ``WIDTH``-byte window, so every such window holds one,
   chosen by the window's content alone. About one position in 53 is an anchor. Texts are keyed by their MD5, so
   copies count once; copies of at least ``WIDTH`` bytes are repeated as a whole.
2. Anchors whose gram occurs once are dropped by a grouped count. The others fetch their context from the text: up to
   ``WIDTH`` bytes to the right (the suffix) and ``WIDTH - GRAM`` to the left. Equal contexts of a text travel once.
3. Contexts meet by gram. Their suffixes are put in order by deep-shallow sorting: multikey quicksort over 8-byte keys
   to a shallow depth, then a blind trie for each group that is still tied. The order gives the tree of common
   prefixes; at each of its nodes (depth r), ordering the members by their reversed left contexts gives the longest
   common left l. Where l + r >= ``WIDTH``, the bytes from l before the anchor to r after it are repeated.
4. A gram at more than ``HOT`` places (a passage that many documents share) is not gathered in a task: each of its
   contexts sends a 128-bit hash per window around the anchor, and grouped counts say which windows repeat.
5. The spans go back to their texts, are merged, and cut.

Defined cases: null text is empty; texts under ``WIDTH`` bytes lose nothing; repeated rows are copies of each other;
null ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

WIDTH = 200
GRAM = 96                   # long enough that short shared lines make no anchors in common
LEFT = WIDTH - GRAM
SHALLOW = 5                 # 8-byte keys that multikey quicksort compares: the gram's hash and its 32 bytes
HOT = 1 << 15               # places of a gram that one task may gather: some 40 MB
_ODD = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position (polynomial modulo 2^64, mixed)."""
    n = len(data) - GRAM + 1
    power = _powers(len(data), _ODD)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = _powers(n, pow(_ODD, -1, 1 << 64))
    return textkit.mix((total[GRAM:] - total[:-GRAM]) * back)


def _sliding(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """``op`` (minimum or maximum) over each ``w`` consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    full = np.full(blocks * w, pad, x.dtype)
    full[:n] = x
    grid = full.reshape(blocks, w)
    ahead = op.accumulate(grid, axis=1).ravel()
    behind = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the minimizers of one text."""
    if len(data) < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    w = WIDTH - GRAM + 1
    low = _sliding(h, w, np.minimum, np.iinfo(np.uint64).max)            # per window
    edge = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(edge, w, np.maximum, np.uint64(0)) == h)  # least of some window
    return at, h[at]


# ---------------------------------------------------------------- deep-shallow sorting

def shallow_sort(keys: np.ndarray) -> list[np.ndarray]:
    """Multikey quicksort of rows of 8-byte keys: index groups in order; rows of a group tie in every key."""
    out, stack = [], [(np.arange(len(keys)), 0)]
    while stack:
        idx, d = stack.pop()
        if len(idx) < 2 or d == keys.shape[1]:
            if len(idx):
                out.append(idx)
            continue
        v = keys[idx, d]
        pivot = np.partition(v, len(v) // 2)[len(v) // 2]
        stack += [(idx[v > pivot], d), (idx[v == pivot], d + 1), (idx[v < pivot], d)]
    return out


class BlindTrie:
    """Orders byte strings with a long common prefix: a Patricia trie that holds only depths and branching bytes.

    Insertion walks blindly by branching bytes to some leaf, compares once with that leaf's string to find the true
    common prefix, and branches there.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root = None
        for i in range(len(strings)):
            self._insert(i)

    @staticmethod
    def common(a: bytes, b: bytes) -> int:
        n = min(len(a), len(b))
        x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
        return n - (x.bit_length() + 7) // 8

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        # a leaf is a list of equal strings' indices; an inner node is (depth, {byte: child})
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            kids = node[1]
            node = kids.get(self._byte(s, node[0])) or next(iter(kids.values()))
        other = self.strings[node[0]]
        depth = self.common(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            above, node = (node, self._byte(s, node[0])), node[1][self._byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(s, depth)] = [i]
            return
        new = (depth, {self._byte(other, depth): node, self._byte(s, depth): [i]})
        if above is None:
            self.root = new
        else:
            above[0][1][above[1]] = new

    def nodes(self):
        """(depth, members) of every node with two members or more, members in suffix order; and the order."""
        found = []

        def walk(node):
            if isinstance(node, list):
                if len(node) > 1:
                    found.append((len(self.strings[node[0]]), node))
                return node
            members = [i for b in sorted(node[1]) for i in walk(node[1][b])]
            found.append((node[0], members))
            return members
        order = walk(self.root) if self.root is not None else []
        return found, order


def repeated(suffixes: list[bytes], lefts: list[bytes], times: list[int]) -> list[tuple[int, int]]:
    """(l, r) per context of one gram: the bytes from l before to r after the anchor are repeated; (0, 0) if none.

    ``lefts`` are reversed left contexts; ``times`` counts the places of each context.
    """
    best = [(len(lf), len(s)) if t > 1 and len(lf) + len(s) >= WIDTH else (0, 0)
            for s, lf, t in zip(suffixes, lefts, times)]
    found, _ = BlindTrie(suffixes).nodes()
    rank = {i: k for k, i in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))} if found else {}
    for r, members in found:
        if r + LEFT < WIDTH:
            continue
        row = sorted(members, key=rank.__getitem__)
        near = [BlindTrie.common(lefts[a], lefts[b]) for a, b in zip(row, row[1:])]
        for k, i in enumerate(row):
            left = max(near[k - 1] if k else 0, near[k] if k < len(near) else 0)
            if left + r >= WIDTH:
                best[i] = (max(best[i][0], left), max(best[i][1], r))
    return best


# ---------------------------------------------------------------- Spark

_CONTEXT = "gram long, digest binary, key binary, left binary, suffix binary, places array<int>"
_SPANS = "key binary, spans array<struct<start:int,stop:int>>"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body, key (MD5) and short (its first 8 bytes as a long; a shared one only adds contexts)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")).withColumn("digest", F.md5("body"))
    return rows.select("doc_id", "body", F.unhex("digest").alias("key"), _short("digest").alias("short"))


def _short(digest: str) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _anchor_rows(rows: DataFrame) -> DataFrame:
    """(gram, short, place) of every anchor."""
    def run(batches):
        for b in batches:
            short = b.column("short").to_numpy()
            for first, data, off in textkit.chunks(b.column("body")):
                key, gram, place = [], [], []
                for i in range(len(off) - 1):
                    at, h = anchors(data[off[i]:off[i + 1]])
                    key.append(np.full(len(at), short[first + i]))
                    gram.append(h)
                    place.append(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.concatenate(key)),
                     pa.array(np.concatenate(place), pa.int32())], names=["gram", "short", "place"])

    return rows.select("short", "body").mapInArrow(run, "gram long, short long, place int")


def _contexts(rows: DataFrame) -> DataFrame:
    """Distinct contexts of each text's shared anchors, from (key, body, at: array of place and gram)."""
    def run(batches):
        for b in batches:
            out, held = [], 0
            for i in range(b.num_rows):
                body, key = b.column("body")[i].as_py(), b.column("key")[i].as_py()
                seen: dict[tuple, list[int]] = {}
                for x in b.column("at")[i].as_py():
                    p = x["place"]
                    seen.setdefault((x["gram"], body[max(0, p - LEFT):p][::-1], body[p:p + WIDTH]), []).append(p)
                for (g, lf, s), places in seen.items():
                    out.append((g, hashlib.blake2b(len(lf).to_bytes(2, "big") + lf + s, digest_size=16).digest(),
                                key, lf, s, places))
                    held += len(lf) + len(s)
                if held > 1 << 21:
                    yield _context_batch(out)
                    out, held = [], 0
            if out:
                yield _context_batch(out)

    return rows.mapInArrow(run, _CONTEXT)


def _context_batch(rows):
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.int64()), *[pa.array(x, pa.binary()) for x in c[1:5]], pa.array(c[5], pa.list_(pa.int32()))],
        names=["gram", "digest", "key", "left", "suffix", "places"])


def _span_batch(rows):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in rows], pa.binary()),
         pa.array([[{"start": s, "stop": e} for s, e in x] for _, x in rows], kind)], names=["key", "spans"])


def _sorted_groups(batches):
    """Deep-shallow sorting of a partition ordered by gram; yields (key, spans) rows."""
    held: list = []

    def solve(rows):
        # rows: (gram, digest, key, left, suffix, places); equal contexts of several texts count together
        keys = np.zeros((len(rows), SHALLOW), np.uint64)
        keys[:, 0] = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        flat = np.frombuffer(b"".join(r[4][:8 * (SHALLOW - 1)].ljust(8 * (SHALLOW - 1), b"\0") for r in rows), ">u8")
        keys[:, 1:] = flat.reshape(len(rows), SHALLOW - 1)
        out = []
        for group in shallow_sort(keys):
            merged: dict[bytes, list] = {}
            for i in group.tolist():
                merged.setdefault(rows[i][1], []).append(rows[i])
            if len(merged) == 1 and len(group) == 1 and len(rows[group[0]][5]) == 1:
                continue
            some = [v[0] for v in merged.values()]
            times = [sum(len(r[5]) for r in v) for v in merged.values()]
            for (left, right), same in zip(repeated([r[4] for r in some], [r[3] for r in some], times), merged.values()):
                if right:
                    out += [(r[2], [(p - left, p + right) for p in r[5]]) for r in same]
        return out

    for b in batches:
        held += zip(*[b.column(c).to_pylist() for c in ("gram", "digest", "key", "left", "suffix", "places")])
        last = held[-1][0] if held else None
        ready = [r for r in held if r[0] != last]
        held = [r for r in held if r[0] == last]
        if ready and (got := solve(ready)):
            yield _span_batch(got)
    if held and (got := solve(held)):
        yield _span_batch(got)


def _hot_spans(contexts: DataFrame) -> DataFrame:
    """(key, spans) of contexts of hot grams: grouped counts of the hashes of every window around the anchor."""
    def run(batches):
        for b in batches:
            for gram, left, suffix, n in zip(*[b.column(c).to_pylist() for c in ("gram", "left", "suffix", "n")]):
                body, hashes, shifts = left[::-1] + suffix, [], []
                for x in range(max(0, WIDTH - len(suffix)), len(left) + 1):
                    at = len(left) - x
                    hashes.append(hashlib.blake2b(x.to_bytes(2, "big") + body[at:at + WIDTH], digest_size=16).digest())
                    shifts.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gram] * len(shifts), pa.int64()), pa.array(hashes, pa.binary()),
                     pa.array(shifts, pa.int32()), pa.array([n] * len(shifts), pa.int64())],
                    names=["gram", "window", "shift", "n"])

    distinct = contexts.groupBy("gram", "digest").agg(
        F.first("left").alias("left"), F.first("suffix").alias("suffix"), F.sum(F.size("places")).alias("n"))
    each = distinct.select("gram", "digest", "left", "suffix", "n")

    def with_digest(batches):
        for b in batches:
            for i in range(b.num_rows):
                for out in run([b.slice(i, 1)]):
                    d = pa.array([b.column("digest")[i].as_py()] * out.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([*out.columns, d], names=[*out.schema.names, "digest"])

    windows = common.checkpointed(each.mapInArrow(
        with_digest, "gram long, window binary, shift int, n long, digest binary"))
    again = windows.groupBy("gram", "window").agg(F.sum("n").alias("n")).where("n > 1").select("gram", "window")
    reach = (windows.join(again, ["gram", "window"]).groupBy("gram", "digest")
             .agg(F.max("shift").alias("l"), (WIDTH - F.min("shift")).alias("r")))
    spans = F.transform("places", lambda p: F.struct((p - F.col("l")).cast("int").alias("start"),
                                                     (p + F.col("r")).cast("int").alias("stop")))
    return contexts.join(reach, ["gram", "digest"]).select("key", spans.alias("spans"))


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct texts: key, short, n, copies, rep) and (key, spans) of the repeated strings of each distinct text."""
    rows = _keyed(docs)
    texts = common.checkpointed(rows.groupBy("key").agg(
        F.first("short").alias("short"), F.first(F.octet_length("body")).cast("long").alias("n"),
        F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
    # a gram is shared if it stands at two different places; the places are told apart by a hash
    at = F.xxhash64("short", "place")
    grams = common.checkpointed(_anchor_rows(rows).groupBy("gram")
                                .agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
                                .where("lo != hi").select("gram", (F.col("n") > HOT).alias("hot")))
    maybe = common.may_hold(grams.select("gram"))
    shared = (_anchor_rows(rows).where(maybe(F.col("gram"))).join(grams, "gram")
              .groupBy("short").agg(F.collect_set(F.struct("place", "gram", "hot")).alias("at")))
    # one copy of a text is enough; key and id together spread the copies over the tasks
    shared = common.checkpointed(shared.join(texts.select("short", "key", "rep"), "short").select("key", "rep", "short", "at"))
    few = (_fetched(rows, shared, hot=False).repartition("gram").sortWithinPartitions("gram")
           .mapInArrow(_sorted_groups, _SPANS))
    if grams.where("hot").limit(1).count():
        few = few.union(_hot_spans(common.checkpointed(_fetched(rows, shared, hot=True))))
    return texts, few


def _fetched(rows: DataFrame, shared: DataFrame, hot: bool) -> DataFrame:
    """Contexts of the texts' anchors with hot, or with other grams."""
    own = F.filter("at", lambda x: x["hot"] == hot)
    shared = shared.withColumn("at", own).where(F.size("at") > 0)
    near = common.may_hold(shared.select("short"))
    return _contexts(rows.where(near(F.col("short")))
                     .join(shared.select(F.col("key").alias("k"), "rep", "at").hint("shuffle_hash"),
                           (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("rep")))
                     .select("key", "body", F.sort_array("at").alias("at")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, body (bytes), kept (bytes), spans (removed, merged) of every document."""
    texts, spans = repeated_spans(docs)
    per_text = spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # a text with copies of at least WIDTH bytes is repeated as a whole
    cuts = texts.join(per_text, "key", "left").withColumn("gone", (F.col("copies") > 1) & (F.col("n") >= WIDTH)).where(
        "gone OR spans IS NOT NULL").select(F.col("key").alias("k"), "short", "gone", "spans")
    cuts = common.checkpointed(cuts)
    touched = common.may_hold(cuts.select("short"))

    def cut(body: pa.Array, spans: pa.Array, gone: pa.Array) -> pa.Array:
        kept, merged = [], []
        for t, s, g in zip(body.to_pylist(), spans.to_pylist(), gone.to_pylist()):
            m = [(0, len(t))] if g else _merge((x["start"], x["stop"]) for x in s or ())
            edge = [0, *[p for x in m for p in x], len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))
            merged.append([{"start": a, "stop": b} for a, b in m])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(merged, kind)], names=["kept", "spans"])

    udf = F.arrow_udf(cut, "struct<kept:binary,spans:array<struct<start:int,stop:int>>>")
    rows = _keyed(docs).withColumn("touched", touched(F.col("short")))
    part = (rows.where("touched").join(cuts.drop("short").hint("shuffle_hash"), F.col("key") == F.col("k"), "left")
            .select("doc_id", "body", udf("body", "spans", F.coalesce("gone", F.lit(False))).alias("x"))
            .select("doc_id", "body", "x.kept", "x.spans"))
    # texts that lose nothing stay where they are
    whole = rows.where("NOT touched").select("doc_id", "body", F.col("body").alias("kept"),
                                             F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return part.union(whole)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.read(spark, sf_dir, "documents"))
    n = F.octet_length("body").cast("long")
    return out.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
