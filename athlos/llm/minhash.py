"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the whole texts gives each document its set size, its sketch (the ``K`` smallest 63-bit hashes of
   its distinct word shingles) and a 128-bit fingerprint of the full set. Documents with equal sets collapse to one
   class by a grouped minimum, so copies never form pairs.
2. Retained values make inverted lists, under pairs of neighbouring values: similar sets share many such pairs,
   while documents that only share common shingles rarely share one. Two similar sets share at least ``t`` pairs
   (see ``_lists``); pairs of one class, and classes with fewer shared pairs, are dropped.
3. Round one pairs each list member with the list's hub only (linear): the member most of whose retained values
   others hold, which among edited copies is the least edited. Pairs pass a size filter and the union-sketch
   estimate, then exact Jaccard on the full sets confirms them. Round two takes the classes of the lists that round
   one left in several components and joins them across components by an exact prefix filter on their full sets. A
   group of near copies is mostly one component after round one, so it does not expand into all its pairs. No list is
   capped.
4. Components of the confirmed links by star contraction, carried back over the fingerprints.

Defined cases: null or empty text has an empty set, linked with nothing. A null ``doc_id`` is linked with nothing
(component null, kept true). Rows with one ``doc_id`` are one document and so share a component; ``dedupe`` takes
(doc_id, text) as the document instead. An empty table gives an empty result. Extra columns are ignored, and ``dedupe``
keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

K = 64
PERCENT = 80
STAGE_WORDS = 5

_SKETCH = "doc_id long, n long, sketch array<long>, fp binary"
_SET = "fp binary, items array<long>"


def _sets(batch: pa.RecordBatch, n: int):
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    col = batch.column("text")
    for first, data, off in textkit.chunks(col):
        start, end, row = textkit.words(textkit.LOWER[data], off, textkit.SPACE)
        h = textkit.hash_spans(textkit.LOWER[data], start, end)
        win = textkit.windows(h, n) >> np.uint64(1)
        at = textkit.rows_of(row, len(off) - 1)
        for i in range(len(off) - 1):
            a, b = int(at[i]), int(at[i + 1])
            yield first + i, (np.unique(win[a:b - n + 1]).view(np.int64) if b - a >= n
                              else textkit.shingles(h[a:b], n))


def _print(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, sketch, fp) of each document's ``n``-word shingle set."""
    def run(batches):
        for b in batches:
            ids, size, sk, fp = [], [], [], []
            for _, items in _sets(b, n):
                size.append(len(items))
                sk.append(items[:K])
                fp.append(_print(items))
            lens = np.array([len(s) for s in sk], np.int64)
            flat = np.concatenate(sk) if sk else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), lists, pa.array(fp, pa.binary())],
                names=["doc_id", "n", "sketch", "fp"])
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, _SKETCH)


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(fp, items): one full set per fingerprint."""
    def run(batches):
        for b in batches:
            fp, sets, held = [], [], 0
            for _, items in _sets(b, n):
                fp.append(_print(items))
                sets.append(items)
                held += len(items)
                if held > 1 << 20:
                    yield _set_batch(fp, sets)
                    fp, sets, held = [], [], 0
            if fp:
                yield _set_batch(fp, sets)
        common.release()

    return docs.select("text").mapInArrow(run, _SET).dropDuplicates(["fp"])


def _set_batch(fp, sets):
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return pa.RecordBatch.from_arrays(
        [pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))],
        names=["fp", "items"])


def _rarest(value: str, need: Column, sizes: Column) -> Column:
    """How many of the shared values (rare first) to list: two sets that share ``need`` of ``sizes`` values share one
    of their ``sizes - need + 1`` rarest, and values nobody else holds are the rarest of all."""
    return (sizes - need + 1 - (sizes - F.size(value))).cast("int")


def _shared_values(rows: DataFrame, values: str) -> DataFrame:
    """(rid, shared): the values of each row that another row holds too, rare first, as (df, v)."""
    each = rows.select("rid", F.explode(values).alias("v"))
    held = each.groupBy("v").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    return (each.join(held, "v").groupBy("rid")
            .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("shared")))    # at most one set or sketch


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(v, fp, cid, need, hub): each class under its pairs of neighbouring retained values that another class has too.
    ``hub`` is the share of its pairs that others have: highest for the least edited of a group of copies. ``need`` is
    the number of pairs that a similar class must share; a class with fewer shared pairs is not listed.

    With d differing values in a union of u, at least u - 2d - 1 neighbouring pairs are common, where d is at most
    (1 - similarity) * u. This is exact for sets that fit the sketch; beyond, it holds in the sketch up to a deviation of
    d, and ``K / 8`` common pairs is over four standard deviations below even that bound (37 pairs at 0.8).
    """
    pairs = F.when(F.size("sketch") < 2, F.col("sketch")).otherwise(
        F.zip_with(F.slice("sketch", F.lit(1), F.size("sketch") - 1), F.slice("sketch", F.lit(2), F.size("sketch")),
                   lambda a, b: F.xxhash64(a, b)))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * (2 * percent - 100) / 100 - 1))
    need = F.when(F.col("n") * 100 <= K * percent, least).otherwise(F.lit(K // 8))
    rows = classes.withColumn("pairs", pairs).withColumn("need", need.cast("int"))
    rows = rows.join(_shared_values(rows, "pairs"), "rid").where(F.size("shared") >= F.col("need"))
    return (rows.select(F.explode("shared").alias("x"), "fp", "cid", "need", (F.size("shared") / F.size("pairs")).alias("hub"))
            .select("x.v", "fp", "cid", "need", "hub"))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (fa, fb) that pass the size filter and the union-sketch estimate."""
    side = lambda x: classes.select(F.col("fp").alias(f"f{x}"), F.col("cid").alias(f"c{x}"),
                                    F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
    return (pairs.join(side("b"), "fb").join(side("a"), "fa")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .withColumn("u", F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K))
            .where(100 * both >= (percent - 30) * F.size("u"))
            .select("fa", "ca", "na", "fb", "cb", "nb"))


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(fp, items) of the documents in ``ids`` (doc_id). Hashing the ids' side keeps texts out of any sort."""
    ids = common.checkpointed(ids.distinct())
    maybe = common.may_hold(ids)
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .where(maybe(F.col("doc_id"))).join(ids.hint("shuffle_hash"), "doc_id", "left_semi"))
    return full_sets(texts, n)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) class ids of the pairs whose full sets reach the similarity."""
    both = F.size(F.array_intersect("ia", "ib")).cast("long")
    return (pairs.join(sets.select(F.col("fp").alias("fb"), F.col("items").alias("ib")), "fb")
            .join(sets.select(F.col("fp").alias("fa"), F.col("items").alias("ia")), "fa")
            .withColumn("both", both).where("100 * both >= %d * (na + nb - both)" % percent)
            .select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of ``rest`` (rid, fp, cid, n, items, component) in different components that can reach the similarity.

    Exact prefix filter on the full sets, rare values first. Where a pair meets first, its overlap is at most the
    smaller number of held values from there on; values that no other row holds come before all others, so this
    drops most edited copies without pairing them.
    """
    need = F.ceil(F.col("n") * percent / 100)
    rows = rest.join(_shared_values(rest, "items"), "rid").withColumn("e", F.size("shared").cast("long"))
    listed = common.checkpointed(
        rows.withColumn("take", _rarest("shared", need, F.col("n"))).where("take > 0")
        .select(F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("i", "x"), "fp", "cid", "n", "e", "component")
        .select("x.v", "fp", "cid", "n", (F.col("e") - F.col("i")).alias("left"), "component"))
    side = lambda x: listed.select("v", *[F.col(c).alias(f"{k}{x}") for c, k in
                                          (("fp", "f"), ("cid", "c"), ("n", "n"), ("left", "l"), ("component", "k"))])
    most = F.least("la", "lb")              # bounds the overlap of a pair that meets here for the first time
    return (side("a").join(side("b"), "v")
            .where((F.col("fa") < F.col("fb")) & (F.col("ka") != F.col("kb"))
                   & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
                   & (100 * most >= percent * (F.col("na") + F.col("nb") - most)))
            .select("fa", "ca", "na", "fb", "cb", "nb").distinct())


def near_duplicates(docs: DataFrame, n: int = STAGE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    linked = "n > 0 AND doc_id IS NOT NULL"
    # sketches are kept once per class; the documents' fingerprints are taken again at the end, which costs less
    # than holding every document's sketch
    classes = common.checkpointed(sketches(docs, n).where(linked).groupBy("fp").agg(
        F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .withColumn("rid", F.monotonically_increasing_id()))                    # a short name for a class
    lists = common.checkpointed(_lists(classes, percent))
    # round one: every member with its list's hub
    hubs = lists.groupBy("v").agg(F.max(F.struct("hub", (-F.col("cid")).alias("order"), "fp")).alias("p"))
    star = (lists.join(hubs, "v").where("fp != p.fp")
            .select(F.least("fp", "p.fp").alias("fa"), F.greatest("fp", "p.fp").alias("fb")).distinct())
    likely = common.checkpointed(_likely(star, classes, percent))
    ids = likely.select(F.col("ca").alias("doc_id")).union(likely.select(F.col("cb").alias("doc_id")))
    found = common.checkpointed(_verified(likely, common.checkpointed(_sets_of(docs, ids, n)), percent))
    del star, likely, ids, hubs
    # round two: what a list still holds in different components
    now = lists.join(common.components(found).withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    split = now.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    # a class with a similar one elsewhere shares that many pairs with it, each in a list of several components
    mixed = common.checkpointed(now.join(split.select("v"), "v").groupBy("fp", "cid", "component", "need")
                                .agg(F.count("*").alias("times")).where("times >= need").select("fp", "cid", "component")
                                .withColumn("rid", F.monotonically_increasing_id()))
    sets = common.checkpointed(_sets_of(docs, mixed.select(F.col("cid").alias("doc_id")), n))
    rest = mixed.join(sets, "fp").withColumn("n", F.size("items").cast("long"))
    links = found.union(_verified(common.checkpointed(_across(rest, percent)), sets, percent))
    links = common.checkpointed(links)
    names = classes.select("fp", "cid")
    del rest, sets, mixed, now, lists
    rows = common.checkpointed(sketches(docs, n).select("doc_id", "n", "fp"))
    linked = rows.where(linked)
    # rows of one doc_id are one document: its classes are linked through it
    same = (linked.select("doc_id", "fp").join(names, "fp").where("doc_id != cid")
            .select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
            .join(linked.groupBy(F.col("doc_id").alias("a")).agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                  .where("lo != hi").select("a"), "a", "left_semi"))
    group = common.components(links.union(same))
    cls = (names.join(group.withColumnRenamed("node", "cid"), "cid", "left")
           .select("fp", F.coalesce("component", "cid").alias("component")))
    own = linked.select("doc_id", "n", "fp").join(cls, "fp").select("doc_id", "n", "component")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    return own.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def _named(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with a column that names the (doc_id, text) of a row, and (name, doc_id) of the rows whose ``doc_id``
    stands with other texts too (None without such rows): their name is a 64-bit hash, otherwise it is ``doc_id``."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key, flag = common.fresh(docs, "shared_id"), common.fresh(docs, "shared_maybe")
    shared = common.checkpointed(docs.where(doc_id.isNotNull()).groupBy(doc_id.alias(key))
                                 .agg(F.min(F.xxhash64(text)).alias("lo"), F.max(F.xxhash64(text)).alias("hi"))
                                 .where("lo != hi").select(key))
    if shared.isEmpty():
        return docs.withColumn(name, doc_id), None
    flagged = docs.withColumn(flag, common.may_hold(shared)(doc_id))
    part = (flagged.where(flag).join(shared.hint("shuffle_hash"), doc_id == F.col(key), "left")
            .withColumn(name, F.when(F.col(key).isNotNull(), F.xxhash64(doc_id, text)).otherwise(doc_id)))
    ids = part.where(F.col(key).isNotNull()).select(name, F.col(key).alias("first_id")).distinct()
    whole = flagged.where(f"NOT {flag}").withColumn(name, doc_id)
    return part.select(*docs.columns, name).union(whole.select(*docs.columns, name)), ids


def dedupe(docs: DataFrame, n: int = STAGE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but one row of each near-duplicate group (the smallest ``doc_id`` stays). Rows are one
    document if they share ``doc_id`` and text; rows that share only ``doc_id`` go only as near-duplicates."""
    name = common.fresh(docs, "document_name")
    named, shared = _named(docs, name)
    key = common.fresh(named, "document_key")
    found = common.checkpointed(near_duplicates(named.select(F.col(name).alias("doc_id"), "text"), n, percent)
                                .where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key))
                                .agg(F.min("component_id").alias("component"), F.min("kept").alias("kept"),
                                     F.count("*").alias("times")))
    if shared is not None:                      # names are not in the order of doc_id there
        first = (found.join(shared.withColumnRenamed(name, key), key, "left").groupBy("component")
                 .agg(F.min(F.struct(F.coalesce("first_id", key).alias("first_id"), key)).alias("least"))
                 .select(F.col(f"least.{key}").alias(key), F.lit(True).alias("least")))
        found = common.checkpointed(found.join(first, key, "left").select(
            key, F.coalesce("least", F.lit(False)).alias("kept"), "times"))
    on = F.col(name) == F.col(key)
    drop = common.checkpointed(found.where("NOT kept OR times > 1").select(key))
    flag, maybe = common.fresh(named, "document_maybe"), common.may_hold(drop)
    flagged = named.withColumn(flag, maybe(F.col(name)))
    # documents that surely stay are not shuffled
    once = (flagged.where(f"NOT {flag}").drop(flag)
            .union(flagged.where(flag).drop(flag).join(drop.hint("shuffle_hash"), on, "left_anti"))).drop(name)
    again = named.join(found.where("kept AND times > 1").select(key), on, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return once.union(again.groupBy(name).agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias(key)).select(f"{key}.*"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"), n=2)


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) = 0 THEN []::VARCHAR[] WHEN len(x) = 1 THEN x
        ELSE list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1]) END) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * inter >= {PERCENT} * (ca.n + cb.n - inter)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS z FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.z = u.a)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.z AS component_id, w.doc_id = m.z AS kept
FROM w LEFT JOIN c USING (doc_id) JOIN (SELECT a, min(z) AS z FROM r GROUP BY a) m ON m.a = w.doc_id"""
