"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only).

Every document goes to one of ``shards`` shards; counts differ by at most one (law ``rows``) and the arrangement is a
uniformly random permutation, fixed by ``seed``.

1. The narrow rows (id, size, checksum) are checkpointed with the source partition they lie in and their place in it,
   so later passes see the same partitions even after lost executors. Long partitions are cut into blocks.
2. The communication matrix says how many rows of each block go to each shard. It is drawn from the multivariate
   hypergeometric law with these margins: a tree over the blocks hands each node's shard counts to its children
   (at most ``FAN`` each), one univariate hypergeometric draw per child and shard. A draw is a rejection sampler
   (ratio of uniforms, with Stirling's series for the log factorials), written as a SQL expression with uniforms from a
   seeded hash. The tree has a row per node and one level per factor ``FAN``.
3. Within a block the rows are permuted by a seeded hash, and the first m_0 go to shard 0, the next m_1 to shard 1, ...
4. After the exchange the rows of a shard are permuted again: a second seeded hash deals them to buckets, the bucket
   counts give each bucket its first slot, and the order of a third hash gives the slot. No task holds a whole shard.

Defined cases: null text has size 1 and the checksum of the empty string; repeated rows are placed one by one; null ids are
kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS = 16
SEED = 20240613
BLOCK_ROWS = 1 << 16        # rows of a source partition that are permuted together
FAN = 16                    # children of a node of the tree over the blocks
TRIES = 200                 # bound of the rejection loop; each try is accepted with probability over 0.5
SLOT_ROWS = 1 << 15         # rows aimed at in a bucket of the last permutation


def _uniform(*key: str) -> str:
    """Uniform double in (0, 1) from a seeded hash."""
    return f"((shiftrightunsigned(xxhash64({', '.join(key)}), 11) + 0.5D) / 9007199254740992D)"


def _log_factorial(x: str) -> str:
    """ln(x!) by Stirling's series, after lifting small x by 8."""
    z = f"({x} + 9D)"
    lifted = " + ".join(f"ln({x} + {k}D)" for k in range(1, 9))
    return (f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * {z} * {z} * {z})"
            f" - ({lifted}))")


def _draw(good: str, total: str, sample: str, *key: str) -> str:
    """SQL of a hypergeometric draw: how many of ``sample`` rows out of ``total`` are among ``good`` marked ones.

    Ratio of uniforms around the mean with the exact mass ratio to the mode; the hat is Stadlober's. Certain
    results (nothing marked, all marked, nothing or everything drawn) need no draw.
    """
    g, n, s = f"CAST({good} AS DOUBLE)", f"CAST({total} AS DOUBLE)", f"CAST({sample} AS DOUBLE)"
    mode = f"floor(({s} + 1D) * ({g} + 1D) / ({n} + 2D))"
    var = f"({s} * {g} / {n} * (1D - {g} / {n}) * ({n} - {s}) / greatest({n} - 1D, 1D) + 0.5D)"
    weight = lambda k: (f"({_log_factorial(k)} + {_log_factorial(f'({g} - {k})')} + {_log_factorial(f'({s} - {k})')}"  # noqa: E731
                        f" + {_log_factorial(f'({n} - {g} - {s} + {k})')})")
    u, v = _uniform(*key, "j", "1"), _uniform(*key, "j", "2")
    return f"""CASE WHEN {good} = 0 OR {sample} = 0 THEN 0L WHEN {good} = {total} THEN {sample} WHEN {sample} = {total} THEN {good}
      ELSE aggregate(array(named_struct('mode', {mode}, 'c', {s} * {g} / {n} + 0.5D, 'h', 1.7155277699214135D * sqrt({var}) + 0.8989161620588988D)),
        0L, (acc0, p) -> coalesce(aggregate(sequence(1, {TRIES}), CAST(NULL AS BIGINT), (acc, j) -> coalesce(acc,
          aggregate(array(floor(p.c + p.h * ({v} - 0.5D) / {u})), CAST(NULL AS BIGINT), (acc2, k) ->
            CASE WHEN k < greatest(0D, {s} + {g} - {n}) OR k > least({s}, {g}) THEN NULL
                 WHEN 2D * ln({u}) <= {weight('p.mode')} - {weight('CAST(k AS DOUBLE)')} THEN CAST(k AS BIGINT) END))),
          CAST(p.mode AS BIGINT))) END"""


def _hand_down(shards: int, seed: int) -> Column:
    """Array over children of their shard counts: ``caps`` dealt to children of ``sizes`` rows, child by child."""
    draw = _draw("g.cap", "(s.left - s.seen)", "s.want", str(seed), "node", "level", "c.i", "g.i")
    inner = f"""aggregate(transform(st.caps, (cap, i) -> named_struct('cap', cap, 'i', i)),
        named_struct('left', st.total, 'seen', 0L, 'want', c.n, 'got', CAST(array() AS ARRAY<BIGINT>)),
        (s, g) -> aggregate(array({draw}), s, (s2, d) -> named_struct('left', s.left, 'seen', s.seen + g.cap,
            'want', s.want - d, 'got', concat(s.got, array(d)))),
        s -> s.got)"""
    return F.expr(f"""aggregate(transform(sizes, (n, i) -> named_struct('n', n, 'i', i)),
        named_struct('caps', caps, 'total', aggregate(caps, 0L, (a, b) -> a + b), 'out', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
        (st, c) -> aggregate(array({inner}), st, (st2, got) -> named_struct(
            'caps', transform(st.caps, (x, i) -> x - got[i]), 'total', st.total - c.n, 'out', concat(st.out, array(got)))),
        st -> st.out)""")


def communication_matrix(blocks: DataFrame, total: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(block, counts array<long>): rows of each block bound for each shard. ``blocks``: (block long, n long)."""
    numbered = common.checkpointed(blocks.select(
        "block", "n", (F.row_number().over(W.orderBy("block")) - 1).cast("long").alias("ord")))
    count = numbered.count()
    levels = 0
    while FAN ** levels < count:
        levels += 1
    caps = F.expr(f"transform(sequence(0, {shards - 1}), i -> CAST({total // shards} + IF(i < {total % shards}, 1, 0) AS BIGINT))")
    nodes = blocks.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), caps.alias("caps"))
    for level in range(levels):
        width = FAN ** (levels - level - 1)                  # blocks below each child
        child = (numbered.groupBy(F.expr(f"ord div {width}").alias("child")).agg(F.sum("n").alias("n"))
                 .groupBy(F.expr(f"child div {FAN}").alias("node"))
                 .agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("kids")))      # at most FAN
        nodes = (nodes.join(child, "node")
                 .select("node", "caps", "kids", F.col("kids.n").alias("sizes"), F.lit(level).alias("level"))
                 .select("kids", _hand_down(shards, seed).alias("dealt"))
                 .select(F.explode(F.arrays_zip(F.col("kids.child").alias("child"), F.col("dealt").alias("dealt"))).alias("x"))
                 .select(F.col("x.child").alias("node"), F.col("x.dealt").alias("caps")))
        nodes = common.checkpointed(nodes)
    return numbered.join(nodes, numbered.ord == nodes.node).select("block", F.col("caps").alias("counts"))


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("place")))
    block = F.shiftright("place", 33) * (1 << 20) + F.shiftright(F.col("place").bitwiseAND((1 << 33) - 1), 16)
    rows = rows.withColumn("block", block)
    total = rows.count()
    matrix = communication_matrix(rows.groupBy("block").agg(F.count("*").alias("n")), total, shards, seed)
    ends = F.expr("transform(sequence(1, size(counts)), k -> aggregate(slice(counts, 1, k), 0L, (a, b) -> a + b))")
    first = F.row_number().over(W.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("first"), "place"), "place"))
    dealt = (rows.withColumn("rank", first).join(matrix.select("block", ends.alias("ends")), "block")
             .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
             .drop("ends", "rank", "block"))
    buckets = max(1, total // shards // SLOT_ROWS)
    dealt = common.checkpointed(dealt.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), "place"), F.lit(buckets)).cast("int")))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    last = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(
        F.xxhash64(F.lit(seed), F.lit("last"), "place"), "place"))
    return (dealt.withColumn("rank", last).join(offsets, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle(common.read(spark, sf_dir, "documents"))
