"""Token counts from flat token files by separator scan.

A flat token file is a run of fixed-width ids in which an end-of-document id closes each document, without an index.
Spark holds it as a block table (file, block, payload): fixed-size cuts of the run, made without regard to documents.

1. Each block is scanned on its own: one vectorised comparison finds the separators, and gaps between them are the
   lengths of the documents that lie inside. A block reports its length, its separators, the tokens before the first
   and after the last.
2. A prefix scan over the blocks of a file stitches the boundaries: how many documents and tokens came before, and
   where the last separator stood. It runs in two levels (spans of ``SPAN`` blocks, then blocks within a span), so one
   long file does not become one long task.
3. Each separator then gives one document: its place in the file and its token count.

Defined cases: null text is an empty document (0 tokens); repeated rows are documents of their own; a run without a
final separator ends with an open document, reported if it has tokens; blocks without separators carry over; empty
tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import bpe, common, textkit

BLOCK_TOKENS = 1 << 16
SPAN = 1024
END = 50256                 # free id after the 50,256 ranks
_BLOCKS = "file long, block long, payload binary, doc_ids array<long>"


def write_token_files(docs: DataFrame, vocabulary: str, path: str, end: int = END) -> None:
    """Encode ``docs`` and write one flat token run per input partition as a block table.

    Sidecar rows (``payload`` null) keep the ``doc_id`` order of a run for ``name_documents``; the scan never
    reads them.
    """
    tokens = bpe.load_ranks(vocabulary)
    spec = docs.sparkSession.sparkContext.broadcast(bpe.tokenizer_json(tokens))
    kind = token_type(max(len(tokens), end + 1))

    def run(batches):
        from pyspark import TaskContext
        file = TaskContext.get().partitionId()
        enc, held, count, block, side = bpe.worker_encoder(spec.value), [], 0, 0, 0

        def row(number, payload, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([payload], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64()))], names=["file", "block", "payload", "doc_ids"])

        for b in batches:
            for first, _, off in textkit.chunks(b.column("text")):
                part = b.slice(first, len(off) - 1)
                for ids in enc.encode(bpe.as_texts(part.column("text"))):
                    held += [ids.astype(kind), np.array([end], kind)]
                    count += len(ids) + 1
                yield row(side, None, part.column("doc_id").to_pylist())
                side += 1
                flat = np.concatenate(held)
                cut = count - count % BLOCK_TOKENS
                for k in range(0, cut, BLOCK_TOKENS):
                    yield row(block, flat[k:k + BLOCK_TOKENS].tobytes(), None)
                    block += 1
                held, count = [flat[cut:]], count - cut
        if count:
            yield row(block, np.concatenate(held).tobytes(), None)

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(path))


def token_type(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def blocks_of_files(spark: SparkSession, path: str, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Block table of raw binary token files (each read as one row, so up to Spark's 2 GB per file)."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content")
    size = block_tokens * width
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(length(content) - 1) div {size}"))))
    return files.select("file", "content", cuts.alias("block")).select(
        "file", "block", F.expr(f"substring(content, CAST(block * {size} + 1 AS INT), {size})").alias("payload"))


def _summaries(blocks: DataFrame, end: int, kind: np.dtype) -> DataFrame:
    def run(batches):
        for b in batches:
            n, seps, head, tail, gaps = [], [], [], [], []
            for p in b.column("payload"):
                run_ids = np.frombuffer(p.as_buffer(), kind) if p.is_valid and len(p.as_buffer()) else np.zeros(0, kind)
                at = np.flatnonzero(run_ids == end)
                n.append(len(run_ids))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else None)
                tail.append(len(run_ids) - 1 - int(at[-1]) if len(at) else None)
                gaps.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(seps, pa.int64()),
                 pa.array(head, pa.int64()), pa.array(tail, pa.int64()), bpe.lists(gaps, pa.int64())],
                names=["file", "block", "n", "seps", "head", "tail", "gaps"])

    return blocks.select("file", "block", "payload").mapInArrow(
        run, "file long, block long, n long, seps long, head long, tail long, gaps array<long>")


def count_tokens(blocks: DataFrame, end: int = END, kind: np.dtype = token_type(END + 1)) -> DataFrame:
    """(file, place, n_tokens, closed): one row per document of the runs, ``place`` counting from 0 in each file."""
    rows = common.checkpointed(_summaries(blocks, end, kind).withColumn("span", F.expr(f"block div {SPAN}")))
    # open tokens after a stretch of blocks: those since its last separator, or all of them
    since = lambda w: F.sum("n").over(w) - F.coalesce(F.max("closed_at").over(w), F.lit(0))
    # first level: spans of a file
    inner = W.partitionBy("file", "span").orderBy("block")
    ends = F.when(F.col("seps") > 0, F.sum("n").over(inner) - F.col("tail"))
    spans = (rows.select("file", "span", "n", "seps", ends.alias("closed_at"))
             .groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("closed_at").alias("in_span")))
    outer = W.partitionBy("file").orderBy("span")
    spans = spans.withColumn("closed_at", F.sum("n").over(outer) - F.col("n") + F.col("in_span"))
    upto = outer.rowsBetween(W.unboundedPreceding, -1)
    base = spans.select("file", "span", F.coalesce(F.sum("seps").over(upto), F.lit(0)).alias("docs_before"),
                        F.coalesce(since(upto), F.lit(0)).alias("open_before"))
    # second level: blocks of a span
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    local = (rows.withColumn("closed_at", ends)
             .withColumn("docs_here", F.coalesce(F.sum("seps").over(before), F.lit(0)))
             .withColumn("open_here", F.coalesce(since(before), F.lit(0)))
             .withColumn("cut_here", F.max("closed_at").over(before).isNotNull()))
    stitched = local.join(base, ["file", "span"]).select(
        "file", "block", "n", "seps", "head", "tail", "gaps", (F.col("docs_before") + F.col("docs_here")).alias("first"),
        F.when(F.col("cut_here"), F.col("open_here")).otherwise(F.col("open_before") + F.col("open_here")).alias("open"))
    stitched = common.checkpointed(stitched)
    closed = (stitched.where("seps > 0")
              .select("file", "first", F.posexplode(F.concat(F.array(F.col("open") + F.col("head")), F.col("gaps"))))
              .select("file", (F.col("first") + F.col("pos")).alias("place"), F.col("col").alias("n_tokens"),
                      F.lit(True).alias("closed")))
    last = stitched.groupBy("file").agg(F.max_by(F.struct("seps", "tail", "open", "n", "first"), "block").alias("x"))
    rest = last.select("file", (F.col("x.first") + F.col("x.seps")).alias("place"),
                       F.when(F.col("x.seps") > 0, F.col("x.tail")).otherwise(F.col("x.open") + F.col("x.n")).alias("n_tokens"),
                       F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.union(rest)


def name_documents(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, file, place, n_tokens) by the sidecar rows of ``write_token_files``."""
    side = table.where("payload IS NULL").select("file", "block", "doc_ids")
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(w), F.lit(0))
    offsets = side.select("file", "block", F.size("doc_ids").cast("long").alias("size")).select(
        "file", "block", start.alias("start"))
    names = (side.join(offsets, ["file", "block"]).select("file", "start", F.posexplode("doc_ids"))
             .select("file", (F.col("start") + F.col("pos")).alias("place"), F.col("col").alias("doc_id")))
    return names.join(counts, ["file", "place"]).select("doc_id", "file", "place", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, bpe.default_vocabulary(), path)
    table = spark.read.parquet(path)
    return name_documents(table, count_tokens(table.where("payload IS NOT NULL")))
