"""Byte-level BPE encoding and decoding over Arrow batches with the ``tokenizers`` library.

The vocabulary is a rank file (base64 token and rank per line); its path is a parameter. The driver reads it once,
maps every byte to its printable character as byte-level BPE does, recovers the merge that forms each token from
the ranks, and ships the resulting tokenizer (bounded by the vocabulary) to the tasks.

Encoding. The pre-tokenizing pattern never joins a single space to what stands before it, so a text may be cut
before every space that follows a non-space character, and the pieces encoded on their own give the ids of the
whole text. Each batch encodes its distinct pieces once with the library and keeps a bounded cache of them.
Offsets come from the byte length of each token and a byte-to-character map of the text; a token that holds part of
a character reports that character.

Decoding looks the ids up in the reversed byte table and joins the bytes, so a character split over tokens is whole
again; ``text`` replaces bytes that form no character.

Defined cases: null text is empty and has no ids; null ids decode to nothing; rows repeat as they come in; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

CACHE_PIECES = 200_000      # cached pieces per generation in a Python worker
CACHE_CHARS = 48            # longer pieces are not kept
PIPELINE_PIECES = 40_000    # the same in the pipeline, whose JVMs have grown over four stages before
ENCODE_PIECES = 1 << 13     # pieces the library encodes at a time: its results are far larger than the ids taken from them
DECODE_IDS = 1 << 16        # ids turned into bytes at a time
_CUT = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")


def byte_characters() -> list[str]:
    """Printable character of each byte: itself if printable Latin-1, else the next free one from 256 on."""
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


def load_ranks(path: str) -> list[bytes]:
    """Tokens in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def _last_merge(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts whose merge forms ``token``: merge the lowest-ranked neighbours until two are left."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], len(rank)))
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def tokenizer_json(tokens: list[bytes]) -> str:
    """A ``tokenizers`` file of the ranks, with the byte-level pattern and without special tokens."""
    char = byte_characters()
    shown = ["".join(char[b] for b in t) for t in tokens]
    rank = {t: i for i, t in enumerate(tokens)}
    merges = []
    for t in tokens:
        if len(t) > 1:
            a, b = _last_merge(t, rank)
            merges.append(["".join(char[x] for x in a), "".join(char[x] for x in b)])
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": level, "post_processor": None, "decoder": level,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                  "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                  "vocab": {s: i for i, s in enumerate(shown)}, "merges": merges}})


def id_bytes(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class Encoder:
    """Encodes texts in one Python worker. ``made`` turns the ids of a piece into the value that is kept for it."""

    def __init__(self, spec: str, made=id_bytes, keep: int | None = None):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.made, self.keep, self.young, self.old = made, keep or CACHE_PIECES, {}, {}

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; all but the first stand for a space and themselves."""
        return _CUT.split(text) if _RUN.search(text) else text.split(" ")

    def _made(self, pieces: list[str]) -> list:
        out = []
        for a in range(0, len(pieces), ENCODE_PIECES):
            got = self.tokenizer.encode_batch_fast(pieces[a:a + ENCODE_PIECES], add_special_tokens=False)
            out += [self.made(e.ids) for e in got]
        return out

    def values(self, texts: list[str | None]):
        """(pieces of each text, values of first pieces, values of the other pieces).

        The cache has two generations of up to ``keep`` pieces of up to CACHE_CHARS characters. A piece that is met
        again moves to the young one; when that is full it becomes the old one, and what was left in the old one goes.
        """
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        cut = [self._pieces(t) if t else [] for t in texts]
        new, long = set(), {}
        for p in cut:
            new.update(p[1:])
        new.difference_update(young)
        for x in new.intersection(old):
            young[x] = old.pop(x)
        new = list(new.difference(young))
        heads = list({p[0] for p in cut if p})
        made = self._made([" " + x for x in new] + heads)
        for x, v in zip(new, made):
            (young if len(x) <= CACHE_CHARS else long)[x] = v
        return cut, dict(zip(heads, made[len(new):])), _Both(young, long) if long else young

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut, first, rest = self.values(texts)
        return [np.frombuffer(first[p[0]] + b"".join(map(rest.__getitem__, p[1:])) if p else b"", np.int32) for p in cut]


class _Both:
    def __init__(self, a, b):
        self.a, self.b = a, b

    def __getitem__(self, key):
        found = self.a.get(key)
        return self.b[key] if found is None else found


def parts_of(text: str, limit: int = textkit.CHUNK_BYTES):
    """A text in parts of about ``limit`` characters, cut before spaces that follow other characters."""
    a = 0
    while len(text) - a > limit:
        cut = _CUT.search(text, a + limit)
        if not cut:
            break
        yield text[a:cut.start()]
        a = cut.start()
    yield text[a:]


def as_texts(col: pa.Array) -> list[str | None]:
    """Python strings of a string column; bytes that are not UTF-8 become the replacement character."""
    try:
        return col.to_pylist()
    except UnicodeDecodeError:
        return [x if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.large_binary()).to_pylist()]


def lists(arrays: list[np.ndarray], kind=pa.int32()) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]) if arrays else np.zeros(1)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def character_offsets(text: str, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) characters of each token; ``size`` is the byte length per id."""
    begins = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(begins)])              # characters begun before each byte
    end = np.cumsum(size[ids])
    start = end - size[ids]
    return (upto[start + 1] - 1).astype(np.int32), upto[end].astype(np.int32)


_MEMO: dict = {}


def worker_encoder(spec: str, kind: str = "ids", made=id_bytes, keep: int | None = None) -> Encoder:
    """One encoder per Python worker, vocabulary and kind of value."""
    key = (hash(spec), kind, keep)
    if key not in _MEMO:
        _MEMO[key] = Encoder(spec, made, keep)
    return _MEMO[key]


def encode(docs: DataFrame, vocabulary: str, offsets: bool = False) -> DataFrame:
    """(doc_id, ids array<int>[, starts, ends array<int>]) of every whole text."""
    tokens = load_ranks(vocabulary)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokens))
    size = np.array([len(t) for t in tokens], np.int64)

    def run(batches):
        enc = worker_encoder(spec.value)
        for b in batches:
            for first, _, off in textkit.chunks(b.column("text")):
                part = b.slice(first, len(off) - 1)
                texts = as_texts(part.column("text"))
                ids = enc.encode(texts)
                cols, names = [part.column("doc_id"), lists(ids)], ["doc_id", "ids"]
                if offsets:
                    at = [character_offsets(t or "", i, size) for t, i in zip(texts, ids)]
                    cols += [lists([x for x, _ in at]), lists([y for _, y in at])]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, text: bool = False) -> DataFrame:
    """(doc_id, ids, decoded binary[, text string]) of the id lists."""
    table = load_ranks(vocabulary)

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            a, n, held = 0, len(ids), 0
            sizes = ids.value_lengths().fill_null(0).to_numpy()
            for i in range(n):
                held += sizes[i]
                if held > 1 << 20 or i == n - 1:
                    part = b.slice(a, i + 1 - a)
                    out = [b"".join(map(table.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist()))
                           if x.is_valid else b"" for x in part.column("ids")]
                    cols = [part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())]
                    if text:
                        cols.append(pa.array([x.decode("utf-8", "replace") for x in out], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded", "text"][:len(cols)])
                    a, held = i + 1, 0

    schema = "doc_id long, ids array<int>, decoded binary" + (", text string" if text else "")
    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def encode_decoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded_sha256): ``encode`` and the digest of ``decode`` in one step, so a task
    needs one Python worker and ids cross to the JVM once. A null text has no ids and the digest of no bytes."""
    tokens = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json(tokens), tokens))

    def run(batches):
        common.release()                                    # what an earlier stage left in this worker
        spec, table = shared.value
        enc = worker_encoder(spec, keep=PIPELINE_PIECES)
        for b in batches:
            for first, _, off in textkit.chunks(b.column("text")):
                part = b.slice(first, len(off) - 1)
                ids = enc.encode(as_texts(part.column("text")))
                digest = []
                for x in ids:
                    decoded = hashlib.sha256()
                    for a in range(0, len(x), DECODE_IDS):
                        decoded.update(b"".join(map(table.__getitem__, x[a:a + DECODE_IDS].tolist())))
                    digest.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), lists(ids), pa.array(digest, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"])
        common.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256.

    One step per batch: every distinct piece is encoded, its ids written as text and looked up in the byte table once;
    a document's digests run over the texts and bytes of its pieces. Ids never leave the worker, and a text of any
    length is taken in parts.
    """
    tokens = load_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json(tokens), tokens))

    def run(batches):
        spec, table = shared.value
        shown = [f" {i}".encode() for i in range(len(table))]
        enc = worker_encoder(spec, "digest", lambda ids: (b"".join([shown[i] for i in ids]), b"".join([table[i] for i in ids])))
        for b in batches:
            for first, _, off in textkit.chunks(b.column("text")):
                part = b.slice(first, len(off) - 1)
                counts, hashes, bytes_ = [], [], []
                texts = as_texts(part.column("text"))
                small = [t if t and len(t) <= textkit.CHUNK_BYTES else None for t in texts]
                cut, heads, rest = enc.values(small)
                for t, p in zip(texts, cut):
                    ids, decoded, n, started = hashlib.sha256(), hashlib.sha256(), 0, False
                    runs = [(p, heads, rest)] if p or not t else ((q[0], h, r) for q, h, r in (enc.values([x]) for x in parts_of(t)))
                    for pieces, h, r in runs:
                        if not pieces:
                            continue
                        text, raw = zip(h[pieces[0]], *map(r.__getitem__, pieces[1:]))
                        text = b"".join(text)
                        n += text.count(b" ")
                        ids.update(text if started or not text else text[1:])
                        started = started or bool(text)
                        decoded.update(b"".join(raw))
                    counts.append(n)
                    hashes.append(ids.hexdigest())
                    bytes_.append(decoded.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(bytes_)],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"), default_vocabulary())
