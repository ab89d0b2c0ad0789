"""The encoder hands the library a bounded number of pieces at a time and keeps no more than it is told to."""

import numpy as np

from athlos.llm import bpe


class Counting:
    def __init__(self, inner):
        self.inner, self.most = inner, 0

    def encode_batch_fast(self, pieces, **kw):
        self.most = max(self.most, len(pieces))
        return self.inner.encode_batch_fast(pieces, **kw)


def test_pieces_are_encoded_in_bounded_steps_with_the_same_ids(monkeypatch):
    spec = bpe.tokenizer_json(bpe.load_ranks(bpe.default_vocabulary()))
    texts = [" ".join(f"w{i * 7 + k}é" for k in range(300)) for i in range(20)] + ["", None, "  two  spaces ", "x" * 500]
    whole = bpe.Encoder(spec).encode(texts)
    monkeypatch.setattr(bpe, "ENCODE_PIECES", 64)
    small = bpe.Encoder(spec, keep=100)
    small.tokenizer = Counting(small.tokenizer)
    for _ in range(2):
        for t, ids in zip(texts, whole):
            assert np.array_equal(small.encode([t])[0], ids)
            assert len(small.young) <= 100 + 300 and len(small.old) <= 100 + 300
    assert np.array_equal(np.concatenate(small.encode(texts)), np.concatenate(whole))
    assert 0 < small.tokenizer.most <= 64


def test_the_pipeline_keeps_fewer_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", {})
    spec = bpe.tokenizer_json(bpe.load_ranks(bpe.default_vocabulary()))
    assert bpe.worker_encoder(spec, keep=bpe.PIPELINE_PIECES).keep == bpe.PIPELINE_PIECES < bpe.worker_encoder(spec).keep
