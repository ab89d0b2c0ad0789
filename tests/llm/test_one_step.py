"""Stages that spare a Python worker or a shuffle give what the plainer forms give."""

import hashlib

import pytest
from pyspark.sql import functions as F

import cases
from athlos.llm import bpe, line_dedup, quality_rules


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


def test_encode_decoded_equals_the_two_steps(docs, spark):
    vocabulary = bpe.default_vocabulary()
    two = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
    want = sorted((repr(r["doc_id"]), r["ids"], hashlib.sha256(bytes(r["decoded"])).hexdigest()) for r in two.collect())
    got = bpe.encode_decoded(docs, vocabulary).collect()
    assert sorted((repr(r["doc_id"]), r["ids"], r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode_decoded(docs.limit(0), vocabulary).count() == 0


def test_decoding_in_parts(spark, monkeypatch):
    text = "a 漢字 b " * 20_000                # over one part of ids
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = bpe.encode_decoded(docs, bpe.default_vocabulary()).first()
    assert r["n_tokens"] > bpe.DECODE_IDS and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_uncut_equals_cut_without_lines(spark):
    texts = [None, "", "\n", "one", "one\ntwo", "\n\né漢\n", "x\r\ny\n"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(1)
    cut = F.arrow_udf(line_dedup._cut, "struct<n_lines:bigint,n_removed:bigint,kept:string>")
    for r in rows.select(line_dedup._uncut(F.col("text")).alias("a"), cut("text", F.lit(None).cast("array<int>")).alias("b")).collect():
        assert r["a"] == r["b"]


def test_quality_fences_join_either_way(docs, monkeypatch):
    want = sorted(map(repr, quality_rules.keep(docs).collect()))
    plan = quality_rules.keep(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(quality_rules, "FENCE_BYTES", 0)
    assert sorted(map(repr, quality_rules.keep(docs).collect())) == want


def test_quality_takes_a_very_long_text(spark):
    line = "The committee met again in spring and wrote down what it had seen so far, item {}.\n"
    text = "".join(line.format(i) for i in range(240_000))
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = quality_rules.score(docs).first()
    assert r["n_words"] == len(text.split()) and r["n_dup_lines"] == 0
