"""The pipeline against a brute-force version, and the SQL of the registered queries."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from athlos.llm import bpe, common, quality_rules, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept").fetchall()}
    rows = [r for r in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if r[0] in good]
    left = cases.kept_lines(rows, lambda d: d[0])
    rows = [(d, left[(d, t)]) for d, t in rows if left[(d, t)] == t or left[(d, t)].strip()]
    group = cases.groups(rows, 5)
    rows = [r for r in rows if group[r[0]] == r[0]]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    rows = [r for r in rows if not cases.word_hits(r[1], items)[1]]
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == [d for d, _ in rows]
    tokens = bpe.load_ranks(bpe.default_vocabulary())
    texts = {r["doc_id"]: b"".join(tokens[i] for i in r["ids"]).decode() for r in out}
    assert texts == dict(rows)


def test_stages_take_empty_and_awkward_documents(spark):
    docs = common.checkpointed(cases.documents(spark))
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            if name != "byte_bpe":
                assert out.columns == docs.columns
            out = common.checkpointed(out)
            assert name == "byte_bpe" or out.count() <= d.count()
            d = out
            if name == "byte_bpe":
                break


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
