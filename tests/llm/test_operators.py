"""Each operator against a brute-force version, on awkward documents and on empty tables."""

import hashlib
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import cases  # noqa: E402

from athlos.llm import (bpe, chat, classifier, common, line_dedup, minhash, quality_rules, sharding,  # noqa: E402
                        suffix_dedup, token_counts, wumanber)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    common.bound_batches(spark)
    return common.checkpointed(cases.documents(spark))


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 1 line dedup

def test_edit_distance_band():
    import random
    r = random.Random(4)
    for _ in range(3000):
        a = bytes(r.choices(b"abc", k=r.randint(0, 14)))
        b = bytearray(a)
        for _ in range(r.randint(0, 4)):
            k = r.randint(0, len(b))
            b[k:k + r.randint(0, 1)] = bytes(r.choices(b"abc", k=r.randint(0, 1)))
        for most in (1, 2, 3):
            assert line_dedup.within(a, bytes(b), most) == (cases.edits(a, bytes(b)) <= most)


def test_line_dedup_matches_all_pairs(docs, rows, empty):
    keys = {(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    want = cases.kept_lines(rows, lambda d: (d[0] is not None, d[0] or 0, keys[d]))
    got = line_dedup.dedupe_lines(docs).collect()
    assert len(got) == len(rows)
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in got) == sorted(
        (repr(d), want[(d, t)]) for d, t in rows)
    assert any(r["n_removed"] for r in got)
    out = line_dedup.remove(docs)
    assert out.columns == docs.columns
    assert out.where("n_chars != length(text) AND doc_id IS NOT NULL AND doc_id < 100").count() == 0
    assert line_dedup.dedupe_lines(empty).count() == 0


def test_short_exact_copies_go(spark):
    short = "Released under the MIT License."
    assert len(short) == line_dedup.MIN_BYTES - 1
    docs = spark.createDataFrame([(1, f"{short}\n\n  \nOne.\nOnce."), (2, f"Two.\n{short}\n\n  "), (3, "One.\n" + short)],
                                 "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(docs, exact_from=1).collect()}
    assert left == {1: f"{short}\n\n  \nOne.\nOnce.", 2: "Two.\n\n  ", 3: ""}
    assert [r["doc_id"] for r in line_dedup.remove(docs, exact_from=1).orderBy("doc_id").collect()] == [1, 2]


def lines_sharing_an_id(make, count):
    """The first two of ``make(0)``, ``make(1)``, ... of one length whose line ids are equal."""
    texts = [make(k) for k in range(count)]
    off = np.cumsum([0] + [len(t) for t in texts])
    ids = line_dedup.Lines(np.frombuffer("".join(texts).encode(), np.uint8), off).ids()
    order = np.argsort(ids, kind="stable")
    at = np.flatnonzero(ids[order][1:] == ids[order][:-1])[0]
    return [texts[i] for i in sorted(order[at:at + 2])]


def test_different_lines_with_one_id(spark):
    import itertools
    words = ["alpha", "bravo", "cedar", "delta", "eagle", "flint", "grape"]
    orders = list(itertools.permutations(words))
    a, b = lines_sharing_an_id(lambda k: "start " + " ".join(orders[k]) + " the end", len(orders))
    assert cases.edits(a.encode(), b.encode()) > 2
    rows = [(1, a), (2, b), (3, b[:-1] + "D"), (4, b), (5, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedupe_lines(docs).collect()}
    assert left == {1: a, 2: b, 3: "", 4: "", 5: ""}


def test_neighbours_with_one_id(spark):
    def pair(k):                                  # both orders have the same byte pairs and differ in two bytes
        x, y = (("m", "w"), ("w", "m"))[k % 2]
        return f"k{x}z {k // 2:06d} and some more of this line k{y}z"
    texts = [pair(k) for k in range(600_000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids = line_dedup.Lines(data, np.arange(len(texts) + 1) * len(texts[0])).ids()
    k = 2 * int(np.flatnonzero(ids[::2] == ids[1::2])[0])
    docs = spark.createDataFrame([(1, texts[k]), (2, texts[k + 1])], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.dedupe_lines(docs).orderBy("doc_id").collect()] == [texts[k], ""]


# 2 near-dedup

@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_all_pairs(docs, rows, n):
    want = cases.groups(rows, n)
    got = minhash.near_duplicates(docs, n).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    assert len(set(want.values())) < len(want)


def test_dedupe_keeps_one_row_per_group(docs, rows, empty):
    want = cases.groups(rows, 5)
    out = minhash.dedupe(docs)
    assert out.columns == docs.columns
    ids = [r[0] for r in out.select("doc_id").collect()]
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values()))
    assert sum(x is None for x in ids) == sum(d is None for d, _ in rows)
    assert minhash.dedupe(empty).count() == 0


def test_dedupe_keeps_unrelated_texts_of_one_doc_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, b), (7, b), (7, None), (9, b + " more"), (8, c), (5, a + " more"), (8, c + " more"), (8, c)]
    out = minhash.dedupe(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted(((r["doc_id"], r["text"] or "") for r in out if r["doc_id"] != 8))
    assert left == [(5, a + " more"), (7, ""), (7, b)]
    assert [r["text"] in (c, c + " more") for r in out if r["doc_id"] == 8] == [True]


def test_a_chain_of_near_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(60)]
    chain = [(k, " ".join(words[k:k + 40])) for k in range(12)]              # neighbours 0.95, ends below 0.8
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 2).collect()
    assert {r["component_id"] for r in got} == {0}


# 3 tokens

@pytest.fixture(scope="module")
def reference_encoding():
    import public_tokenizers as p
    import tiktoken
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(bpe.default_vocabulary()))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_rank_library_and_round_trips(docs, rows, empty, reference_encoding):
    got = bpe.decode(bpe.encode(docs, bpe.default_vocabulary()), bpe.default_vocabulary(), text=True).collect()
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in got) == sorted(
        (repr(d), reference_encoding.encode_ordinary(t or "")) for d, t in rows)
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in rows)
    assert sorted(r["text"] for r in got) == sorted(t or "" for _, t in rows)
    assert bpe.encode(empty, bpe.default_vocabulary()).count() == 0


def test_bpe_offsets_cover_the_text(spark):
    text = "Aé漢字 😀😀  x\n\n y"
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.default_vocabulary(),
                   offsets=True).first()
    tokens = bpe.load_ranks(bpe.default_vocabulary())
    for i, s, e in zip(r["ids"], r["starts"], r["ends"]):
        piece = text[s:e].encode()
        assert tokens[i] in piece and 0 <= s < e <= len(text)
    assert r["starts"][0] == 0 and r["ends"][-1] == len(text)


def test_pieces_of_random_spacing(reference_encoding):
    import random
    r = random.Random(6)
    parts = [" ", "  ", "\n", "\t", "a", "The", "é", "'s", "12", "!!", "\x1c", "\x85", " ", "😀", "<|endoftext|>"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 20))) for _ in range(3000)]
    enc = bpe.Encoder(bpe.tokenizer_json(bpe.load_ranks(bpe.default_vocabulary())))
    assert [x.tolist() for x in enc.encode(texts)] == [reference_encoding.encode_ordinary(t) for t in texts]


# 4 repeated strings

@pytest.mark.parametrize("hot", [4096, 3])
def test_repeated_strings_match_counts(docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    extra = docs.sparkSession.createDataFrame(
        [(200, "ab" * 300), (201, "b" * 199), (202, "c" * 200), (203, "c" * 200), (204, "é" * 150)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(extra)
    texts = rows + [tuple(r) for r in extra.collect()]
    want = sorted((repr(d), x) for (d, _), x in zip(texts, cases.repeated_bytes([t for _, t in texts])))
    got = suffix_dedup.remove_repeats(every).collect()
    assert sorted((repr(r["doc_id"]), (len(r["body"]), len(r["body"]) - len(r["kept"]), len(r["spans"]),
                                       hashlib.sha256(r["kept"]).hexdigest())) for r in got) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_blind_trie_orders_and_measures():
    import random
    r = random.Random(8)
    strings = [b"shared prefix " * 4 + bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(200)]
    nodes, order = suffix_dedup.BlindTrie(strings).nodes()
    assert [strings[i] for i in order] == sorted(strings)
    for depth, members in nodes:
        assert os.path.commonprefix([strings[i] for i in members]) == strings[members[0]][:depth]


# 5 classifier

def test_classifier_on_held_out_labels(spark):
    base = "/root/testdata/sf0.01"
    labels = common.read(spark, base, "labels").where("quality IS NOT NULL")
    out = classifier.op5_quality_classifier(spark, base).join(labels, "doc_id").toPandas()
    crc = out["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)
    assert (out["held_out"] == crc).all()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() >= 0.95
    assert held[held["quality"] == 0]["score"].median() < 0.1 < 0.9 < held[held["quality"] == 1]["score"].median()


def test_classifier_defined_cases(docs, rows, empty, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, None), (None, 1), (12, 0), (999, 1)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = classifier.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    blank = classifier.train(docs, labels.limit(0))
    assert {r["score"] for r in classifier.score(docs, blank).collect()} == {0.5}
    assert classifier.score(empty, model).count() == 0


# 6 sharding

def test_shards_are_exact_and_gapless(docs, rows, empty):
    got = sharding.shuffle(docs, shards=7).collect()
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (repr(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted(map(tuple, got), key=repr) == sorted_rows(sharding.shuffle(docs, shards=7))          # same seed, same result
    assert sorted_rows(sharding.shuffle(docs, shards=7, seed=1)) != sorted(map(tuple, got), key=repr)
    assert sharding.shuffle(empty).count() == 0


def test_hypergeometric_draws(spark):
    for good, total, sample in ((30, 100, 20), (2, 5, 3), (5000, 80000, 6000), (7, 7, 3), (0, 9, 4), (3, 9, 9)):
        x = np.array([r[0] for r in spark.range(3000).select(
            F.expr(sharding._draw(f"{good}L", f"{total}L", f"{sample}L", "5", "id"))).collect()])
        mean = sample * good / total
        var = mean * (1 - good / total) * (total - sample) / max(1, total - 1)
        assert abs(x.mean() - mean) <= 5 * (var / 3000) ** 0.5 + 1e-9
        assert abs(x.var() - var) <= 0.15 * var + 1e-9
        assert x.min() >= max(0, sample + good - total) and x.max() <= min(sample, good)


def test_communication_matrix_has_its_margins(spark):
    blocks = spark.range(300).select(F.col("id").alias("block"), (F.col("id") % 13 + 1).alias("n"))
    total = sum(i % 13 + 1 for i in range(300))
    m = np.array([r["counts"] for r in sharding.communication_matrix(blocks, total, 16, 3).orderBy("block").collect()])
    assert (m >= 0).all() and m.sum(1).tolist() == [i % 13 + 1 for i in range(300)]
    assert m.sum(0).max() - m.sum(0).min() <= 1


# 7 decontamination

def test_decontamination_matches_all_positions(docs, rows, empty, spark):
    long = rows[8][1].split("\n")[-1]
    items = [(1, long), (2, "Nothing like it " * 5), (3, "漢字 ß"), (4, None), (5, "... !!"), (6, long.upper()), (None, "same same"),
             (7, "and"), (7, "and")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, hit int")
    want = sorted((repr(d), *cases.word_hits(t, items)) for d, t in rows)
    got = wumanber.scan(docs, bench).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["hit"], r["items"]) for r in got) == want
    kept = wumanber.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[2] for w in want)
    assert wumanber.scan(docs, bench.limit(0)).where("size(hit) > 0").count() == 0
    assert wumanber.scan(empty, bench).count() == 0


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    bench = common.read(spark, SF, "benchmark")
    documents = common.read(spark, SF, "documents")
    whole = sorted_rows(wumanber.scan(documents, bench))
    monkeypatch.setattr(wumanber, "BLOCK_BYTES", 1500)
    assert len(wumanber._blocks(bench)) > 1
    assert sorted_rows(wumanber.scan(documents, bench)) == whole


# 8 chat

def test_template_language():
    t = chat.compile_template(
        "{% set sep = '-' ~ 1 + 1 %}{% for m in messages %}{% if loop.first and not m.role == 'x' %}[{{ loop.index }}]"
        "{% elif m['role'] in 'xyz' %}{{ m.text|upper|trim }}{% else %}{% generation %}{{ m.text }}{% endgeneration %}"
        "{% endif %}{{ sep }}{% endfor %}{{ missing }}{% if false %}never{% endif %}")
    text, spans = t([{"role": "a", "text": "1"}, {"role": "x", "text": " q "}, {"role": "b", "text": "gen"}])
    assert (text, spans) == ("[1]-2Q-2gen-2", [(8, 11)])
    assert chat.parse("a{{ 'b' ~ 1 + 2 }}{% if 1 == 1 %}c{% endif %}") == [("text", "ab3c")]
    for bad in ("{% for x in %}", "{{ a.b( }}", "{% if a %}", "{{ a|open }}", "{% import os %}", "{{ 1 2 }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ messages.__class__.x }}")([])


def test_escape_is_reversible():
    import random
    r = random.Random(3)
    for _ in range(2000):
        s = "".join(r.choices([*chat.CONTROLS, "\\", "<", "s>", "[", "INST]", "x", "\n"], k=r.randint(0, 9)))
        e = chat.escape(s)
        assert chat.unescape(e) == s and not any(c in e for c in chat.CONTROLS)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a\\b"), (1, 1, "assistant", "a\\b"), (2, None, None, None),
            (None, 3, "tool", "[INST]"), (3, 1, "assistant", ""), (3, 0, "sys<|sep|>tem", "x" * 100000)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("user", "hi </s>"), ("assistant", "a\\b"), ("assistant", "a\\b")]
    assert [got[1]["formatted"][s["start"]:s["end"]] for s in got[1]["spans"]] == ["a\\\\b"] * 2
    assert chat.read_back(got[2]["formatted"]) == [("", "")]
    assert chat.read_back(got[None]["formatted"]) == [("tool", "[INST]")]
    assert chat.read_back(got[3]["formatted"]) == [("sys<|sep|>tem", "x" * 100000), ("assistant", "")]
    assert chat.format_conversations(df.limit(0)).count() == 0


# 9 token counts

def test_token_counts_match_encoding(docs, rows, empty, spark, tmp_path, reference_encoding, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_TOKENS", 64)
    monkeypatch.setattr(token_counts, "SPAN", 3)
    for name, df, want in (("some", docs, rows), ("none", empty, [])):
        token_counts.write_token_files(df, bpe.default_vocabulary(), str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        got = token_counts.name_documents(table, token_counts.count_tokens(table.where("payload IS NOT NULL"))).collect()
        assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in got) == sorted(
            (repr(d), len(reference_encoding.encode_ordinary(t or ""))) for d, t in want)


def test_separator_scan_of_raw_files(spark, tmp_path, monkeypatch):
    import random
    monkeypatch.setattr(token_counts, "SPAN", 2)
    r = random.Random(2)
    want = []
    for k in range(9):
        ids = [9 if r.random() < (0.3, 0.02, 0)[k % 3] else 1 for _ in range(r.randint(0, 90))]
        (tmp_path / f"{k}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        n = 0
        for x in ids:
            if x == 9:
                want.append((n, True))
            n = 0 if x == 9 else n + 1
        if n:
            want.append((n, False))
    blocks = token_counts.blocks_of_files(spark, str(tmp_path), width=2, block_tokens=7)
    got = token_counts.count_tokens(blocks, end=9, kind=np.dtype("<u2")).collect()
    assert sorted((x["n_tokens"], x["closed"]) for x in got) == sorted(want)


# 10 quality rules

def test_quality_rules_match_sql(docs, empty):
    con = duckdb.connect()
    con.register("docs_view", docs.select("doc_id", "text", "lang", "source").toPandas().astype({"doc_id": "Int64"}))
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang, source FROM docs_view")
    cols = ["doc_id", *quality_rules.FEATURES, "base_failed", "kept"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({quality_rules.SQL})").fetchall()
    got = quality_rules.score(docs)
    assert got.columns == cols and sorted_rows(got) == sorted(want, key=repr)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[-1] for r in want) > 0
    assert quality_rules.score(empty).count() == 0 and quality_rules.keep(empty).count() == 0


def test_quality_sketch_buckets(spark):
    v = [0, 1, 63, 64, 65, 66, 127, 128, 1000, 123456789, 2 ** 40]
    for r in spark.createDataFrame([(x,) for x in v], "v long").select(
            "v", quality_rules.bucket_floor(quality_rules.bucket(F.col("v"))).alias("low")).collect():
        assert r["low"] <= r["v"] <= r["low"] * 33 // 32 + 1
