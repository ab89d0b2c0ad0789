"""Line dedup where many lines share most of their bytes: same result as all pairs, few pairs tested."""

import random

import pytest

from athlos.llm import common, line_dedup


def plain(lines):
    """Lines that stay, by comparing each with all earlier ones."""
    kept, first = [], []
    for b in lines:
        long = len(b) >= line_dedup.MIN_BYTES
        gone = any(b == y or long and len(y) >= line_dedup.MIN_BYTES and line_dedup.within(b, y, line_dedup.EDITS) for y in first)
        first.append(b)
        if not gone:
            kept.append(b)
    return kept


def kept_of(spark, lines, monkeypatch):
    """(lines that stay, pairs whose edit distance was measured)."""
    tested = []
    real = line_dedup._near

    def counted(pairs, bodies):
        tested.append(pairs.count())
        return real(pairs, bodies)
    monkeypatch.setattr(line_dedup, "_near", counted)
    docs = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(lines)], "doc_id long, text string").repartition(4)
    got = line_dedup.dedupe_lines(docs).where("n_removed = 0").orderBy("doc_id").collect()
    return [r["text"].encode() for r in got], sum(tested)


def template(r, words=16):
    return ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(words)]


def test_variants_of_one_word(spark, monkeypatch):
    common.bound_batches(spark)
    r = random.Random(3)
    base, counts = template(r), {}
    for n in (200, 800):
        lines = []
        for _ in range(n):
            w = list(base)
            w[7] = "".join(r.choices("abcdefghij", k=r.randint(5, 7)))
            lines.append(" ".join(w).encode())
        got, counts[n] = kept_of(spark, lines, monkeypatch)
        assert got == plain(lines)
        monkeypatch.undo()
    assert counts[800] < 0.1 * 319_600                                   # all pairs


def test_copies_with_small_edits_settle_at_once(spark, monkeypatch):
    r = random.Random(5)
    base = " ".join(template(r)).encode()
    lines = []
    for k in range(600):
        b = bytearray(base)
        if k:
            at = r.randrange(len(b))
            b[at:at + r.randint(0, 1)] = bytes(r.choices(b"xyz", k=r.randint(0, 1)))
        lines.append(bytes(b))
    got, tested = kept_of(spark, lines, monkeypatch)
    assert got == plain(lines) == [base] and tested < 600 * 12


@pytest.mark.parametrize("seed", [1])
def test_crowds_of_mixed_edits_match_all_pairs(spark, monkeypatch, seed):
    """Words replaced, dropped, doubled and misspelt anywhere, with crowds cut again and again."""
    monkeypatch.setattr(line_dedup, "CROWD", 4)
    r = random.Random(seed)
    lines = []
    for base in (template(r), template(r, 9)):
        for _ in range(110):
            w = list(base)
            k = r.randrange(len(w))
            w[k:k + 1] = r.choice([["".join(r.choices("abc", k=r.randint(2, 4)))], [], [w[k], w[k]], [w[k][:-1]], [w[k] + "s"]])
            b = bytearray(" ".join(w).encode())
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(b))
                b[at:at + r.randint(0, 1)] = bytes(r.choices(b"ab ", k=r.randint(0, 1)))
            lines.append(bytes(b).strip() or b"x")
    r.shuffle(lines)
    got, _ = kept_of(spark, lines, monkeypatch)
    assert got == plain(lines)
