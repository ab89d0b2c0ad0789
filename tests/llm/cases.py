"""Small hand-made documents with every awkward case, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, id long, n_words string, component_id int"


def documents(spark, n=60, seed=1):
    """Rows with nulls in any column, empty and long texts, copies, near copies, shared passages, repeated rows, and
    extra columns whose names clash with the operators' own."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k)).capitalize() + "."
    shared = line(45)
    texts = ["\n".join(line(r.randint(3, 25)) for _ in range(r.randint(1, 8))) for _ in range(n)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " tail"
    texts[7] = texts[3].replace(" ", "  ", 1)
    texts[8] = texts[2] + "\n" + shared
    texts[9] = shared + "\n" + texts[1]
    texts[10] = texts[1].split("\n")[0][:-1] + "x!\nother"
    texts[11] = "É ß 漢字 😀 " * 40
    texts[12] = " ".join(["same"] * 90)
    texts[13] = "#" * 50 + " | " * 60
    texts[14] = (line(12) + "\n") * 900
    texts[15] = "a" * 3000
    texts[16] = "tab\tand\x0bvt\r\nCR \x00 nul \x85 nel"
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s0", 0), (102, " \n\n ", None, None, 4), (103, None, None, None, None)]
    rows += [(None, texts[20], "en", "s1", 5), (None, texts[21], "en", "s1", 5)]
    rows += [rows[22], rows[22], rows[23]]
    return spark.createDataFrame([(*x, "no", 1, "w", 2) for x in rows], SCHEMA)


def low(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def shingle_set(text, n):
    w = space_words(low(text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(rows, n, percent=80):
    """{doc_id: component} by comparing all pairs; rows of one doc_id are one document."""
    ids = [d for d, _ in rows if d is not None]
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [(d, shingle_set(t, n)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in ids}


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


def kept_lines(rows, order, least=32, most=2):
    """Kept text per (doc_id, text) by comparing all pairs of lines; ``order`` sorts the documents."""
    docs = sorted({r for r in rows}, key=order)
    first, out = {}, {}
    for d in docs:
        kept = []
        for x in (d[1] or "").split("\n"):
            b = x.encode()
            ink = bool(space_words(x))
            gone = ink and (b in first or len(b) >= least and any(
                len(y) >= least and abs(len(b) - len(y)) <= most and edits(b, y) <= most for y in first))
            if ink:
                first.setdefault(b, None)
            if not gone:
                kept.append(x)
        out[d] = "\n".join(kept)
    return out


def word_hits(text, items, window=10):
    """(number of words, hit positions, item ids) by comparing every window with every position."""
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s or ""))
    w, hit, names = words(text), set(), set()
    for name, t in items:
        x = words(t)
        m = min(window, len(x))
        for k in range(len(x) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i:i + m] == x[k:k + m]:
                    hit.update(range(i, i + m))
                    if name is not None:
                        names.add(str(name))
    return len(w), sorted(hit), sorted(names)


def repeated_bytes(texts, width=200):
    """(bytes, removed, spans, digest of the rest) of each text, from counts of all strings of the width."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + width] for b in bodies for i in range(len(b) - width + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out
