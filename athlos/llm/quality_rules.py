"""Quality rules with adaptive thresholds per language and source.

Each document gets integer rule features in one pass over its whole text. Each (language, source) group keeps a
mergeable quantile sketch per feature: a histogram over log-linear buckets (exact below 64, then 32 buckets per
power of two, so a bucket is at most 1/32 wide relative to its value). Sketches are rows (group, feature, bucket,
count); they merge by adding counts, which Spark does with a partial aggregation, so a source with a third of all
rows costs its task a few hundred rows. The 10 %, 50 % and 90 % quantiles of a group, of its language's merged sketch and of
the whole corpus' are blended by their document counts, so a group moves its fences by the weight it has. The upper
fence of a rule lies ``WIDTH`` times the distance from the median beyond the 90 % quantile (the lower one likewise); no rule
has a number of its own. A rate is a count in a document of some size, so a document is out only if its count exceeds
the fence's by more than ``WIDTH`` standard deviations of a count of that height. Fences are joined back to the
documents, and a document outside any is rejected.

Only documents that pass the base rules enter the sketches. Defined cases: null or empty text has no words and
fails the base rules; null ``lang`` or ``source`` is a group of its own; rows repeat as often as they come in;
an empty table gives an empty result; extra columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textkit

MIN_WORDS = 50              # base rules: fewer words fail
MAX_REPEAT_PERCENT = 50     # base rules: more words in repeated 3-word windows fail
SYMBOLS = b"#*$%&|<>"
WIDTH = 3                   # distances and deviations beyond which a document is far out
# rules on counts: (what is counted, in how many); the sketched rate is the count per 1000, a floor, as in the SQL
COUNTS = {
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "capital_rate": ("n_capitals", "word_chars"),
}
RULES = {"word_length": "word_chars * 100 div nullif(n_words, 0)",                  # a mean, fenced on both sides
         **{r: f"{n} * 1000 div nullif({size}, 0)" for r, (n, size) in COUNTS.items()}}
LEVELS = (10, 50, 90)
FENCE_BYTES = 8 << 20       # a larger fence table is not broadcast
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
_STRUCT = pa.struct([(c, pa.int64()) for c in FEATURES])


def _features(col: pa.Array) -> pa.Array:
    import numpy as np

    out = np.zeros((len(col), len(FEATURES)), np.int64)
    symbol, capital = np.zeros(256, np.int64), np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    capital[65:91] = 1
    for first, data, off in textkit.chunks(col):
        n = len(off) - 1
        start, end, row = textkit.words(data, off, textkit.SPACE)
        at = textkit.rows_of(row, n)
        hashes = textkit.hash_spans(data, start, end)
        triples = textkit.windows(hashes, 3)

        def per_row(flags):
            c = np.concatenate([[0], np.cumsum(flags)])
            return c[off[1:]] - c[off[:-1]]

        block = out[first:first + n]
        block[:, 0] = np.diff(at)
        block[:, 1] = per_row(((data & 0xC0) != 0x80) & ~textkit.SPACE[data])
        block[:, 2] = per_row(symbol[data])
        block[:, 6] = per_row(capital[data])
        raw = data.tobytes()
        for i in range(n):
            lines = [x for x in raw[off[i]:off[i + 1]].split(b"\n") if x.strip()]
            block[i, 3], block[i, 5] = len(lines) - len(set(lines)), len(lines)
            t = triples[at[i]:max(at[i], at[i + 1] - 2)]
            s = np.sort(t)
            again = s[1:][s[1:] == s[:-1]]
            if len(again):
                hit = np.isin(t, again)
                covered = np.zeros(len(t) + 2, bool)
                for k in range(3):
                    covered[k:k + len(t)] |= hit
                block[i, 4] = covered.sum()
    common.release()
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(FEATURES))], names=FEATURES)


def features(text: Column) -> Column:
    """Struct of the rule features (longs) of a whole text."""
    udf = F.arrow_udf(_features, "struct<" + ",".join(f"{c}:bigint" for c in FEATURES) + ">")
    return udf(text.cast("string"))


def base_failed(f: str = "") -> Column:
    return F.expr(f"{f}n_words < {MIN_WORDS} OR 100 * {f}n_repeat_words > {MAX_REPEAT_PERCENT} * {f}n_words")


def bucket(v: Column) -> Column:
    """Sketch bucket of a non-negative long."""
    e = F.length(F.bin(v)) - 1
    cut = F.call_function("shiftright", v, (e - 5).cast("int"))
    return F.when(v < 64, v).otherwise(64 + (e - 6) * 32 + cut - 32).cast("long")


def bucket_floor(b: Column) -> Column:
    """Least value of a bucket."""
    e = F.floor((b - 64) / 32) + 6
    return F.when(b < 64, b).otherwise(F.call_function("shiftleft", 32 + (b - 64) % 32, (e - 5).cast("int")))


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n) over rows with the features and ``lang``, ``source``."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), bucket(F.expr(e)).alias("bucket"))
                                 for r, e in RULES.items()])).alias("x")
    return (rows.where(~base_failed()).select("lang", "source", values)
            .groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n")))


def _quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, q10, q50, q90, n) of the sketches merged per ``keys``."""
    from pyspark.sql import Window as W
    merged = sk.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "rule")
    cum = F.sum("n").over(w.orderBy("bucket"))
    total = F.sum("n").over(w)
    at = lambda p: F.min(F.when(F.col("cum") >= F.expr(f"(total * {p} + 99) div 100"),
                                bucket_floor(F.col("bucket"))))
    return (merged.select(*keys, "rule", "bucket", cum.alias("cum"), total.alias("total"))
            .groupBy(*keys, "rule").agg(*[at(p).alias(f"q{p}") for p in LEVELS], F.max("total").alias("n")))


def thresholds(sk: DataFrame) -> DataFrame:
    """One row per (lang, source) with an upper fence per rule, and a lower one for the word length."""
    named = lambda d, x, *keys: d.select(*keys, *[F.col(c).alias(f"{c}{x}") for c in ("rule", "n", *[f"q{p}" for p in LEVELS])])
    own = named(_quantiles(sk, ["lang", "source"]), "g", "lang", "source")
    lang = named(_quantiles(sk, ["lang"]), "l", F.col("lang").alias("ll"))
    corpus = named(_quantiles(sk, []), "c")
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("ll")) & (F.col("ruleg") == F.col("rulel"))).join(
        corpus, F.col("ruleg") == F.col("rulec"))
    q = j.select("lang", "source", F.col("ruleg").alias("rule"), *[
        F.expr(f"(ng * q{p}g + nl * q{p}l + nc * q{p}c) div (ng + nl + nc)").alias(f"q{p}") for p in LEVELS])
    # a mean's distance is at least a sketch bucket, below which the quantiles do not resolve
    least = F.when(F.col("rule") == "word_length", F.expr("q50 div 32 + 1")).otherwise(0)
    q = q.withColumns({"high": F.col("q90") + WIDTH * F.greatest(F.col("q90") - F.col("q50"), least),
                       "low": F.col("q10") - WIDTH * F.greatest(F.col("q50") - F.col("q10"), least)})
    pick = lambda r, c: F.max(F.when(F.col("rule") == r, F.col(c)))
    return q.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[pick(r, "high").alias(f"{r}_high") for r in RULES], pick("word_length", "low").alias("word_length_low"))


def _inside(expr: str, div: str = "div") -> list[str]:
    """Conditions of a document that no fence excludes, as SQL."""
    out = [f"({expr}) <= word_length_high", f"({expr}) >= word_length_low"]
    for r, (n, size) in COUNTS.items():
        most = f"({r}_high * {size} {div} 1000)"
        out.append(f"({n} <= {most} OR ({n} - {most}) * ({n} - {most}) <= {WIDTH * WIDTH} * greatest({most}, 1))")
    return out


def verdict(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """``rows`` with ``base_failed`` and ``kept``; the fence table is small (one row per language and source)
    and its join side is left to the adaptive planner, which broadcasts under its byte limit and splits a
    hot source otherwise."""
    inside = F.expr(" AND ".join(_inside(RULES["word_length"])))
    on = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return (rows.join(fences, on, "left").withColumn("base_failed", base_failed())
            .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.coalesce(inside, F.lit(False)))))


def _feature_rows(docs: DataFrame, *cols: Column) -> DataFrame:
    have = {c.lower() for c in docs.columns}
    group = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c)
             for c in ("lang", "source")]
    return docs.select(*cols, *group, features(F.col("text")).alias("f")).select(
        *[c for c in docs.select(*cols).columns], "lang", "source", "f.*")


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the features, base_failed, kept."""
    rows = common.checkpointed(_feature_rows(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return verdict(rows, thresholds(sketch(rows))).select("doc_id", *FEATURES, "base_failed", "kept")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. Texts are not shuffled while the fence table has up to
    ``FENCE_BYTES``: features are computed in the sketch pass, which runs when this is called, and again in the
    filtering pass. A larger fence table is joined by a shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    fences = common.checkpointed(thresholds(sketch(_feature_rows(docs))))
    names = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("t_lang", "t_source"))
    held = fences.agg(F.sum(names + 16 * len(fences.columns))).first()[0] or 0
    if held <= FENCE_BYTES:
        fences = F.broadcast(fences)
    return verdict(_feature_rows(docs, whole), fences).where("kept").select("document.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))


def _sql() -> str:
    rate = {r: e.replace(" div ", " // ") for r, e in RULES.items()}

    def quantiles(keys):
        by = f"PARTITION BY {keys}, rule" if keys else "PARTITION BY rule"
        head = f"{keys}, " if keys else ""
        levels = ", ".join(f"min(CASE WHEN cum >= (total * {p} + 99) // 100 THEN val END) AS q{p}" for p in LEVELS)
        return f"""SELECT {head}rule, {levels}, max(total) AS n FROM (
            SELECT {head}rule, bucket,
              CASE WHEN bucket < 64 THEN bucket ELSE (32 + (bucket - 64) % 32) << (((bucket - 64) // 32) + 1) END AS val,
              sum(n) OVER ({by} ORDER BY bucket) AS cum, sum(n) OVER ({by}) AS total
            FROM (SELECT {head}rule, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY {head}rule"""
    blend = ", ".join(f"(o.n * o.q{p} + l.n * l.q{p} + c.n * c.q{p}) // (o.n + l.n + c.n) AS q{p}" for p in LEVELS)
    least = "CASE WHEN rule = 'word_length' THEN q50 // 32 + 1 ELSE 0 END"
    pick = lambda r, e: f"max(CASE WHEN rule = '{r}' THEN {e} END)"
    high, low = f"q90 + {WIDTH} * greatest(q90 - q50, {least})", f"q10 - {WIDTH} * greatest(q50 - q10, {least})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY i) AS i FROM (
        SELECT k, unnest(x) AS w, generate_subscripts(x, 1) AS i
        FROM (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM d))),
t AS (SELECT k, i, w, lead(w, 1) OVER (PARTITION BY k ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY k ORDER BY i) AS w3 FROM w),
c AS (SELECT *, CASE WHEN w3 IS NOT NULL THEN count(*) OVER (PARTITION BY k, w, w2, w3) ELSE 0 END AS times FROM t),
r AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars,
        count(*) FILTER (WHERE times > 1 OR p1 > 1 OR p2 > 1) AS n_repeat_words FROM (
        SELECT *, lag(times, 1) OVER (PARTITION BY k ORDER BY i) AS p1, lag(times, 2) OVER (PARTITION BY k ORDER BY i) AS p2
        FROM c) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT ln) AS n_dup_lines FROM (
        SELECT k, unnest(string_split(text, chr(10))) AS ln FROM d) WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]') GROUP BY k),
f AS (SELECT d.k, doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals
      FROM d LEFT JOIN r USING (k) LEFT JOIN l USING (k)),
g AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {e} AS v FROM g WHERE NOT base_failed" for r, e in rate.items())}),
s AS (SELECT lang, source, rule, CASE WHEN v < 64 THEN v ELSE
        64 + (length(bin(v)) - 7) * 32 + (v >> (length(bin(v)) - 6)) - 32 END AS bucket, count(*) AS n FROM v GROUP BY ALL),
o AS ({quantiles("lang, source")}), l2 AS ({quantiles("lang")}), c2 AS ({quantiles("")}),
b AS (SELECT o.lang, o.source, o.rule, {blend}
      FROM o JOIN l2 l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN c2 c ON o.rule = c.rule),
z AS (SELECT lang, source, {", ".join(f"{pick(r, high)} AS {r}_high" for r in RULES)}, {pick("word_length", low)} AS word_length_low
      FROM b GROUP BY ALL)
SELECT doc_id, {", ".join(FEATURES)}, base_failed, CASE WHEN base_failed THEN false ELSE coalesce(
  {" AND ".join(_inside(rate["word_length"], "//"))}, false) END AS kept
FROM g LEFT JOIN z ON g.lang IS NOT DISTINCT FROM z.lang AND g.source IS NOT DISTINCT FROM z.source"""


SQL = _sql()
