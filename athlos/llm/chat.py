"""Chat formatting with compiled templates.

A template is parsed into a syntax tree, constants are folded, and the tree becomes nested Python closures that render
one conversation and record the character spans inside ``{% generation %}`` blocks (the loss mask). The language:
``{{ expr }}``, ``{% for x in expr %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = expr %}``,
``{% generation %}``; string and integer literals, names, ``a.b`` and ``a['b']`` (dictionary keys and list places
only), ``+ ~ == != < <= > >= in and or not``, parentheses, and the filters in ``FILTERS``. There are no calls and no
Python attributes, so a template reaches nothing but the conversation.

``escape`` puts a backslash after the first character of every control string inside a text and doubles
backslashes, so no control string survives inside a text and ``unescape`` gives the text back.

Defined cases: turns are ordered by turn, then role and text (nulls first); repeated rows are repeated turns; null text
or role is empty; a null ``conv_id`` is one conversation; an empty table gives an empty result; extra columns are ignored.
A conversation is rendered as one row, so its turns must fit in one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|start|>", "<|sep|>"]
TEMPLATE = (
    "<s>{% for m in messages %}{% if m.role == 'assistant' %}<|start|>{{ m.role|escape }}<|sep|>"
    "{% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role|escape }}<|sep|>{{ m.text|escape }}[/INST]{% endif %}{% endfor %}")

_ESCAPE = re.compile(r"\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROLS))
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS = {"escape": escape, "unescape": unescape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}

# ---------------------------------------------------------------- expressions

_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.()\[\]=]))")
_BINARY = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "~": 5, "+": 6, "-": 6}
_APPLY = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "~": lambda a, b: f"{a}{b}",
    "+": lambda a, b: a + b, "-": lambda a, b: a - b,
}


class TemplateError(ValueError):
    pass


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at:at + 20]!r}")
        kind = ("int", "str", "name", "op")[m.lastindex - 1]
        out.append((kind, m.group(m.lastindex)))
        at = m.end()
    return out + [("end", "")]


class _Expression:
    """Precedence-climbing parser to tuples ('const', v), ('name', n), ('get', e, k), ('filter', f, e), ('not', e),
    ('op', o, a, b); constants are folded as the tree is built."""

    def __init__(self, source: str):
        self.items, self.at = _tokens(source), 0

    def take(self, value: str | None = None):
        kind, v = self.items[self.at]
        if value is not None and v != value:
            raise TemplateError(f"expected {value!r}, found {v!r}")
        self.at += 1
        return kind, v

    def parse(self):
        tree = self.binary(0)
        self.take("")
        return tree

    def binary(self, least: int):
        if self.items[self.at] == ("name", "not"):
            self.take()
            left = fold(("not", self.binary(3)))
        else:
            left = self.postfix()
        while (power := _BINARY.get(self.items[self.at][1], 0)) > least and self.items[self.at][0] in ("op", "name"):
            _, o = self.take()
            left = fold(("op", o, left, self.binary(power)))
        return left

    def postfix(self):
        kind, v = self.take()
        if kind == "int":
            tree = ("const", int(v))
        elif kind == "str":
            tree = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1]))
        elif kind == "name" and v in ("true", "false", "none"):
            tree = ("const", {"true": True, "false": False, "none": None}[v])
        elif kind == "name":
            tree = ("name", v)
        elif v == "(":
            tree = self.binary(0)
            self.take(")")
        else:
            raise TemplateError(f"unexpected {v!r}")
        while self.items[self.at][1] in (".", "[", "|") and self.items[self.at][0] == "op":
            _, o = self.take()
            if o == "[":
                tree = ("get", tree, self.binary(0))
                self.take("]")
            else:
                kind, v = self.take()
                if kind != "name" or (o == "|" and v not in FILTERS):
                    raise TemplateError(f"unknown name {v!r}")
                tree = fold(("filter", v, tree)) if o == "|" else ("get", tree, ("const", v))
        return tree


def fold(tree):
    """Replace an operation on constants by its value."""
    kids = [x for x in tree[1:] if isinstance(x, tuple)]
    if kids and all(k[0] == "const" for k in kids) and tree[0] in ("op", "not", "filter"):
        return ("const", evaluator(tree)({}))
    return tree


def _get(box, key):
    if isinstance(box, dict):
        return box.get(key)
    if isinstance(box, list) and isinstance(key, int):
        return box[key] if -len(box) <= key < len(box) else None
    raise TemplateError(f"no item {key!r}")


def evaluator(tree):
    """Closure env -> value of an expression tree."""
    kind = tree[0]
    if kind == "const":
        return lambda env, v=tree[1]: v
    if kind == "name":
        return lambda env, n=tree[1]: env.get(n)
    if kind == "get":
        box, key = evaluator(tree[1]), evaluator(tree[2])
        return lambda env: _get(box(env), key(env))
    if kind == "filter":
        f, e = FILTERS[tree[1]], evaluator(tree[2])
        return lambda env: f(e(env))
    if kind == "not":
        e = evaluator(tree[1])
        return lambda env: not e(env)
    o, a, b = tree[1], evaluator(tree[2]), evaluator(tree[3])
    if o == "and":
        return lambda env: a(env) and b(env)
    if o == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=_APPLY[o]: f(a(env), b(env))


# ---------------------------------------------------------------- statements

_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_FOR = re.compile(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)$", re.S)
_SET = re.compile(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)$", re.S)


def parse(template: str) -> list:
    """Syntax tree: a list of ('text', s), ('out', expr), ('for', name, expr, body), ('if', [(expr, body), ...]),
    ('set', name, expr), ('generation', body)."""
    parts = [p for p in _PART.split(template) if p]
    tree, at = _body(parts, 0, ())
    if at != len(parts):
        raise TemplateError(f"unexpected {parts[at]}")
    return tree


def _body(parts, at, ends):
    out = []
    while at < len(parts):
        p = parts[at]
        if p.startswith("{{"):
            e = _Expression(p[2:-2]).parse()
            out.append(("text", _shown(e[1])) if e[0] == "const" else ("out", e))
            at += 1
        elif not p.startswith("{%"):
            out.append(("text", p))
            at += 1
        else:
            s = p[2:-2].strip()
            word = s.split(None, 1)[0] if s else ""
            if word in ends:
                return _joined(out), at
            if word == "for" and (m := _FOR.match(s)):
                body, at = _body(parts, at + 1, ("endfor",))
                at = _closed(parts, at, "for")
                out.append(("for", m[1], _Expression(m[2]).parse(), body))
            elif word == "if":
                arms, cond = [], _Expression(s[2:]).parse()
                while True:
                    body, at = _body(parts, at + 1, ("elif", "else", "endif"))
                    arms.append((cond, body))
                    if at >= len(parts):
                        raise TemplateError("if without endif")
                    s = parts[at][2:-2].strip()
                    if s == "endif":
                        break
                    cond = ("const", True) if s == "else" else _Expression(s[4:]).parse()
                at += 1
                out += _folded_if(arms)
            elif word == "set" and (m := _SET.match(s)):
                out.append(("set", m[1], _Expression(m[2]).parse()))
                at += 1
            elif word == "generation":
                body, at = _body(parts, at + 1, ("endgeneration",))
                at = _closed(parts, at, "generation")
                out.append(("generation", body))
            else:
                raise TemplateError(f"unknown statement {p}")
    return _joined(out), at


def _closed(parts, at, what):
    if at >= len(parts):
        raise TemplateError(f"{what} without end{what}")
    return at + 1


def _folded_if(arms):
    live = []
    for cond, body in arms:
        if cond[0] == "const" and not cond[1]:
            continue
        live.append((cond, body))
        if cond[0] == "const":
            break
    if live and live[0][0][0] == "const":
        return live[0][1]
    return [("if", live)] if live else []


def _joined(nodes):
    """Neighbouring constant texts become one."""
    out = []
    for n in nodes:
        if n[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + n[1])
        elif n != ("text", ""):
            out.append(n)
    return out


def _shown(v) -> str:
    return "" if v is None else str(v)


class _Sink:
    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def add(self, s: str):
        self.parts.append(s)
        self.length += len(s)


def _block(nodes):
    steps = [_step(n) for n in nodes]

    def run(env, sink):
        for s in steps:
            s(env, sink)
    return run


def _step(node):
    kind = node[0]
    if kind == "text":
        return lambda env, sink, s=node[1]: sink.add(s)
    if kind == "out":
        e = evaluator(node[1])
        return lambda env, sink: sink.add(_shown(e(env)))
    if kind == "set":
        e = evaluator(node[2])

        def assign(env, sink, n=node[1]):
            env[n] = e(env)
        return assign
    if kind == "generation":
        body = _block(node[1])

        def marked(env, sink):
            start = sink.length
            body(env, sink)
            sink.spans.append((start, sink.length))
        return marked
    if kind == "if":
        arms = [(evaluator(c), _block(b)) for c, b in node[1]]

        def choose(env, sink):
            for c, b in arms:
                if c(env):
                    return b(env, sink)
        return choose
    name, over, body = node[1], evaluator(node[2]), _block(node[3])

    def loop(env, sink):
        items = over(env) or []
        inner = dict(env)
        for i, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}
            body(inner, sink)
    return loop


def compile_template(template: str):
    """Function (messages, **names) -> (text, spans of the loss mask)."""
    body = _block(parse(template))

    def render(messages: list[dict], **names):
        sink = _Sink()
        body({**names, "messages": messages}, sink)
        return "".join(sink.parts), sink.spans
    return render


_TURN = re.compile(r"(?:\[INST\]|<\|start\|>)(.*?)<\|sep\|>(.*?)(?:\[/INST\]|</s>)", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a conversation formatted with ``TEMPLATE``."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted[len("<s>"):])]


# ---------------------------------------------------------------- Spark

def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of start, end in characters)."""
    parse(template)                                          # a bad template fails here, not in the tasks
    turns = (rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
             .select("conv_id", F.transform("t", lambda x: F.coalesce(x["role"], F.lit(""))).alias("roles"),
                     F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts")))

    def run(batches):
        render = compile_template(template)
        for b in batches:
            for i in range(b.num_rows):
                text, spans = render([{"role": r, "text": t} for r, t in
                                      zip(b.column("roles")[i].as_py(), b.column("texts")[i].as_py())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").slice(i, 1), pa.array([text], pa.string()),
                     pa.array([[{"start": s, "end": e} for s, e in spans]],
                              pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["conv_id", "formatted", "spans"])

    return turns.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:bigint,end:bigint>>")


def _read(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    turns, loss, n, chars = [], [], [], []
    for text, sp in zip(formatted.to_pylist(), spans.to_pylist()):
        t = read_back(text)
        n.append(len(t))
        chars.append(len(text))
        turns.append("".join(f"{r}\n{x}\n" for r, x in t))
        loss.append("".join(unescape(text[s["start"]:s["end"]]) for s in sp))
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())],
        names=["n", "turns", "loss", "chars"])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    read = F.arrow_udf(_read, "struct<n:bigint,turns:string,loss:string,chars:bigint>")
    return (format_conversations(rows.union(probe)).select("conv_id", read("formatted", "spans").alias("r"))
            .select("conv_id", F.col("r.n").alias("n_turns"), F.sha2("r.turns", 256).alias("turns_sha256"),
                    F.length("r.loss").cast("long").alias("loss_chars"), F.sha2("r.loss", 256).alias("loss_sha256"),
                    F.col("r.chars").alias("formatted_chars")))


def _escaped(c: str) -> str:
    grow = " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in ["\\", *CONTROLS])
    return f"(length({c}) + {grow})"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  ({len('<s>')} + sum({_escaped('role')} + {_escaped('text')} + CASE role WHEN 'assistant'
    THEN {len('<|start|><|sep|></s>')} ELSE {len('[INST]<|sep|>[/INST]')} END))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
