"""Chat formatting: a sandboxed template language, compiled to Python closures that render conversations.

The language has literal text, ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}/{% elif %}/{% else %}`` and
``{% generation %}``, whose output is put under the loss mask. Expressions have string and integer literals, names,
``.field`` (of mappings only), ``==``, ``!=``, ``and``, ``or``, ``not``, ``+`` on strings, and the filters ``escape``,
``upper``, ``lower`` and ``trim``; nothing else of Python can be reached. ``compile_template`` parses to a syntax tree,
folds constant expressions, drops branches that can't run, joins neighbouring text, and returns a closure.

``escape`` puts a backslash before every backslash and every control string in a text, so a text can't open or end a turn
and ``unescape`` gives it back exactly.

Defined cases: null role and text are empty strings; rows of one turn number are ordered by role, then text; rows that
repeat are turns each; null ids form one conversation; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that have a meaning in formatted conversations.
CONTROL = ("[INST]", "[/INST]", "</s>", "<s>", "<|assistant|>", "<|role|>", "<|text|>")

TEMPLATE = (
    "{% for m in messages %}{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}<|assistant|>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<|role|>{{ m.role | escape }}<|text|>{{ m.text | escape }}</s>{% endif %}{% endfor %}"
)

_SPECIAL = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_READ = re.compile("|".join([r"\\(?s:.)", *map(re.escape, CONTROL)]))
_ESCAPED = re.compile(r"\\((?s:.))")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|()+]))")


class TemplateError(ValueError):
    """The template isn't one of this language, or uses a value that it can't."""


# --- expressions: ("const", value), ("name", n), ("field", e, n), ("filter", e, n), ("not", e), (operator, e, e)


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            text, number, name, sign = m.groups()
            if text is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text[1:-1])))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: Any = None) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is one too many")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("name", "or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("name", "and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("name", "not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        for sign in ("==", "!="):
            if self.take("sign", sign):
                return (sign, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.take("sign", "+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.single()
        while self.take("sign", "|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            tree = ("filter", tree, name)
        return tree

    def single(self) -> tuple:
        if self.take("sign", "("):
            tree = self.either()
            if not self.take("sign", ")"):
                raise TemplateError("a bracket isn't closed")
        else:
            kind, value = self.peek()
            if kind not in ("const", "name") or value in ("and", "or", "in"):
                raise TemplateError("an expression is missing")
            self.at += 1
            tree = (kind, value)
        while self.take("sign", "."):
            tree = ("field", tree, self.name())
        return tree


def folded(tree: tuple) -> tuple:
    """The same expression with every part that has no name in it evaluated."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("field", "filter"):
        out = (kind, folded(tree[1]), tree[2])
        known = kind == "filter" and out[1][0] == "const"
    else:
        out = (kind, *map(folded, tree[1:]))
        known = all(x[0] == "const" for x in out[1:])
        if kind in ("and", "or") and out[1][0] == "const" and not known:
            return out[2] if bool(out[1][1]) == (kind == "and") else out[1]
    return ("const", closure(out)({})) if known else out


def closure(tree: tuple) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda names: value
    if kind == "name":
        key = tree[1]

        def named(names: dict) -> Any:
            if key not in names:
                raise TemplateError(f"{key!r} isn't defined")
            return names[key]

        return named
    if kind == "field":
        of, key = closure(tree[1]), tree[2]

        def field(names: dict) -> Any:
            value = of(names)
            if type(value) is not dict:
                raise TemplateError(f"{key!r} of something that has no fields")
            return value.get(key, "")

        return field
    if kind == "filter":
        of, change = closure(tree[1]), FILTERS[tree[2]]
        return lambda names: change(str(of(names)))
    if kind == "not":
        of = closure(tree[1])
        return lambda names: not of(names)
    left, right = closure(tree[1]), closure(tree[2])
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    if kind == "==":
        return lambda names: left(names) == right(names)
    if kind == "!=":
        return lambda names: left(names) != right(names)
    return lambda names: str(left(names)) + str(right(names))


# --- statements: ("text", s), ("out", e), ("for", n, e, body), ("if", [(e, body), ...]), ("generation", body)


class Parser:
    """The parts of a template to a syntax tree."""

    def __init__(self, source: str) -> None:
        self.parts: list[tuple[str, str]] = []
        last = 0
        for m in _PARTS.finditer(source):
            self.parts += [("text", source[last : m.start()]), ("out", m[1]) if m[1] is not None else ("tag", m[2].strip())]
            last = m.end()
        self.parts.append(("text", source[last:]))
        self.at = 0

    def body(self, *ends: str) -> tuple[list[tuple], str]:
        """Statements up to one of the tags named, and that tag."""
        found: list[tuple] = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if value:
                    found.append(("text", value))
                continue
            if kind == "out":
                found.append(("out", Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return found, value
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"can't read {value!r}")
                found.append(("for", m[1], Expression(m[2]).whole(), self.body("endfor")[0]))
            elif word == "if":
                arms, tag = [], value
                while tag.partition(" ")[0] in ("if", "elif"):
                    test = Expression(tag.partition(" ")[2]).whole()
                    inner, tag = self.body("elif", "else", "endif")
                    arms.append((test, inner))
                if tag == "else":
                    arms.append((("const", True), self.body("endif")[0]))
                found.append(("if", arms))
            elif word == "generation":
                found.append(("generation", self.body("endgeneration")[0]))
            else:
                raise TemplateError(f"there is no tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return found, ""


def simplified(body: list[tuple]) -> list[tuple]:
    """Constants folded, arms that can't run dropped, neighbouring text joined."""
    out: list[tuple] = []

    def put(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            tree = folded(node[1])
            put(("text", str(tree[1])) if tree[0] == "const" else ("out", tree))
        elif node[0] == "for":
            put(("for", node[1], folded(node[2]), simplified(node[3])))
        elif node[0] == "generation":
            put(("generation", simplified(node[1])))
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                tree = folded(test)
                if tree[0] == "const" and not tree[1]:
                    continue
                arms.append((tree, simplified(inner)))
                if tree[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                for inner in arms[0][1]:
                    put(inner)
            elif arms:
                put(("if", arms))
        else:
            put(node)
    return out


class Output:
    """What is rendered so far: pieces, their length, and spans under the loss mask."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.size += len(piece)


def statements(body: list[tuple]) -> Callable[[dict, Output], None]:
    steps = [statement(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return run


def statement(node: tuple) -> Callable[[dict, Output], None]:
    if node[0] == "text":
        piece = node[1]
        return lambda names, out: out.add(piece)
    if node[0] == "out":
        value = closure(node[1])
        return lambda names, out: out.add(str(value(names)))
    if node[0] == "generation":
        inner = statements(node[1])

        def marked(names: dict, out: Output) -> None:
            start = out.size
            inner(names, out)
            out.spans.append((start, out.size))

        return marked
    if node[0] == "for":
        key, items, inner = node[1], closure(node[2]), statements(node[3])

        def loop(names: dict, out: Output) -> None:
            found = items(names)
            if type(found) is not list:
                raise TemplateError("a loop runs over lists only")
            own = dict(names)
            for x in found:
                own[key] = x
                inner(own, out)

        return loop
    arms = [(closure(test), statements(inner)) for test, inner in node[1]]

    def choose(names: dict, out: Output) -> None:
        for test, inner in arms:
            if test(names):
                inner(names, out)
                return

    return choose


def compile_template(source: str) -> Callable[[list[dict[str, str]]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the formatted text and the spans under the loss mask."""
    body, _ = Parser(source).body()
    run = statements(simplified(body))

    def render(messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.pieces), out.spans

    return render


def parse_formatted(text: str) -> list[tuple[str, str]]:
    """Turns, as (role, text), of a conversation formatted by ``TEMPLATE``."""
    turns: list[tuple[str, str]] = []
    role, start, at = "", 0, ""
    for m in _READ.finditer(text):
        sign = m[0]
        if sign[0] == "\\":
            continue
        if sign in ("[INST]", "<|assistant|>", "<|role|>"):
            at, start = sign, m.end()
        elif sign == "<|text|>":
            role, start = unescape(text[start : m.start()]), m.end()
        elif sign in ("[/INST]", "</s>"):
            turns.append(({"[INST]": "user", "<|assistant|>": "assistant"}.get(at, role), unescape(text[start : m.start()])))
    return turns


FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text): its formatted text and loss spans.

    Rows are dealt by conversation and sorted; a task renders one conversation at a time as they pass.
    """
    compile_template(template)  # refuse a bad template before anything runs
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        now: Any = None
        messages: list[dict[str, str]] = []
        out: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            spans = [[{"start": a, "end": b} for a, b in x[2]] for x in out]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array(spans, kind)], names=["conv_id", "formatted", "loss"])

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))
            for conv, role, text in zip(*columns, strict=True):
                if messages and conv != now:
                    out.append((now, *render(messages)))
                    size += len(out[-1][1])
                    messages = []
                    if size > 1 << 22:
                        yield done()
                        out.clear()
                        size = 0
                now = conv
                messages.append({"role": role, "text": text})
        if messages:
            out.append((now, *render(messages)))
        yield done()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations read back as: their turns, and the text under the loss mask."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                turns = parse_formatted(r["formatted"])
                loss = "".join(unescape(r["formatted"][x["start"] : x["end"]]) for x in r["loss"])
                rows.append((r["conv_id"], len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(r["formatted"])))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)
