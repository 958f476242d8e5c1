"""Chat formatting by a template compiler.

The template language is sandboxed: text, ``{{ expression }}`` and ``{% if %} {% elif %} {% else %}
{% endif %} {% for x in xs %} {% endfor %} {% generation %} {% endgeneration %}``; expressions are
string and integer literals, names, ``name.field``, ``loop.index0 / first``, ``==``, ``!=``, ``+``,
``and``, ``or``, ``not`` and the filters ``trim``, ``upper``, ``lower`` and ``escape``. Names reach only what is
passed in; there are no calls, attributes of Python objects or imports. A template is parsed into a
syntax tree, constants are folded, and the tree becomes Python closures that yield pieces of text with
the mark whether they belong to a generation.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that mark turns; inside texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>")
_CONTROL = "|".join(map(re.escape, CONTROL))
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<|turn|>{{ m.role | escape }}<|text|>{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)


def escape(text: str) -> str:
    """Control strings are broken by a backslash after their first character, backslashes doubled."""
    return re.sub(rf"(?=({_CONTROL}))(.)", r"\2\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else m[1], text, flags=re.DOTALL)


# -- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    pass


OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{_text(a)}{_text(b)}",
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "trim": lambda a: _text(a).strip(),
    "upper": lambda a: _text(a).upper(),
    "lower": lambda a: _text(a).lower(),
    "escape": lambda a: escape(_text(a)),
}
FILTERS = ("trim", "upper", "lower", "escape")


def _text(value) -> str:
    return "" if value is None else str(value)


_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_LEX = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<int>\d+)|(?P<op>==|!=|\+|\||\(|\))|(?P<name>[A-Za-z]\w*(?:\.[A-Za-z]\w*)*))""")


class _Expression:
    """Precedence: or, and, not, comparison, +, filters."""

    def __init__(self, source: str):
        self.left, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.left.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def take(self, *values: str) -> str | None:
        if self.left and self.left[0][1] in values and self.left[0][0] != "str":
            return self.left.pop(0)[1]
        return None

    def whole(self):
        made = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r}")
        return made

    def chain(self, below, *names):
        made = below()
        while op := self.take(*names):
            made = Op(op, (made, below()))
        return made

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.chain(self.added, "==", "!=")

    def added(self):
        return self.chain(self.filtered, "+")

    def filtered(self):
        made = self.atom()
        while self.take("|"):
            kind, name = self.left.pop(0) if self.left else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            made = Op(name, (made,))
        return made

    def atom(self):
        if self.take("("):
            made = self.either()
            if not self.take(")"):
                raise TemplateError("no closing bracket")
            return made
        kind, value = self.left.pop(0) if self.left else ("", "nothing")
        if kind == "str":
            return Const(value[1:-1])
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            if any(p.startswith("_") for p in value.split(".")):
                raise TemplateError(f"no name {value!r}")
            return Name(tuple(value.split(".")))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    parts = [p for p in _TAGS.split(source) if p]

    def block(ends: tuple[str, ...]):
        body = []
        while parts:
            p = parts.pop(0)
            if p.startswith(("{{", "{%")) and not p.endswith(("}}", "%}")):
                raise TemplateError(f"not closed: {p!r}")
            if p.startswith("{{"):
                body.append(Emit(_Expression(p[2:-2]).whole()))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(body), word, rest
                if word == "if":
                    arms, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end, rest = block(("elif", "else", "endif") if condition is not None else ("endif",))
                        arms.append((condition if condition is not None else Const(True), inner))
                        if end == "endif":
                            break
                        condition = _Expression(rest).whole() if end == "elif" else None
                    body.append(If(tuple(arms)))
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*) in (.+)", rest.strip())
                    if not m:
                        raise TemplateError(f"can't read {rest!r}")
                    body.append(For(m[1], _Expression(m[2]).whole(), block(("endfor",))[0]))
                elif word == "generation":
                    body.append(Generation(block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"no tag {word!r}")
            else:
                body.append(Emit(Const(p)))
        if ends != ("",):
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(body), "", ""

    return block(("",))[0]


def fold(node):
    """Constant expressions become constants, decided branches go, neighbouring texts become one."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        y = Emit(Const(_text(out.pop().value.value) + _text(y.value.value)))
                    if not _text(y.value.value):
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        return Const(OPS[node.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Op(node.name, args)
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, For):
        return For(node.name, fold(node.items), fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, body in ((fold(c), fold(b)) for c, b in node.arms):
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, body))
            if isinstance(condition, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(tuple(arms)) if arms else ()
    return node


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        first, *rest = node.path

        def look(env):
            v = env.get(first)
            for p in rest:
                v = v.get(p) if isinstance(v, dict) else None
            return v

        return look
    if node.name in ("and", "or"):
        a, b = map(_value, node.args)
        return (lambda env: a(env) and b(env)) if node.name == "and" else (lambda env: a(env) or b(env))
    f, args = OPS[node.name], tuple(map(_value, node.args))
    return lambda env: f(*(a(env) for a in args))


Piece = tuple[str, bool]


def _closure(node) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, tuple):
        parts = tuple(map(_closure, node))

        def every(env, marked):
            for p in parts:
                yield from p(env, marked)

        return every
    if isinstance(node, Emit):
        value = _value(node.value)

        def emit(env, marked):
            yield _text(value(env)), marked

        return emit
    if isinstance(node, Generation):
        body = _closure(node.body)
        return lambda env, marked: body(env, True)
    if isinstance(node, If):
        arms = tuple((_value(c), _closure(b)) for c, b in node.arms)

        def choose(env, marked):
            for c, b in arms:
                if c(env):
                    yield from b(env, marked)
                    return

        return choose
    items, body, name = _value(node.items), _closure(node.body), node.name

    def loop(env, marked):
        for i, item in enumerate(items(env) or ()):
            yield from body(env | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, marked)

    return loop


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """A renderer of conversations; messages are read one by one, so a long one is never held whole."""
    run = _closure(fold(parse(source)))
    return lambda messages: run({"messages": messages}, False)


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("mask", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each conversation: its text, and the [from, to) code points under the loss mask.

    ``turns`` has conv_id, turn, role, text. Null texts and roles count as empty; turns of one number
    are ordered by role and text, repeated rows are repeated turns; rows without conv_id are one
    conversation; other columns are ignored; an empty table gives an empty result.

    Rows are dealt by conversation and sorted, then read as a stream: beside a batch of rows only the
    text of the conversation being written is held, which is one row of the result anyway.
    """
    import pyarrow as pa

    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)

        def read():
            for batch in batches:
                for row in batch.slice(0).to_pylist():
                    yield row

        for conv, own in groupby(read(), lambda r: r["conv_id"]):
            parts, mask, at = [], [], 0
            for text, marked in render(own):
                if marked and text:
                    mask.append([at, at + len(text)])
                parts.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([mask], pa.list_(pa.list_(pa.int64())))], names=FORMATTED.names)

    return ordered.mapInArrow(run, FORMATTED)


_TURN = re.compile(rf"({_CONTROL})")


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a text that ``TEMPLATE`` made."""
    role, state = "", "out"
    held = ""
    for i, part in enumerate(_TURN.split(formatted)):
        if i % 2 == 0:
            held = part
            continue
        if part == "<s>":
            continue
        if part == "[INST]":
            state = "user"
        elif part == "[/INST]":
            yield "user", unescape(held)
            state = "out"
        elif part == "<|turn|>":
            state = "role"
        elif part == "<|text|>":
            role, state = unescape(held), "text"
        elif part == "</s>":
            yield (role if state == "text" else "assistant"), unescape(held)
            state = "out"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_conversations``' rows: turns and loss text, as digests."""
    import pyarrow as pa

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns, n = hashlib.sha256(), 0
                for role, text in read_back(row["formatted"]):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                loss = [unescape(row["formatted"][a:b]) for a, b in row["mask"]]
                own = hashlib.sha256()
                for x in loss:
                    own.update(x.encode("utf-8", "surrogatepass"))
                out.append((row["conv_id"], n, turns.hexdigest(), sum(map(len, loss)), own.hexdigest(), len(row["formatted"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=schema.names)

    return formatted.mapInArrow(run, schema)
