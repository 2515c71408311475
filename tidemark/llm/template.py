"""A small sandboxed template language: source text, syntax tree, folded tree, Python closures.

    {{ expression }}                              output
    {% for name in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}      what is put out between is marked
    {# comment #}

Expressions: strings, whole numbers, true, false, none, names, ``value.key``, ``value["key"]``, filters ``| name``,
``not``, ``and``, ``or``, ``== != < <= > >= in``, ``+`` of two strings or two numbers, ``~`` (joins as text),
``a if c else b``. A loop has ``loop.index, loop.index0, loop.first, loop.last, loop.length``. As in common chat templates,
``-`` beside a tag strips the white space there, and what is set in a loop is gone after its round.

Sandbox: keys are read from mappings only, nothing is called but the filters of a fixed table, names with a leading
underscore are refused, and the only loops run over given lists, so every template ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox does not give."""


# ---- syntax tree ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filter:
    of: Any
    name: str


@dataclass(frozen=True)
class Operation:
    """``op`` over ``args``; ``and``, ``or`` and ``if`` evaluate only what they need."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Marked:
    body: tuple


# ---- values ---------------------------------------------------------------------------------------------------------


def as_text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"cannot put out a {type(value).__name__}")


def _length(value: Any) -> int:
    if isinstance(value, (str, list, tuple, Mapping)):
        return len(value)
    raise TemplateError("length of a value without one")


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: as_text(v).strip(),
    "upper": lambda v: as_text(v).upper(),
    "lower": lambda v: as_text(v).lower(),
    "capitalize": lambda v: as_text(v).capitalize(),
    "string": as_text,
    "length": _length,
}


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        return a + b
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _compared(compare: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        try:
            return compare(a, b)
        except TypeError as reason:
            raise TemplateError(str(reason)) from None

    return run


_STRICT: dict[str, Callable] = {
    "not": lambda a: not a,
    "+": _add,
    "~": lambda a, b: as_text(a) + as_text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _compared(lambda a, b: a < b),
    "<=": _compared(lambda a, b: a <= b),
    ">": _compared(lambda a, b: a > b),
    ">=": _compared(lambda a, b: a >= b),
    "in": _compared(lambda a, b: a in b),
}
_COMPARE = ("==", "!=", "<", "<=", ">", ">=", "in")

# ---- parser ---------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(
    r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>+~|.()\[\]=]))""",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_WORDS = {"and", "or", "not", "in", "if", "else"}
#: How deeply expressions and blocks may nest.
MAX_DEPTH = 40


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens: list[tuple[str, str]] = []
        self.filters = filters
        self.depth = 0
        at, source = 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return value if kind in ("name", "sign") else ""

    def take(self, *wanted: str) -> str | None:
        if self.peek() and self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or value in _WORDS or value in _CONSTANTS or value.startswith("_"):
            raise TemplateError(f"a name expected, not {value!r}")
        self.at += 1
        return value

    def finish(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> Any:
        found = self.choice()
        self.finish()
        return found

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        found = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            found = Operation("if", (test, found, self.choice()))
        self.depth -= 1
        return found

    def either(self) -> Any:
        found = self.both()
        while self.take("or"):
            found = Operation("or", (found, self.both()))
        return found

    def both(self) -> Any:
        found = self.negated()
        while self.take("and"):
            found = Operation("and", (found, self.negated()))
        return found

    def negated(self) -> Any:
        times = 0
        while self.take("not"):
            times += 1
        found = self.comparison()
        for _ in range(min(times, 2 + times % 2)):
            found = Operation("not", (found,))
        return found

    def comparison(self) -> Any:
        found = self.joined()
        if op := self.take(*_COMPARE):
            return Operation(op, (found, self.joined()))
        if self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            self.at += 2
            return Operation("not", (Operation("in", (found, self.joined())),))
        return found

    def joined(self) -> Any:
        found = self.filtered()
        while op := self.take("+", "~"):
            found = Operation(op, (found, self.filtered()))
        return found

    def filtered(self) -> Any:
        found = self.primary()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                found = Filter(found, name)
            elif self.take("."):
                found = Key(found, Const(self.name()))
            elif self.take("["):
                found = Key(found, self.choice())
                self.need("]")
            else:
                return found

    def primary(self) -> Any:
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind == "text":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return Const(int(value))
        if kind == "name" and value in _CONSTANTS:
            self.at += 1
            return Const(_CONSTANTS[value])
        return Name(self.name())


@dataclass
class _Open:
    """A block whose end has not come yet."""

    kind: str
    head: tuple = ()
    body: list = field(default_factory=list)
    earlier: list = field(default_factory=list)


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    stack = [_Open("top")]
    at, strip_next = 0, False

    def text(piece: str, strip_end: bool) -> None:
        piece = piece.lstrip() if strip_next else piece
        piece = piece.rstrip() if strip_end else piece
        if piece:
            stack[-1].body.append(Output(Const(piece)))

    for tag in _TAG.finditer(source):
        text(source[at : tag.start()], bool(tag[1] or tag[4]))
        at, strip_next = tag.end(), bool(tag[3] or tag[6])
        if tag[2] is not None:
            stack[-1].body.append(Output(_Expression(tag[2], filters).whole()))
        elif tag[5] is not None:
            _statement(tag[5], stack, filters)
        if len(stack) > MAX_DEPTH:
            raise TemplateError("nested too deeply")
    text(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1].kind} without end")
    return tuple(stack[0].body)


def _statement(source: str, stack: list[_Open], filters: Mapping[str, Callable]) -> None:
    word, _, rest = source.strip().partition(" ")
    top = stack[-1]
    if word == "set":
        e = _Expression(rest, filters)
        name = e.name()
        e.need("=")
        top.body.append(Assign(name, e.whole()))
    elif word == "for":
        e = _Expression(rest, filters)
        name = e.name()
        e.need("in")
        stack.append(_Open("for", (name, e.whole())))
    elif word == "if":
        stack.append(_Open("if", (_Expression(rest, filters).whole(),)))
    elif word in ("elif", "else") and top.kind == "if" and top.head:
        top.earlier.append((top.head[0], tuple(top.body)))
        top.head = (_Expression(rest, filters).whole(),) if word == "elif" else ()
        top.body = []
    elif word == "generation":
        if any(o.kind == "generation" for o in stack):
            raise TemplateError("generation within generation")
        stack.append(_Open("generation"))
    elif word == f"end{top.kind}" and top.kind != "top":
        stack.pop()
        body = tuple(top.body)
        if top.kind == "for":
            node: Any = Loop(*top.head, body)
        elif top.kind == "generation":
            node = Marked(body)
        else:
            parts = top.earlier + ([(top.head[0], body)] if top.head else [])
            other = () if top.head else body
            for test, then in reversed(parts):
                other = (Branch(test, then, other),)
            node = other[0]
        stack[-1].body.append(node)
    else:
        raise TemplateError(f"unexpected {word!r}")


# ---- constant folding -----------------------------------------------------------------------------------------------


def fold(statements: tuple, known: Mapping[str, Any], filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The tree with everything computed that depends on constants and ``known`` names alone.

    Branches with a known test are replaced by the side taken, and neighbouring constant outputs are joined. A name that
    the template sets itself is not taken from ``known``.
    """
    known = {k: v for k, v in known.items() if k not in _assigned(statements)}

    def expression(e: Any) -> Any:
        if isinstance(e, Name):
            return Const(known[e.name]) if e.name in known else e
        if isinstance(e, Key):
            of, key = expression(e.of), expression(e.key)
            return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Key(of, key)
        if isinstance(e, Filter):
            of = expression(e.of)
            return Const(filters[e.name](of.value)) if isinstance(of, Const) else replace(e, of=of)
        if isinstance(e, Operation):
            if e.op in ("and", "or", "if"):
                first = expression(e.args[0])
                if isinstance(first, Const):
                    if e.op == "if":
                        return expression(e.args[1] if first.value else e.args[2])
                    return expression(e.args[1]) if bool(first.value) == (e.op == "and") else first
                return Operation(e.op, (first, *map(expression, e.args[1:])))
            args = tuple(map(expression, e.args))
            if all(isinstance(a, Const) for a in args):
                return Const(_STRICT[e.op](*[a.value for a in args]))
            return Operation(e.op, args)
        return e

    def block(items: tuple) -> tuple:
        out: list = []
        for s in items:
            if isinstance(s, Output):
                value = expression(s.value)
                if isinstance(value, Const):
                    piece = as_text(value.value)
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        piece = out.pop().value.value + piece
                    if piece:
                        out.append(Output(Const(piece)))
                else:
                    out.append(Output(value))
            elif isinstance(s, Assign):
                out.append(Assign(s.name, expression(s.value)))
            elif isinstance(s, Branch):
                test = expression(s.test)
                if isinstance(test, Const):
                    for inner in block(s.then if test.value else s.other):
                        out.append(inner)
                else:
                    out.append(Branch(test, block(s.then), block(s.other)))
            elif isinstance(s, Loop):
                out.append(Loop(s.name, expression(s.over), block(s.body)))
            else:
                out.append(Marked(block(s.body)))
        return _joined(out)

    return block(statements)


def _joined(items: list) -> tuple:
    out: list = []
    for s in items:
        both = out and all(isinstance(x, Output) and isinstance(x.value, Const) for x in (s, out[-1]))
        out.append(Output(Const(out.pop().value.value + s.value.value)) if both else s)
    return tuple(out)


def _walk(node: Any):
    if isinstance(node, tuple):
        for n in node:
            yield from _walk(n)
    elif hasattr(node, "__dataclass_fields__"):
        yield node
        if not isinstance(node, Const):
            for name in node.__dataclass_fields__:
                yield from _walk(getattr(node, name))


def _assigned(node: Any) -> set[str]:
    return {n.name for n in _walk(node) if isinstance(n, (Assign, Loop))}


def names(node: Any) -> set[str]:
    """All names that are read anywhere below a node."""
    return {n.name for n in _walk(node) if isinstance(n, Name)}


# ---- closures -------------------------------------------------------------------------------------------------------


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping) and isinstance(key, str):
        if key in of:
            return of[key]
        raise TemplateError(f"no key {key!r}")
    if isinstance(of, (list, tuple)) and isinstance(key, int) and 0 <= key < len(of):
        return of[key]
    raise TemplateError("keys are read from mappings and lists only")


@dataclass
class Rendered:
    """Pieces of output, their length so far, and the marked spans of it (code points, end exclusive)."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.pieces)


def _value(e: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda scope, v=e.value: v
    if isinstance(e, Name):

        def read(scope: dict, name: str = e.name) -> Any:
            if name not in scope:
                raise TemplateError(f"{name!r} is not defined")
            return scope[name]

        return read
    if isinstance(e, Key):
        of, key = _value(e.of, filters), _value(e.key, filters)
        return lambda scope: _item(of(scope), key(scope))
    if isinstance(e, Filter):
        of, run = _value(e.of, filters), filters[e.name]
        return lambda scope: run(of(scope))
    args = [_value(a, filters) for a in e.args]
    if e.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if e.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if e.op == "if":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    run = _STRICT[e.op]
    return (lambda scope: run(args[0](scope))) if len(args) == 1 else (lambda scope: run(args[0](scope), args[1](scope)))


def closures(statements: tuple, filters: Mapping[str, Callable] = FILTERS) -> Callable[[dict, Rendered], None]:
    """One Python closure that runs all statements on a scope and adds to an output."""
    steps = [_step(s, filters) for s in statements]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Rendered) -> None:
        for step in steps:
            step(scope, out)

    return run


def loop_state(index: int, total: int) -> dict[str, Any]:
    return {"index": index + 1, "index0": index, "first": index == 0, "last": index == total - 1, "length": total}


def _step(s: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(s, Output):
        value = _value(s.value, filters)

        def put(scope: dict, out: Rendered) -> None:
            piece = as_text(value(scope))
            out.pieces.append(piece)
            out.length += len(piece)

        return put
    if isinstance(s, Assign):
        assigned = _value(s.value, filters)

        def assign(scope: dict, out: Rendered) -> None:
            scope[s.name] = assigned(scope)

        return assign
    if isinstance(s, Branch):
        test, then, other = _value(s.test, filters), closures(s.then, filters), closures(s.other, filters)
        return lambda scope, out: then(scope, out) if test(scope) else other(scope, out)
    if isinstance(s, Loop):
        over, body, inner = _value(s.over, filters), closures(s.body, filters), s.name

        def loop(scope: dict, out: Rendered) -> None:
            items = over(scope)
            if not isinstance(items, (list, tuple)):
                raise TemplateError("loops run over lists only")
            for i, item in enumerate(items):
                body({**scope, inner: item, "loop": loop_state(i, len(items))}, out)

        return loop
    marked = closures(s.body, filters)

    def mark(scope: dict, out: Rendered) -> None:
        start = out.length
        marked(scope, out)
        if out.length > start:
            out.spans.append((start, out.length))

    return mark


class Template:
    """A compiled template. ``constants`` are folded into it.

    A template that reads ``messages`` in nothing but one loop at its top level is ``separable``: what comes before the
    loop, each round, and what comes after can be rendered apart, so that parts of a long conversation can.
    """

    def __init__(self, source: str, constants: Mapping[str, Any] | None = None, filters: Mapping[str, Callable] | None = None):
        table = {**FILTERS, **(filters or {})}
        self.tree = fold(parse(source, table), constants or {}, table)
        self._whole = closures(self.tree, table)
        loops = [i for i, s in enumerate(self.tree) if isinstance(s, Loop) and s.over == Name("messages")]
        self.separable = len(loops) == 1
        if self.separable:
            at = loops[0]
            before, loop, after = self.tree[:at], self.tree[at], self.tree[at + 1 :]
            self.separable = "messages" not in names((before, loop.body, after))
            self._before, self._after = closures(before, table), closures(after, table)
            self._name, self._round = loop.name, closures(loop.body, table)

    def render(self, messages: list[Mapping[str, Any]]) -> Rendered:
        out = Rendered()
        self._whole({"messages": messages}, out)
        return out

    def render_part(self, messages: list[Mapping[str, Any]], first: int, total: int) -> Rendered:
        """Messages ``first`` and following of a conversation of ``total``, with the beginning and the end where they belong."""
        if not self.separable:
            raise TemplateError("this template needs whole conversations: it reads messages outside one loop at its top level")
        out, scope = Rendered(), {}
        starts = Rendered() if first else out
        self._before(scope, starts)  # what it sets is seen by the loop
        for i, message in enumerate(messages, first):
            self._round({**scope, self._name: message, "loop": loop_state(i, total)}, out)
        if first + len(messages) >= total:
            self._after(scope, out)
        return out
