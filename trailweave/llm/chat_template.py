"""A sandboxed template language for conversations, compiled to Python closures.

Source text is parsed into a syntax tree, constant parts are folded, and every node becomes a closure;
rendering only calls closures. A template yields segments (text, under the generation marker), one
after the other, so a conversation of any length renders in bounded memory.

    {{ expression }}                       output
    {% for x in expression %} .. {% endfor %}    loop.first, .last, .index, .index0 inside
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = expression %}
    {% generation %} .. {% endgeneration %}      text the loss counts
    {# comment #}

A minus inside a delimiter strips white space on that side. Expressions have literals, names, fields
(``a.b``, ``a['b']``, of mappings and lists only), ``== != < <= > >= in``, ``and or not``, ``+`` (of
numbers or of texts), ``~`` (joins texts), ``x if c else y`` and filters ``x | name``. There are no
calls and no Python attributes, so a template can reach nothing but the values it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

Segment = tuple[str, bool]
Env = dict[str, Any]


class TemplateError(ValueError):
    """A template that can't be parsed, or an operation it may not do."""


_PART = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(-?\d+\.\d+|-?\d+)|('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.,()\[\]]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


# ---- expressions: text -> tree -------------------------------------------------------------------


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        number, text, name, mark = m.groups()
        if number:
            out.append(("value", float(number) if "." in number else int(number)))
        elif text:
            out.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1], flags=re.DOTALL)))
        else:
            out.append(("name", name) if name else ("mark", mark))
        at = m.end()
    return out


class _Expression:
    """Recursive descent, from the loosest binding to the tightest."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def accept(self, kind: str, *values: Any) -> Any:
        token = self.peek()
        if token[0] == kind and token[1] in values:
            self.at += 1
            return token[1]
        return None

    def need(self, kind: str, value: Any) -> None:
        if self.accept(kind, value) is None:
            raise TemplateError(f"{value!r} expected, found {self.peek()[1]!r}")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.either()
        if self.accept("name", "if"):
            test = self.either()
            self.need("name", "else")
            tree = ("choice", test, tree, self.choice())
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.accept("name", "or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.accept("name", "and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.accept("name", "not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while True:
            if op := self.accept("mark", "==", "!=", "<", "<=", ">", ">="):
                tree = ("compare", op, tree, self.joined())
            elif self.accept("name", "in"):
                tree = ("compare", "in", tree, self.joined())
            elif self.peek() == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                tree = ("not", ("compare", "in", tree, self.joined()))
            else:
                return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while op := self.accept("mark", "+", "~"):
            tree = ("plus" if op == "+" else "join", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.field()
        while self.accept("mark", "|"):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a filter's name is missing")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def field(self) -> tuple:
        tree = self.atom()
        while True:
            if self.accept("mark", "."):
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a field's name is missing")
                self.at += 1
                tree = ("field", tree, ("value", name))
            elif self.accept("mark", "["):
                tree = ("field", tree, self.choice())
                self.need("mark", "]")
            else:
                return tree

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "value":
            return ("value", value)
        if kind == "name":
            return ("value", _WORDS[value]) if value in _WORDS else ("name", value)
        if (kind, value) == ("mark", "("):
            tree = self.choice()
            self.need("mark", ")")
            return tree
        raise TemplateError(f"unexpected {value!r}")


# ---- statements: text -> tree --------------------------------------------------------------------


def _parts(source: str) -> list[tuple[str, str]]:
    """Texts, outputs and tags, white space stripped where asked."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _PART.finditer(source):
        text = source[at : m.start()]
        left, right = (m[1] or m[4] or m[7]), (m[3] or m[6] or m[8])
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            out.append(("output", m[2]))
        elif m[5] is not None:
            out.append(("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    rest = source[at:]
    out.append(("text", rest.lstrip() if strip else rest))
    return [p for p in out if p != ("text", "")]


class _Statements:
    def __init__(self, source: str):
        self.parts, self.at = _parts(source), 0

    def body(self, ends: tuple[str, ...] = ()) -> tuple[list[tuple], str]:
        """Statements up to one of the tags in ``ends``, and that tag."""
        out: list[tuple] = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(("text", text))
                continue
            if kind == "output":
                out.append(("output", _Expression(text).whole()))
                continue
            word = text.split(None, 1)[0] if text else ""
            if word in ends:
                return out, text
            out.append(self.statement(word, text[len(word) :].strip()))
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return out, ""

    def statement(self, word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"for {rest!r}")
            return ("for", m[1], _Expression(m[2]).whole(), self.body(("endfor",))[0])
        if word == "if":
            branches, test = [], rest
            while True:
                inner, end = self.body(("endif", "elif", "else"))
                branches.append((_Expression(test).whole(), inner))
                if end.startswith("elif"):
                    test = end[4:]
                    continue
                return ("if", branches, self.body(("endif",))[0] if end == "else" else [])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"set {rest!r}")
            return ("set", m[1], _Expression(m[2]).whole())
        if word == "generation":
            return ("generation", self.body(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word!r}")


# ---- meaning -------------------------------------------------------------------------------------


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError("only texts and numbers can be put out")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or all(isinstance(x, (int, float)) for x in (a, b)):
        return a + b
    raise TemplateError("+ takes two numbers or two texts")


def _field(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError("only mappings and lists have fields")


_COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}

_END = object()

#: Filters every template has.
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
}


class Template:
    """A compiled template. ``filters`` are pure functions of one value."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        self.filters = FILTERS | (filters or {})
        self.tree = self.fold_body(_Statements(source).body()[0])
        self._run = self._body(self.tree, False)

    # folding

    def fold(self, tree: tuple) -> tuple:
        """An expression with its constant parts worked out."""
        kind, *rest = tree
        if kind in ("value", "name"):
            return tree
        parts = [self.fold(x) if isinstance(x, tuple) else x for x in rest]
        trees = [x for x in parts if isinstance(x, tuple)]
        if kind in ("and", "or", "choice") and parts[0][0] == "value":
            if kind == "choice":
                return parts[1] if parts[0][1] else parts[2]
            return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
        tree = (kind, *parts)
        return ("value", self._value(tree)({})) if all(x[0] == "value" for x in trees) else tree

    def fold_body(self, body: list[tuple]) -> list[tuple]:
        """Statements with constant output as text, neighbouring texts joined, and dead branches gone."""
        out: list[tuple] = []

        def add(node: tuple) -> None:
            if node[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + node[1])
            elif node != ("text", ""):
                out.append(node)

        for kind, *rest in body:
            if kind == "text":
                add(("text", rest[0]))
            elif kind == "output":
                tree = self.fold(rest[0])
                add(("text", _text(tree[1])) if tree[0] == "value" else ("output", tree))
            elif kind == "set":
                add(("set", rest[0], self.fold(rest[1])))
            elif kind == "for":
                add(("for", rest[0], self.fold(rest[1]), self.fold_body(rest[2])))
            elif kind == "generation":
                if inner := self.fold_body(rest[0]):
                    add(("generation", inner))
            else:
                branches, other = [], self.fold_body(rest[1])
                for test, inner in rest[0]:
                    tree = self.fold(test)
                    if tree[0] == "value" and not tree[1]:
                        continue
                    if tree[0] == "value":
                        other = self.fold_body(inner)
                        break
                    branches.append((tree, self.fold_body(inner)))
                if branches:
                    add(("if", branches, other))
                else:
                    for node in other:
                        add(node)
        return out

    # closures

    def _value(self, tree: tuple) -> Callable[[Env], Any]:
        kind, *rest = tree
        if kind == "value":
            fixed = rest[0]
            return lambda env: fixed
        if kind == "name":
            name = rest[0]

            def look_up(env: Env) -> Any:
                if name not in env:
                    raise TemplateError(f"unknown name {name!r}")
                return env[name]

            return look_up
        if kind == "compare":
            compare, a, b = _COMPARE[rest[0]], self._value(rest[1]), self._value(rest[2])
            return lambda env: compare(a(env), b(env))
        if kind == "filter":
            if rest[0] not in self.filters:
                raise TemplateError(f"unknown filter {rest[0]!r}")
            change, a = self.filters[rest[0]], self._value(rest[1])
            return lambda env: change(a(env))
        parts = [self._value(x) for x in rest]
        a, b = parts[0], parts[1] if len(parts) > 1 else None
        if kind == "not":
            return lambda env: not a(env)
        if kind == "and":
            return lambda env: a(env) and b(env)
        if kind == "or":
            return lambda env: a(env) or b(env)
        if kind == "plus":
            return lambda env: _plus(a(env), b(env))
        if kind == "join":
            return lambda env: _text(a(env)) + _text(b(env))
        if kind == "field":
            return lambda env: _field(a(env), b(env))
        c = parts[2]
        return lambda env: b(env) if a(env) else c(env)

    def _body(self, body: list[tuple], marked: bool) -> Callable[[Env], Iterator[Segment]]:
        runs = [self._statement(node, marked) for node in body]
        if len(runs) == 1:
            return runs[0]

        def run(env: Env) -> Iterator[Segment]:
            for step in runs:
                yield from step(env)

        return run

    def _statement(self, node: tuple, marked: bool) -> Callable[[Env], Iterator[Segment]]:
        kind, *rest = node
        if kind == "text":
            fixed = ((rest[0], marked),)
            return lambda env: iter(fixed)
        if kind == "output":
            value = self._value(rest[0])
            return lambda env: iter(((_text(value(env)), marked),))
        if kind == "generation":
            return self._body(rest[0], True)
        if kind == "set":
            name, value = rest[0], self._value(rest[1])

            def assign(env: Env) -> Iterator[Segment]:
                env[name] = value(env)
                return iter(())

            return assign
        if kind == "for":
            name, items, inner = rest[0], self._value(rest[1]), self._body(rest[2], marked)

            def loop(env: Env) -> Iterator[Segment]:
                of = items(env)
                if isinstance(of, (str, dict)) or not isinstance(of, Iterable):
                    raise TemplateError("for takes a list")
                rows, n = iter(of), 0
                row = next(rows, _END)
                while row is not _END:  # one row ahead, for loop.last
                    after = next(rows, _END)
                    scope = env | {name: row, "loop": {"index0": n, "index": n + 1, "first": not n, "last": after is _END}}
                    yield from inner(scope)
                    row, n = after, n + 1

            return loop
        branches = [(self._value(test), self._body(inner, marked)) for test, inner in rest[0]]
        other = self._body(rest[1], marked)

        def choose(env: Env) -> Iterator[Segment]:
            for test, run in branches:
                if test(env):
                    return run(env)
            return other(env)

        return choose

    def segments(self, **values: Any) -> Iterator[Segment]:
        """The non-empty segments, lists among the values taken one row at a time."""
        return (s for s in self._run(dict(values)) if s[0])

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it that are under the generation marker."""
        out, spans, at = [], [], 0
        for text, marked in self.segments(**values):
            if marked:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
