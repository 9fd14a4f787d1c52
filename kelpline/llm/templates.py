"""A small, sandboxed template language, compiled to Python closures.

    text {{ expression }} {% for m in list %} .. {% endfor %} {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = expression %} {% generation %} .. {% endgeneration %} {# comment #}

A tag that begins or ends with a hyphen strips the white space beside it.  Expressions: strings, whole numbers, true,
false, none, names, a.b and a['b'] (keys of mappings only), + for texts and numbers, == != < <= > >=, in, not, and, or,
parentheses, `x if c else y` and filters: `value | name`.  There are no calls, no Python attributes and no imports, and
names come from the given values alone.  loop.index, loop.index0, loop.first and loop.last are set in a for.

A source is parsed to a syntax tree, constant parts of the tree are folded, and each node becomes a closure; rendering
runs closures only.  Rendering is a stream of (text, generated) pieces, so a list may be a stream as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
LEXEME = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+|.\[\]()]))""")
ESCAPED = {"n": "\n", "t": "\t"}
COMPARE: dict[str, Callable[[Any, Any], bool]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
}


class TemplateError(ValueError):
    pass


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _add(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    return _text(a) + _text(b)


def _lexemes(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"unexpected sign in {source!r} at {at}")
        out.append((("text", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent, loosest binding first."""

    def __init__(self, source: str):
        self.lexemes, self.at = _lexemes(source), 0

    def take(self, *values: str) -> str | None:
        kind, value = self.lexemes[self.at]
        if kind in ("name", "sign") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, {self.lexemes[self.at][1]!r} found")

    def whole(self) -> tuple:
        node = self.choice()
        if self.lexemes[self.at][0] != "end":
            raise TemplateError(f"{self.lexemes[self.at][1]!r} not expected")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return ("choice", condition, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.sum()
        while op := self.take(*COMPARE):
            node = ("compare", op, node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.item()
        while self.take("|"):
            kind, name = self.lexemes[self.at]
            if kind != "name":
                raise TemplateError("a filter's name is expected")
            self.at += 1
            node = ("filter", name, node)
        return node

    def item(self) -> tuple:
        kind, value = self.lexemes[self.at]
        self.at += 1
        if kind == "text":
            node: tuple = ("const", re.sub(r"\\(.)", lambda m: ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            node = ("const", int(value))
        elif kind == "name" and value in ("true", "false", "none"):
            node = ("const", {"true": True, "false": False, "none": None}[value])
        elif kind == "name":
            node = ("name", value)
        elif value == "(":
            node = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"{value!r} not expected")
        while mark := self.take(".", "["):
            if mark == ".":
                kind, name = self.lexemes[self.at]
                if kind != "name":
                    raise TemplateError("a key is expected after the full stop")
                self.at += 1
                node = ("key", node, ("const", name))
            else:
                node = ("key", node, self.choice())
                self.need("]")
        return node


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of nodes."""
    pieces = TAG.split(source)
    for i in range(1, len(pieces), 2):
        tag = pieces[i]
        if tag[2] == "-":
            pieces[i - 1] = pieces[i - 1].rstrip()
        if tag[-3] == "-":
            pieces[i + 1] = pieces[i + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[list[tuple], str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(pieces):
            piece, odd = pieces[at], at % 2
            at += 1
            if not odd:
                nodes += [("text", piece)] if piece else []
                continue
            inner = piece[2:-2].strip("-").strip()
            if piece.startswith("{#"):
                continue
            if piece.startswith("{{"):
                nodes.append(("out", _Expression(inner).whole()))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return nodes, inner
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"for what? {inner!r}")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body("endfor")[0]))
            elif word == "if":
                arms, other, condition = [], [], rest
                while True:
                    inside, end = body("elif", "else", "endif")
                    arms.append((_Expression(condition).whole(), inside))
                    if end.startswith("elif"):
                        condition = end[4:]
                        continue
                    if end == "else":
                        other = body("endif")[0]
                    break
                nodes.append(("if", arms, other))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier():
                    raise TemplateError(f"set what? {inner!r}")
                nodes.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                nodes.append(("generation", body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {inner!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return body()[0]


def fold_expression(node: tuple, filters: dict) -> tuple:
    """The node with constant parts computed."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    parts = tuple(fold_expression(x, filters) if isinstance(x, tuple) else x for x in node)
    if kind == "choice" and parts[1][0] == "const":
        return parts[2] if parts[1][1] else parts[3]
    if kind in ("and", "or") and parts[1][0] == "const":
        return parts[2] if bool(parts[1][1]) == (kind == "and") else parts[1]
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)) and kind != "key":
        return ("const", _expression(parts, filters)({}))
    return parts


def fold(nodes: list[tuple], filters: dict) -> list[tuple]:
    """The tree with constant expressions computed, branches on constants decided and neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind, new = node[0], [node]
        if kind == "out":
            inner = fold_expression(node[1], filters)
            new = [("text", _text(inner[1]))] if inner[0] == "const" else [("out", inner)]
        elif kind == "for":
            new = [("for", node[1], fold_expression(node[2], filters), fold(node[3], filters))]
        elif kind == "set":
            new = [("set", node[1], fold_expression(node[2], filters))]
        elif kind == "generation":
            new = [("generation", fold(node[1], filters))]
        elif kind == "if":
            arms, other = [], fold(node[2], filters)
            for condition, inside in node[1]:
                condition = fold_expression(condition, filters)
                if condition[0] == "const" and not condition[1]:
                    continue
                if condition[0] == "const":
                    other = fold(inside, filters)
                    break
                arms.append((condition, fold(inside, filters)))
            new = [("if", arms, other)] if arms else other
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


def _expression(node: tuple, filters: dict) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        f, x = filters[node[1]], _expression(node[2], filters)
        return lambda env: f(x(env))
    if kind == "compare":
        op, a, b = COMPARE[node[1]], _expression(node[2], filters), _expression(node[3], filters)
        return lambda env: op(a(env), b(env))
    inner = [_expression(x, filters) for x in node[1:]]
    if kind == "not":
        return lambda env: not inner[0](env)
    if kind == "and":
        return lambda env: inner[0](env) and inner[1](env)
    if kind == "or":
        return lambda env: inner[0](env) or inner[1](env)
    if kind == "add":
        return lambda env: _add(inner[0](env), inner[1](env))
    if kind == "choice":
        return lambda env: inner[1](env) if inner[0](env) else inner[2](env)

    def key(env: dict) -> Any:
        value = inner[0](env)
        return value.get(inner[1](env)) if isinstance(value, dict) else None

    return key


Renderer = Callable[[dict], Iterator[tuple[str, bool]]]


def _body(nodes: list[tuple], filters: dict, generated: bool) -> Renderer:
    steps = [_node(n, filters, generated) for n in nodes]

    def run(env: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env)

    return run


def _node(node: tuple, filters: dict, generated: bool) -> Renderer:
    kind = node[0]
    if kind == "text":
        piece = [(node[1], generated)]
        return lambda env: piece
    if kind == "out":
        value = _expression(node[1], filters)
        return lambda env: [(_text(value(env)), generated)]
    if kind == "generation":
        return _body(node[1], filters, True)
    if kind == "set":
        value = _expression(node[2], filters)

        def put(env: dict) -> Iterator[tuple[str, bool]]:
            env[node[1]] = value(env)
            return iter(())

        return put
    if kind == "if":
        arms = [(_expression(c, filters), _body(b, filters, generated)) for c, b in node[1]]
        other = _body(node[2], filters, generated)

        def choose(env: dict) -> Iterator[tuple[str, bool]]:
            return next((b for c, b in arms if c(env)), other)(env)

        return choose
    items, inside = _expression(node[2], filters), _body(node[3], filters, generated)

    def loop(env: dict) -> Iterator[tuple[str, bool]]:
        rest = iter(items(env) or ())
        item, index = next(rest, rest), 0
        while item is not rest:
            following = next(rest, rest)
            turn = {"index": index + 1, "index0": index, "first": index == 0, "last": following is rest}
            yield from inside({**env, node[1]: item, "loop": turn})
            item, index = following, index + 1

    return loop


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Renderer:
    """A function from values to a stream of (text, whether it stands in a generation block)."""
    known = FILTERS | (filters or {})
    return _body(fold(parse(source), known), known, False)
