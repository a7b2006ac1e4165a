"""A small sandboxed template language, compiled to Python closures.

    text            copied
    {{ value }}     a value as text; filters follow after ``|``
    {% for x in list %} ... {% endfor %}      also sets ``loop.index``, ``loop.first``, ``loop.last``
    {% if test %} ... {% elif test %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}  marks what a model is to learn

Values are names, ``a.b`` and ``a['b']`` (keys of mappings only), texts, whole numbers, ``true``,
``false``, ``none``, and ``== != in + and or not`` with parentheses. There are no calls, no
attributes of Python objects and no assignments, so a template reaches nothing but what it is
given. Compiling parses to a syntax tree, folds what is constant (also whole branches and
neighbouring texts) and turns each node into a closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

_PIECE = re.compile(r"\{\{(?P<value>.*?)\}\}|\{%(?P<tag>.*?)%\}", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<sign>==|!=|[()\[\].|+]))"
)
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ syntax tree


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
class Op:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Branch:
    cases: tuple  # (test, body) pairs
    rest: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Values:
    """Recursive descent over one value."""

    def __init__(self, source: str, filters: Mapping[str, Callable]) -> None:
        self._tokens, at = [], 0
        while source[at:].strip():
            met = _TOKEN.match(source, at)
            if not met:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self._tokens.append((met.lastgroup, met[met.lastgroup]))
            at = met.end()
        self._at, self._filters = 0, filters

    def _next(self, *signs: str) -> bool:
        if self._at < len(self._tokens) and self._tokens[self._at][1] in signs and (
            self._tokens[self._at][0] != "text"
        ):
            self._at += 1
            return True
        return False

    def whole(self):
        value = self._or()
        if self._at != len(self._tokens):
            raise TemplateError(f"unexpected {self._tokens[self._at][1]!r}")
        return value

    def _or(self):
        parts = [self._and()]
        while self._next("or"):
            parts.append(self._and())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    def _and(self):
        parts = [self._not()]
        while self._next("and"):
            parts.append(self._not())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def _not(self):
        return Op("not", (self._not(),)) if self._next("not") else self._compare()

    def _compare(self):
        left = self._sum()
        for sign in ("==", "!=", "in"):
            if self._next(sign):
                return Op(sign, (left, self._sum()))
        return left

    def _sum(self):
        parts = [self._filtered()]
        while self._next("+"):
            parts.append(self._filtered())
        return parts[0] if len(parts) == 1 else Op("+", tuple(parts))

    def _filtered(self):
        value = self._keyed()
        while self._next("|"):
            kind, name = self._take()
            if kind != "name" or name not in self._filters:
                raise TemplateError(f"no filter {name!r}")
            value = Filter(name, value)
        return value

    def _keyed(self):
        value = self._plain()
        while True:
            if self._next("."):
                kind, name = self._take()
                if kind != "name":
                    raise TemplateError(f"no key {name!r}")
                value = Key(value, Const(name))
            elif self._next("["):
                value = Key(value, self._or())
                if not self._next("]"):
                    raise TemplateError("missing ]")
            else:
                return value

    def _take(self):
        if self._at >= len(self._tokens):
            raise TemplateError("a value ends too early")
        self._at += 1
        return self._tokens[self._at - 1]

    def _plain(self):
        kind, token = self._take()
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(token))
        if kind == "name" and token not in ("and", "or", "not", "in"):
            return Const(_CONSTANTS[token]) if token in _CONSTANTS else Name(token)
        if token == "(":
            value = self._or()
            if not self._next(")"):
                raise TemplateError("missing )")
            return value
        raise TemplateError(f"unexpected {token!r}")


def parse(source: str, filters: Mapping[str, Callable]) -> tuple:
    pieces, at = [], 0
    for met in _PIECE.finditer(source):
        if met.start() > at:
            pieces.append(("copy", source[at : met.start()]))
        pieces.append(("show", met["value"]) if met["value"] is not None else ("tag", met["tag"].strip()))
        at = met.end()
    if at < len(source):
        pieces.append(("copy", source[at:]))
    pieces.reverse()  # taken from the end

    def body(*until: str) -> tuple[tuple, str]:
        nodes: list = []
        while pieces:
            kind, said = pieces.pop()
            if kind == "copy":
                nodes.append(Show(Const(said)))
            elif kind == "show":
                nodes.append(Show(_Values(said, filters).whole()))
            else:
                word, _, rest = said.partition(" ")
                if word in until:
                    return tuple(nodes), said
                nodes.append(block(word, rest))
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return tuple(nodes), ""

    def block(word: str, rest: str):
        if word == "for":
            met = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not met:
                raise TemplateError(f"cannot read for {rest!r}")
            return Loop(met[1], _Values(met[2], filters).whole(), body("endfor")[0])
        if word == "generation":
            return Generation(body("endgeneration")[0])
        if word == "if":
            cases, test = [], _Values(rest, filters).whole()
            while True:
                nodes, ended = body("elif", "else", "endif")
                cases.append((test, nodes))
                if ended.startswith("elif"):
                    test = _Values(ended[4:], filters).whole()
                elif ended == "else":
                    return Branch(tuple(cases), body("endif")[0])
                else:
                    return Branch(tuple(cases), ())
        raise TemplateError(f"unexpected {word!r}")

    return body()[0]


# --------------------------------------------------------------------- folding


def _apply(sign: str, values: list) -> Any:
    if sign == "not":
        return not values[0]
    if sign == "==":
        return values[0] == values[1]
    if sign == "!=":
        return values[0] != values[1]
    if sign == "in":
        return values[0] in values[1]
    total = values[0]
    for value in values[1:]:
        if type(value) is not type(total) or not isinstance(total, (str, int)):
            raise TemplateError("+ joins texts or adds numbers")
        total = total + value
    return total


def shown(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node, filters: Mapping[str, Callable]):
    """The same node with everything constant worked out; bodies come back as tuples."""
    again = lambda n: fold(n, filters)
    if isinstance(node, tuple):
        out: list = []
        for child in node:
            child = again(child)
            for n in child if isinstance(child, tuple) else (child,):
                if isinstance(n, Show) and isinstance(n.value, Const):
                    text = shown(n.value.value)
                    if out and isinstance(out[-1], Show) and isinstance(out[-1].value, Const):
                        text = out.pop().value.value + text
                    if text:
                        out.append(Show(Const(text)))
                else:
                    out.append(n)
        return tuple(out)
    if isinstance(node, Show):
        return Show(again(node.value))
    if isinstance(node, Filter):
        of = again(node.of)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(again(node.of), again(node.key))
    if isinstance(node, Op):
        parts = tuple(again(p) for p in node.parts)
        if node.sign in ("and", "or"):
            kept = []
            for k, part in enumerate(parts):
                if isinstance(part, Const) and k + 1 < len(parts):
                    if bool(part.value) == (node.sign == "or"):
                        kept.append(part)
                        break
                    continue
                kept.append(part)
            return kept[0] if len(kept) == 1 else Op(node.sign, tuple(kept))
        if all(isinstance(p, Const) for p in parts):
            return Const(_apply(node.sign, [p.value for p in parts]))
        return Op(node.sign, parts)
    if isinstance(node, Loop):
        return Loop(node.name, again(node.over), again(node.body))
    if isinstance(node, Generation):
        return Generation(again(node.body))
    if isinstance(node, Branch):
        cases, rest = [], again(node.rest)
        for test, nodes in node.cases:
            test = again(test)
            if isinstance(test, Const):
                if test.value:
                    rest = again(nodes)
                    break
                continue
            cases.append((test, again(nodes)))
        return Branch(tuple(cases), rest) if cases else rest
    return node


# -------------------------------------------------------------------- closures


@dataclass
class _Out:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node, filters) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        constant = node.value
        return lambda names: constant
    if isinstance(node, Name):
        name = node.name
        return lambda names: names.get(name)
    if isinstance(node, Key):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def look_up(names):
            holder, wanted = of(names), key(names)
            if isinstance(holder, Mapping):
                return holder.get(wanted)
            if isinstance(holder, (list, tuple)) and isinstance(wanted, int):
                return holder[wanted] if 0 <= wanted < len(holder) else None
            return None

        return look_up
    if isinstance(node, Filter):
        change, of = filters[node.name], _value(node.of, filters)
        return lambda names: change(of(names))
    parts, sign = [_value(p, filters) for p in node.parts], node.sign
    if sign in ("and", "or"):

        def first(names):
            value = None
            for part in parts:
                value = part(names)
                if bool(value) == (sign == "or"):
                    break
            return value

        return first
    return lambda names: _apply(sign, [part(names) for part in parts])


def _body(nodes: tuple, filters) -> Callable[[dict, _Out], None]:
    steps = [_step(node, filters) for node in nodes]

    def run(names: dict, out: _Out) -> None:
        for step in steps:
            step(names, out)

    return steps[0] if len(steps) == 1 else run


def _step(node, filters) -> Callable[[dict, _Out], None]:
    if isinstance(node, Show):
        value = _value(node.value, filters)
        if isinstance(node.value, Const):
            text = shown(node.value.value)
            return lambda names, out: out.write(text)
        return lambda names, out: out.write(shown(value(names)))
    if isinstance(node, Loop):
        over, body, name = _value(node.over, filters), _body(node.body, filters), node.name

        def loop(names, out):
            items = over(names) or ()
            if not isinstance(items, (list, tuple)):
                raise TemplateError("for goes over lists")
            for k, item in enumerate(items):
                place = {"index": k + 1, "first": k == 0, "last": k + 1 == len(items)}
                body({**names, name: item, "loop": place}, out)

        return loop
    if isinstance(node, Branch):
        cases = [(_value(test, filters), _body(nodes, filters)) for test, nodes in node.cases]
        rest = _body(node.rest, filters)

        def branch(names, out):
            for test, body in cases:
                if test(names):
                    return body(names, out)
            return rest(names, out)

        return branch
    body = _body(node.body, filters)

    def generation(names, out):
        began = out.length
        body(names, out)
        out.spans.append((began, out.length))

    return generation


def compile_template(
    source: str, filters: Mapping[str, Callable[[Any], Any]]
) -> Callable[[Mapping[str, Any]], tuple[str, list[tuple[int, int]]]]:
    """A function from names to the text and the spans under generation, in code points."""
    run = _body(fold(parse(source, filters), filters), filters)

    def render(names: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render
