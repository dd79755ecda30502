"""XPath 1.0 over the trees of :mod:`.html`: all axes but namespace, predicates, operators and core functions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from .html import Comment, Node


class Text(NamedTuple):
    """A text node: its element and the place among its children."""

    parent: Node
    at: int

    @property
    def value(self) -> str:
        return self.parent.children[self.at]


class Remark(NamedTuple):
    parent: Node
    at: int

    @property
    def value(self) -> str:
        return self.parent.children[self.at].data


class Attribute(NamedTuple):
    parent: Node
    name: str

    @property
    def value(self) -> str:
        return self.parent.attrs[self.name]


class Document:
    """The root above the ``html`` element."""

    def __init__(self, html: Node):
        self.children = [html]


class InvalidXPath(ValueError):
    """The text is no XPath expression that is understood here."""


_token = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<op>\.\.|::|//|!=|<=|>=|[()\[\].@,/|+\-=<>*$])|(?P<name>[^\W\d][\w.\-]*(?::(?!:)[^\W\d][\w.\-]*)?))"""
)
_AXES = frozenset(
    "ancestor ancestor-or-self attribute child descendant descendant-or-self following following-sibling parent preceding preceding-sibling self".split()
)
_REVERSE = frozenset(("ancestor", "ancestor-or-self", "preceding", "preceding-sibling"))
Value = object
Evaluate = Callable[["Context"], Value]


class Context(NamedTuple):
    node: object
    position: int
    size: int
    order: dict


def _key(n) -> tuple:
    return (id(n.parent), n[1], type(n).__name__) if isinstance(n, tuple) else (id(n),)


def _number_nodes(html: Node) -> tuple[Document, dict]:
    """A document and the order of all its nodes."""
    doc = Document(html)
    order: dict = {(id(doc),): 0}
    stack: list = [html]
    while stack:
        n = stack.pop()
        order[_key(n)] = len(order)
        if isinstance(n, Node):
            for a in n.attrs:
                order[_key(Attribute(n, a))] = len(order)
            stack.extend(reversed(_child(n)))
    return doc, order


def _child(n) -> list:
    if isinstance(n, Document):
        return list(n.children)
    if not isinstance(n, Node):
        return []
    return [c if isinstance(c, Node) else Remark(n, i) if isinstance(c, Comment) else Text(n, i) for i, c in enumerate(n.children)]


def _parent(n, doc):
    if isinstance(n, Document):
        return None
    return n.parent if n.parent is not None else doc


def _descendants(n) -> list:
    out, stack = [], list(reversed(_child(n)))
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(reversed(_child(x)))
    return out


def _axis(n, axis: str, doc) -> list:
    if axis == "child":
        return _child(n)
    if axis == "self":
        return [n]
    if axis == "descendant":
        return _descendants(n)
    if axis == "descendant-or-self":
        return [n, *_descendants(n)]
    if axis == "attribute":
        return [Attribute(n, a) for a in n.attrs] if isinstance(n, Node) else []
    if axis == "parent":
        p = _parent(n, doc)
        return [] if p is None else [p]
    if axis.startswith("ancestor"):
        out = [n] if axis.endswith("self") else []
        p = _parent(n, doc)
        while p is not None:
            out.append(p)
            p = _parent(p, doc)
        return out
    p = _parent(n, doc)
    if p is None or isinstance(n, Attribute):
        return []
    mates = _child(p)
    at = next(i for i, c in enumerate(mates) if c is n or isinstance(c, tuple) and isinstance(n, tuple) and c[1] == n[1])
    if axis == "following-sibling":
        return mates[at + 1 :]
    if axis == "preceding-sibling":
        return mates[:at][::-1]
    out = []
    while p is not None:
        part = mates[at + 1 :] if axis == "following" else mates[:at][::-1]
        for m in part:
            whole = [m, *_descendants(m)]
            out += whole if axis == "following" else whole[::-1]
        n, p = p, _parent(p, doc)
        if p is not None:
            mates = _child(p)
            at = next(i for i, c in enumerate(mates) if c is n)
    return out


def text_of(v) -> str:
    """The string value."""
    if isinstance(v, list):
        return text_of(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else "Infinity" if v == math.inf else "-Infinity" if v == -math.inf else str(int(v)) if v == int(v) else repr(v)
    if isinstance(v, str):
        return v
    if isinstance(v, tuple):
        return v.value
    return "".join(c.text() for c in v.children) if isinstance(v, Document) else v.text()


def number_of(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    s = text_of(v).strip(" \t\r\n")
    return float(s) if re.fullmatch(r"-?(?:\d+(?:\.\d*)?|\.\d+)", s) else math.nan


def truth_of(v) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    return bool(v)


def _atom_equal(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return truth_of(a) == truth_of(b)
    if isinstance(a, float) or isinstance(b, float):
        return number_of(a) == number_of(b)
    return text_of(a) == text_of(b)


def _compare(a, op: str, b) -> bool:
    if isinstance(a, bool) and isinstance(b, list):
        b = bool(b)
    if isinstance(b, bool) and isinstance(a, list):
        a = bool(a)
    for x in a if isinstance(a, list) else [a]:
        for y in b if isinstance(b, list) else [b]:
            if op == "=":
                hit = _atom_equal(x, y)
            elif op == "!=":
                hit = not _atom_equal(x, y)
            else:
                p, q = number_of(x), number_of(y)
                hit = p < q if op == "<" else p <= q if op == "<=" else p > q if op == ">" else p >= q
            if hit:
                return True
    return False


def _substring(s: str, start: float, length: float | None) -> str:
    lo = _round(start)
    hi = math.inf if length is None else lo + _round(length)
    return "".join(c for i, c in enumerate(s, 1) if lo <= i < hi)


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else float(math.floor(x + 0.5))


def _name_of(v) -> str:
    n = v[0] if isinstance(v, list) and v else v
    return n.tag if isinstance(n, Node) else n.name if isinstance(n, Attribute) else ""


_FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "last": (0, 0, lambda c: float(c.size)),
    "position": (0, 0, lambda c: float(c.position)),
    "count": (1, 1, lambda c, v: float(len(v))),
    "name": (0, 1, lambda c, v=None: _name_of(c.node if v is None else v)),
    "local-name": (0, 1, lambda c, v=None: _name_of(c.node if v is None else v)),
    "string": (0, 1, lambda c, v=None: text_of(c.node if v is None else v)),
    "concat": (2, 99, lambda c, *v: "".join(map(text_of, v))),
    "starts-with": (2, 2, lambda c, a, b: text_of(a).startswith(text_of(b))),
    "contains": (2, 2, lambda c, a, b: text_of(b) in text_of(a)),
    "substring-before": (2, 2, lambda c, a, b: text_of(a).partition(text_of(b))[0] if text_of(b) in text_of(a) else ""),
    "substring-after": (2, 2, lambda c, a, b: text_of(a).partition(text_of(b))[2] if text_of(b) else text_of(a)),
    "substring": (2, 3, lambda c, s, a, n=None: _substring(text_of(s), number_of(a), None if n is None else number_of(n))),
    "string-length": (0, 1, lambda c, v=None: float(len(text_of(c.node if v is None else v)))),
    "normalize-space": (0, 1, lambda c, v=None: " ".join(re.split(r"[ \t\r\n]+", text_of(c.node if v is None else v).strip(" \t\r\n")))),
    "translate": (3, 3, lambda c, s, a, b: _translate(text_of(s), text_of(a), text_of(b))),
    "boolean": (1, 1, lambda c, v: truth_of(v)),
    "not": (1, 1, lambda c, v: not truth_of(v)),
    "true": (0, 0, lambda c: True),
    "false": (0, 0, lambda c: False),
    "number": (0, 1, lambda c, v=None: number_of([c.node] if v is None else v)),
    "sum": (1, 1, lambda c, v: float(sum(number_of(x) for x in v))),
    "floor": (1, 1, lambda c, v: float(math.floor(number_of(v)))),
    "ceiling": (1, 1, lambda c, v: float(math.ceil(number_of(v)))),
    "round": (1, 1, lambda c, v: _round(number_of(v))),
}


def _translate(s: str, a: str, b: str) -> str:
    table = {c: b[i] if i < len(b) else "" for i, c in reversed(list(enumerate(a)))}
    return "".join(table.get(c, c) for c in s)


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _token.match(text, at)
            if not m:
                raise InvalidXPath(text)
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.text, self.i = text, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k][1] if self.i + k < len(self.tokens) and self.tokens[self.i + k][0] != "str" else ""

    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else ""

    def take(self, want: str | None = None) -> str:
        if self.i >= len(self.tokens) or want is not None and self.peek() != want:
            raise InvalidXPath(self.text)
        self.i += 1
        return self.tokens[self.i - 1][1]

    def whole(self) -> Evaluate:
        e = self.either()
        if self.i < len(self.tokens):
            raise InvalidXPath(self.text)
        return e

    def _chain(self, below: Callable[[], Evaluate], ops: tuple[str, ...], make) -> Evaluate:
        left = below()
        while self.peek() in ops and self.kind() in ("op", "name"):
            left = make(left, self.take(), below())
        return left

    def either(self) -> Evaluate:
        return self._chain(self.both, ("or",), lambda a, _, b: lambda c: truth_of(a(c)) or truth_of(b(c)))

    def both(self) -> Evaluate:
        return self._chain(self.equality, ("and",), lambda a, _, b: lambda c: truth_of(a(c)) and truth_of(b(c)))

    def equality(self) -> Evaluate:
        return self._chain(self.relation, ("=", "!="), lambda a, op, b: lambda c: _compare(a(c), op, b(c)))

    def relation(self) -> Evaluate:
        return self._chain(self.sum, ("<", "<=", ">", ">="), lambda a, op, b: lambda c: _compare(a(c), op, b(c)))

    def sum(self) -> Evaluate:
        return self._chain(
            self.product, ("+", "-"), lambda a, op, b: lambda c: number_of(a(c)) + (number_of(b(c)) if op == "+" else -number_of(b(c)))
        )

    def product(self) -> Evaluate:
        def make(a, op, b):
            def run(c):
                x, y = number_of(a(c)), number_of(b(c))
                if op == "*":
                    return x * y
                if y == 0:
                    return math.nan if op == "mod" or x == 0 or math.isnan(x) else math.copysign(math.inf, x)
                return x / y if op == "div" else math.fmod(x, y)

            return run

        return self._chain(self.minus, ("*", "div", "mod"), make)

    def minus(self) -> Evaluate:
        if self.peek() == "-":
            self.take()
            inner = self.minus()
            return lambda c: -number_of(inner(c))
        return self._chain(self.path, ("|",), lambda a, _, b: lambda c: _ordered(_nodes(a(c)) + _nodes(b(c)), c.order))

    def path(self) -> Evaluate:
        k, t = self.kind(), self.peek()
        if k in ("str", "num") or t == "(" or k == "name" and self.peek(1) == "(" and t not in ("text", "node", "comment"):
            start = self.primary()
            tests = []
            while self.peek() == "[":
                tests.append(self.predicate())
            steps = self.steps() if self.peek() in ("/", "//") else []
            if not tests and not steps:
                return start

            def run(c):
                found = _nodes(start(c))
                for p in tests:
                    found = _keep(found, p, c.order)
                return _walk(found, steps, c.order)

            return run
        absolute = self.peek() in ("/", "//")
        if self.peek() == "/" and (self.i + 1 >= len(self.tokens) or self.tokens[self.i + 1][1] in ("|", ")", "]", ",", "=", "!=")):
            self.take()
            return lambda c: [c.order["doc"]]
        steps = self.steps(first=not absolute)
        return lambda c: _walk([c.order["doc"] if absolute else c.node], steps, c.order)

    def steps(self, first: bool = False) -> list:
        out = [self.step()] if first else []
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                out.append(("descendant-or-self", lambda n: True, []))
            out.append(self.step())
        return out

    def step(self) -> tuple:
        if self.peek() in (".", ".."):
            axis = "self" if self.take() == "." else "parent"
            return axis, lambda n: True, []
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in _AXES:
                raise InvalidXPath(self.text)
        name = self.take()
        if self.tokens[self.i - 1][0] not in ("name", "op") or self.tokens[self.i - 1][0] == "op" and name != "*":
            raise InvalidXPath(self.text)
        if self.peek() == "(":
            self.take()
            self.take(")")
            kinds = {"text": Text, "comment": Remark, "node": object}
            if name not in kinds:
                raise InvalidXPath(self.text)
            kind = kinds[name]
            test = lambda n: isinstance(n, kind)
        elif axis == "attribute":
            test = lambda n: name == "*" or n.name == name.lower()
        else:
            test = lambda n: isinstance(n, Node) and (name == "*" or n.tag == name.lower())
        tests = []
        while self.peek() == "[":
            tests.append(self.predicate())
        return axis, test, tests

    def predicate(self) -> Evaluate:
        self.take("[")
        e = self.either()
        self.take("]")
        return e

    def primary(self) -> Evaluate:
        kind = self.kind()
        if kind == "str":
            s = self.take()[1:-1]
            return lambda c: s
        if kind == "num":
            x = float(self.take())
            return lambda c: x
        if self.peek() == "(":
            self.take()
            e = self.either()
            self.take(")")
            return e
        name = self.take()
        if name not in _FUNCTIONS:
            raise InvalidXPath(self.text)
        self.take("(")
        args = []
        while self.peek() != ")" or self.kind() == "str":
            args.append(self.either())
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise InvalidXPath(self.text)
        self.take(")")
        least, most, f = _FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise InvalidXPath(self.text)
        if name in ("count", "sum"):
            return lambda c: f(c, _nodes(args[0](c)))
        return lambda c: f(c, *(a(c) for a in args))


def _nodes(v) -> list:
    if not isinstance(v, list):
        raise InvalidXPath("a set of nodes is needed here")
    return v


def _ordered(nodes: list, order: dict) -> list:
    return sorted({_key(n): n for n in nodes}.values(), key=lambda n: order[_key(n)])


def _keep(nodes: list, test: Evaluate, order: dict) -> list:
    out = []
    for i, n in enumerate(nodes, 1):
        v = test(Context(n, i, len(nodes), order))
        if v == i if isinstance(v, float) else truth_of(v):
            out.append(n)
    return out


def _walk(nodes: list, steps: list, order: dict) -> list:
    for axis, test, tests in steps:
        found = []
        for n in nodes:
            part = [x for x in _axis(n, axis, order["doc"]) if test(x)]
            for p in tests:
                part = _keep(part, p, order)
            found += part
        nodes = found if len(nodes) == 1 and axis not in _REVERSE else _ordered(found, order)
    return nodes


@lru_cache(maxsize=512)
def compile_xpath(expression: str) -> Evaluate:
    """The expression as a function; raises :class:`InvalidXPath`."""
    parser = _Parser(expression)
    if not parser.tokens:
        raise InvalidXPath(expression)
    return parser.whole()


def xpath(html: Node, expression: str, strict: bool = False) -> list[str]:
    """What the expression gives over a page, as texts.

    Elements are their outer HTML, texts and attributes their values, comments are
    skipped; a string, number or truth value is a list of one.  An invalid expression
    gives nothing unless ``strict``.
    """
    try:
        run = compile_xpath(expression)
        doc, order = _number_nodes(html)
        order["doc"] = doc
        v = run(Context(doc, 1, 1, order))
    except InvalidXPath:
        if strict:
            raise
        return []
    if not isinstance(v, list):
        return [text_of(v)]
    return [n.outer_html() if isinstance(n, Node) else html.outer_html() if isinstance(n, Document) else n.value for n in v if not isinstance(n, Remark)]
