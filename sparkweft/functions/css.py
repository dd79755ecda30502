"""CSS selectors over the trees of :mod:`.html`.

Types, ``*``, ids, classes, attributes with all operators, the four combinators, lists,
and the pseudo-classes of structure, ``:not``, ``:is``, ``:where``, ``:has``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from .html import Node

Test = Callable[[Node], bool]

_ident = re.compile(r"-?(?:[_a-zA-Z\u0080-\U0010ffff]|\\.)(?:[-\w\u0080-\U0010ffff]|\\.)*|--[-\w]*")
_hash = re.compile(r"(?:[-\w\u0080-\U0010ffff]|\\.)+")
_attr = re.compile(
    r"""\[\s*([-\w:|]+)\s*(?:([~|^$*]?=)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([-\w]+))\s*([iIsS])?\s*)?\]"""
)
_nth = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.IGNORECASE)


class InvalidSelector(ValueError):
    """The text is not a selector that is understood here."""


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _siblings(n: Node) -> list[Node]:
    return [c for c in n.parent.children if isinstance(c, Node)] if n.parent else [n]


def _position(n: Node, of_type: bool, last: bool) -> int:
    mates = [c for c in _siblings(n) if not of_type or c.tag == n.tag]
    at = next(i for i, c in enumerate(mates) if c is n)
    return len(mates) - at if last else at + 1


def _nth_test(text: str, of_type: bool, last: bool) -> Test:
    m = _nth.match(text)
    if not m:
        raise InvalidSelector(text)
    if m[1]:
        a, b = 2, 1 if m[1].lower() == "odd" else 0
    elif m[5]:
        a, b = 0, int(m[5])
    else:
        a = {"": 1, "+": 1, "-": -1}.get(m[2]) if m[2] in ("", "+", "-") else int(m[2])
        b = int(m[4]) * (-1 if m[3] == "-" else 1) if m[4] else 0

    def test(n: Node) -> bool:
        k = _position(n, of_type, last) - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0

    return test


def _attr_test(m: re.Match) -> Test:
    name, op = m[1].lower(), m[2]
    if not op:
        return lambda n: name in n.attrs
    want = _plain(next(x for x in (m[3], m[4], m[5]) if x is not None))
    fold = (m[6] or "").lower() == "i"
    want = want.lower() if fold else want

    def test(n: Node) -> bool:
        v = n.attrs.get(name)
        if v is None:
            return False
        v = v.lower() if fold else v
        if op == "=":
            return v == want
        if op == "~=":
            return bool(want) and want in v.split()
        if op == "|=":
            return v == want or v.startswith(want + "-")
        if not want:
            return False
        return v.startswith(want) if op == "^=" else v.endswith(want) if op == "$=" else want in v

    return test


_SIMPLE: dict[str, Test] = {
    "first-child": lambda n: _position(n, False, False) == 1,
    "last-child": lambda n: _position(n, False, True) == 1,
    "only-child": lambda n: len(_siblings(n)) == 1,
    "first-of-type": lambda n: _position(n, True, False) == 1,
    "last-of-type": lambda n: _position(n, True, True) == 1,
    "only-of-type": lambda n: sum(c.tag == n.tag for c in _siblings(n)) == 1,
    "empty": lambda n: not any(isinstance(c, (Node, str)) for c in n.children),
    "root": lambda n: n.parent is None,
}


class _Parser:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def space(self) -> bool:
        start = self.i
        while self.i < len(self.s) and self.s[self.i] in " \t\n\r\f":
            self.i += 1
        return self.i > start

    def take(self, pattern: re.Pattern) -> re.Match:
        m = pattern.match(self.s, self.i)
        if not m:
            raise InvalidSelector(self.s)
        self.i = m.end()
        return m

    def selectors(self, close: bool = False, relative: bool = False) -> list:
        out = [self.complex(relative)]
        while self.i < len(self.s) and self.s[self.i] == ",":
            self.i += 1
            out.append(self.complex(relative))
        if close:
            if self.s[self.i : self.i + 1] != ")":
                raise InvalidSelector(self.s)
            self.i += 1
        elif self.i < len(self.s):
            raise InvalidSelector(self.s)
        return out

    def complex(self, relative: bool) -> list[tuple[str, list[Test]]]:
        self.space()
        first = " "
        if relative and self.s[self.i : self.i + 1] in (">", "+", "~"):
            first = self.s[self.i]
            self.i += 1
            self.space()
        parts = [(first, self.compound())]
        while True:
            gap = self.space()
            c = self.s[self.i : self.i + 1]
            if c and c in ">+~":
                self.i += 1
                self.space()
                parts.append((c, self.compound()))
            elif gap and c and c not in ",)":
                parts.append((" ", self.compound()))
            else:
                return parts

    def compound(self) -> list[Test]:
        tests: list[Test] = []
        start = self.i
        if self.s[self.i : self.i + 1] == "*":
            self.i += 1
        else:
            m = _ident.match(self.s, self.i)
            if m:
                self.i = m.end()
                tag = _plain(m[0]).lower()
                tests.append(lambda n: n.tag == tag)
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "#":
                self.i += 1
                want = _plain(self.take(_hash)[0])
                tests.append(lambda n, want=want: n.attrs.get("id") == want)
            elif c == ".":
                self.i += 1
                want = _plain(self.take(_ident)[0])
                tests.append(lambda n, want=want: want in n.attrs.get("class", "").split())
            elif c == "[":
                tests.append(_attr_test(self.take(_attr)))
            elif c == ":":
                self.i += 1
                tests.append(self.pseudo())
            else:
                break
        if self.i == start:
            raise InvalidSelector(self.s)
        return tests

    def pseudo(self) -> Test:
        name = self.take(_ident)[0].lower()
        if self.s[self.i : self.i + 1] != "(":
            if name in _SIMPLE:
                return _SIMPLE[name]
            raise InvalidSelector(self.s)
        self.i += 1
        if name in ("not", "is", "where"):
            inner = self.selectors(close=True)
            return (lambda n: not _any(n, inner)) if name == "not" else (lambda n: _any(n, inner))
        if name == "has":
            inner = self.selectors(close=True, relative=True)
            return lambda n: any(_has(n, x) for x in inner)
        end = self.s.find(")", self.i)
        kinds = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}
        if end < 0 or name not in kinds:
            raise InvalidSelector(self.s)
        text, self.i = self.s[self.i : end], end + 1
        return _nth_test(text, *kinds[name])


def _previous(n: Node) -> Node | None:
    before = None
    for c in _siblings(n):
        if c is n:
            return before
        before = c
    return None


def _matches(n: Node, parts: list[tuple[str, list[Test]]], k: int, scope: Node | None = None) -> bool:
    combinator, tests = parts[k]
    if not all(t(n) for t in tests):
        return False
    if k == 0:
        if scope is None:
            return True
        if combinator == ">":
            return n.parent is scope
        if combinator == " ":
            up = n.parent
            while up is not None and up is not scope:
                up = up.parent
            return up is scope
        if combinator == "+":
            return _previous(n) is scope
        return n.parent is scope.parent and n is not scope and scope in _siblings(n)[: _siblings(n).index(n)]
    if combinator == ">":
        return n.parent is not None and _matches(n.parent, parts, k - 1, scope)
    if combinator == "+":
        p = _previous(n)
        return p is not None and _matches(p, parts, k - 1, scope)
    if combinator == "~":
        p = _previous(n)
        while p is not None:
            if _matches(p, parts, k - 1, scope):
                return True
            p = _previous(p)
        return False
    up = n.parent
    while up is not None:
        if _matches(up, parts, k - 1, scope):
            return True
        up = up.parent
    return False


def _any(n: Node, selectors: list) -> bool:
    return any(_matches(n, s, len(s) - 1) for s in selectors)


def _has(n: Node, parts: list) -> bool:
    where = n.parent.elements() if parts[0][0] in "+~" and n.parent else n.elements()
    return any(c is not n and _matches(c, parts, len(parts) - 1, n) for c in where)


@lru_cache(maxsize=512)
def compile_css(selector: str) -> list:
    """The parsed selector; raises :class:`InvalidSelector`."""
    return _Parser(selector.strip()).selectors()


def select(root: Node, selector: str, strict: bool = False) -> list[Node]:
    """Elements at or below ``root`` that match, in document order; none for an invalid selector unless ``strict``."""
    try:
        parsed = compile_css(selector)
    except InvalidSelector:
        if strict:
            raise
        return []
    return [n for n in root.elements() if _any(n, parsed)]


def select_first(root: Node, selector: str) -> Node | None:
    """The first match, or None."""
    try:
        parsed = compile_css(selector)
    except InvalidSelector:
        return None
    return next((n for n in root.elements() if _any(n, parsed)), None)
