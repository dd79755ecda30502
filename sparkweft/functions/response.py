"""A fetched page and its parts, for code that looks at one page at a time.

Such code runs inside Arrow batches on the executors.  A page is parsed once,
whatever is asked of it, and elements are nodes of that tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property
from typing import Any

from . import css as _css
from .html import Node, parse_html
from .jsonpath import InvalidJson, as_json, json_path
from .patterns import find_all, find_first
from .urls import join
from .xpath import xpath


class Element:
    """An element of a page; selecting within it may give the element itself, and sees nothing outside."""

    __slots__ = ("node",)

    def __init__(self, node: Node):
        self.node = node

    def text(self) -> str:
        return self.node.text()

    def attr(self, name: str) -> str | None:
        return self.node.attrs.get(name.lower())

    def inner_html(self) -> str:
        return self.node.inner_html()

    def outer_html(self) -> str:
        return self.node.outer_html()

    def css(self, selector: str) -> ElementList:
        return ElementList(within(self.node, selector))

    def re(self, pattern: str) -> list[str]:
        return find_all(self.text(), pattern)

    def re_first(self, pattern: str) -> str | None:
        return find_first(self.text(), pattern)


class ElementList:
    """Elements in document order."""

    def __init__(self, nodes: list[Node]):
        self._elements = [Element(n) for n in nodes]

    def __iter__(self) -> Iterator[Element]:
        return iter(self._elements)

    def __len__(self) -> int:
        return len(self._elements)

    def __getitem__(self, i: int) -> Element:
        return self._elements[i]

    def is_empty(self) -> bool:
        return not self._elements

    def first(self) -> Element | None:
        return self._elements[0] if self._elements else None

    def re(self, pattern: str) -> list[str]:
        return [x for e in self._elements for x in e.re(pattern)]

    def re_first(self, pattern: str) -> str | None:
        return next(iter(self.re(pattern)), None)


def within(node: Node, selector: str, strict: bool = False) -> list[Node]:
    """Matches at or below a node; what is outside does not count."""
    above, node.parent = node.parent, None
    try:
        return _css.select(node, selector, strict)
    finally:
        node.parent = above


def first_within(node: Node, selector: str) -> Node | None:
    above, node.parent = node.parent, None
    try:
        return _css.select_first(node, selector)
    finally:
        node.parent = above


class Response:
    """A page: text or, for other content types, bytes."""

    def __init__(
        self, url: str, body: str | bytes = "", status: int = 200, headers: dict[str, str] | None = None, elapsed_ms: float = 0.0, depth: int = 0
    ):
        self.url, self.status, self.elapsed_ms, self.depth = url, status, elapsed_ms, depth
        self.headers = {k.lower(): v for k, v in (headers or {}).items()}
        self._body = body

    def text(self) -> str | None:
        """The body as text; None if it is binary."""
        return self._body if isinstance(self._body, str) else None

    def bytes(self) -> bytes:
        return self._body.encode() if isinstance(self._body, str) else self._body

    @cached_property
    def tree(self) -> Node | None:
        return parse_html(self._body) if isinstance(self._body, str) else None

    def css(self, selector: str) -> ElementList:
        """All matches; none for an invalid selector or a binary body."""
        return ElementList(_css.select(self.tree, selector) if self.tree is not None else [])

    def xpath(self, expression: str) -> list[str]:
        return xpath(self.tree, expression) if self.tree is not None else []

    def xpath_first(self, expression: str) -> str | None:
        return next(iter(self.xpath(expression)), None)

    def re(self, pattern: str) -> list[str]:
        return find_all(self.text(), pattern)

    def re_first(self, pattern: str) -> str | None:
        return find_first(self.text(), pattern)

    def json(self) -> Any:
        """The body as JSON; raises :class:`InvalidJson`."""
        try:
            return json.loads(self.text() or "")
        except ValueError as e:
            raise InvalidJson(str(e)) from None

    def jsonpath(self, path: str) -> list:
        return json_path(self.text(), path)

    def urljoin(self, path: str) -> str:
        return join(self.url, path)


class CssExtractor:
    """Elements of a page by CSS; unlike :meth:`Response.css` an invalid selector raises."""

    def extract(self, response: Response, selector: str) -> list[Element]:
        return [Element(n) for n in _css.select(response.tree, selector, strict=True)] if response.tree is not None else []


class RegexExtractor:
    """Values of a text by pattern; an invalid pattern raises."""

    def extract_values(self, text: str | None, pattern: str) -> list[str]:
        return find_all(text, pattern, strict=True)


class JsonPathExtractor:
    """Values of a JSON text as JSON texts; an invalid text or path raises."""

    def extract_values(self, text: str | None, path: str) -> list[str]:
        return [as_json(v) for v in json_path(text, path)]
