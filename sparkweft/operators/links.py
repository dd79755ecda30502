"""Links of pages: collected, resolved, filtered and made distinct."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column

from ..functions.html import Node
from ..functions.patterns import compile_pattern
from ..functions.response import within
from ..functions.urls import host_matches, host_of, join


@dataclass(frozen=True)
class LinkExtractor:
    """What links to take.  Each method gives a changed copy.

    The steps are: attributes of the given tags, in document order; resolve against
    the page; cut fragments if asked; keep what an allow rule accepts (any, if there
    are rules at all); drop what a deny rule accepts; keep first occurrences.
    """

    tag_names: tuple[str, ...] = ("a", "area")
    attr_names: tuple[str, ...] = ("href",)
    allowed: tuple[str, ...] = ()
    denied: tuple[str, ...] = ()
    allowed_hosts: tuple[str, ...] = ()
    denied_hosts: tuple[str, ...] = ()
    within_css: str | None = None
    cut_fragments: bool = False

    def tags(self, *names: str) -> LinkExtractor:
        return replace(self, tag_names=names)

    def attrs(self, *names: str) -> LinkExtractor:
        return replace(self, attr_names=names)

    def allow(self, *patterns: str) -> LinkExtractor:
        for p in patterns:
            compile_pattern(p)
        return replace(self, allowed=self.allowed + patterns)

    def deny(self, *patterns: str) -> LinkExtractor:
        for p in patterns:
            compile_pattern(p)
        return replace(self, denied=self.denied + patterns)

    def allow_domains(self, *domains: str) -> LinkExtractor:
        return replace(self, allowed_hosts=self.allowed_hosts + domains)

    def deny_domains(self, *domains: str) -> LinkExtractor:
        return replace(self, denied_hosts=self.denied_hosts + domains)

    def restrict_css(self, selector: str) -> LinkExtractor:
        """Only within the first element that matches; the whole page if none does."""
        return replace(self, within_css=selector)

    def canonicalize(self, on: bool = True) -> LinkExtractor:
        return replace(self, cut_fragments=on)

    def _passes(self, url: str) -> bool:
        host = host_of(url) if self.allowed_hosts or self.denied_hosts else None
        if self.allowed or self.allowed_hosts:
            if not any(compile_pattern(p).search(url) for p in self.allowed) and not any(host_matches(host, d) for d in self.allowed_hosts):
                return False
        return not any(compile_pattern(p).search(url) for p in self.denied) and not any(host_matches(host, d) for d in self.denied_hosts)

    def of_tree(self, tree: Node, base: str) -> list[str]:
        """The links of a parsed page."""
        root = tree
        if self.within_css:
            found = within(tree, self.within_css)
            root = found[0] if found else tree
        out: dict[str, None] = {}
        for n in root.elements():
            if n.tag not in self.tag_names:
                continue
            value = next((n.attrs[a] for a in self.attr_names if a in n.attrs), None)
            if value is None:
                continue
            url = join(base, value)
            if self.cut_fragments:
                url = url.partition("#")[0]
            if url not in out and self._passes(url):
                out[url] = None
        return list(out)

    def column(self, html: Column, url: Column) -> Column:
        """The links of each page, an array of strings."""
        from .extract import ExtractPlan, Links

        return ExtractPlan({"links": Links(self)}).column(html, url)["links"]
