"""Extraction from pages: all that is asked of a page in one pass over its tree.

An :class:`ExtractPlan` collects requests and becomes a single Arrow UDF that parses
each page once and returns a struct.  Requests that need no tree (patterns on the
raw body, JSON fields) have expressions of their own in ``functions``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import Node, parse_html
from ..functions.patterns import find_all, find_first
from ..functions.response import first_within, within
from ..functions.xpath import xpath
from .links import LinkExtractor

TRANSFORMS: dict[str, Callable[[str], str]] = {"trim": str.strip, "lowercase": str.lower, "uppercase": str.upper}
_STRINGS = (pa.list_(pa.string()), T.ArrayType(T.StringType()))


@dataclass(frozen=True)
class Css:
    """Matches of a selector: their ``text``, ``outer`` or ``inner`` HTML, an attribute, or what a pattern finds in the text."""

    selector: str
    get: str = "text"
    attr: str | None = None
    re: str | None = None
    first: bool = False

    types = property(lambda self: (pa.string(), T.StringType()) if self.first else _STRINGS)

    def _value(self, n: Node) -> str | None:
        if self.attr:
            return n.attrs.get(self.attr.lower())
        return n.outer_html() if self.get == "outer" else n.inner_html() if self.get == "inner" else n.text()

    def run(self, tree: Node, url: str | None):
        if self.first and not self.re:
            n = first_within(tree, self.selector)
            return None if n is None else self._value(n)
        nodes = within(tree, self.selector)
        if self.re:
            found = [x for n in nodes for x in find_all(n.text(), self.re)]
            return (found[0] if found else None) if self.first else found
        return [v for v in map(self._value, nodes) if v is not None]


@dataclass(frozen=True)
class XPath:
    """What an XPath expression gives."""

    expression: str
    first: bool = False

    types = property(lambda self: (pa.string(), T.StringType()) if self.first else _STRINGS)

    def run(self, tree: Node, url: str | None):
        found = xpath(tree, self.expression)
        return (found[0] if found else None) if self.first else found


@dataclass(frozen=True)
class Links:
    """The links that a :class:`LinkExtractor` takes."""

    extractor: LinkExtractor = LinkExtractor()
    types = _STRINGS

    def run(self, tree: Node, url: str | None):
        return self.extractor.of_tree(tree, url or "")


@dataclass(frozen=True)
class Count:
    """How many elements match."""

    selector: str
    types = (pa.int64(), T.LongType())

    def run(self, tree: Node, url: str | None):
        return len(within(tree, self.selector))


@dataclass(frozen=True)
class Field:
    """A field of an item: the first match of ``css`` within the row's element.

    The value is an attribute, else what ``re`` finds in the text, else the text; then
    ``transform`` is applied.  An absent value of an ``optional`` field is null, of any
    other ``default`` or the empty string.  ``llm_fallback`` (true, or a hint) marks
    fields that :mod:`.model_extract` may fill where they are blank.
    """

    name: str
    css: str | None = None
    attr: str | None = None
    re: str | None = None
    transform: str | None = None
    default: str | None = None
    optional: bool = False
    llm_fallback: bool | str = False

    def __post_init__(self) -> None:
        if not self.name or not isinstance(self.name, str):
            raise ValueError("a field needs a name")
        if not self.css:
            raise ValueError(f"field `{self.name}`: `css` is required")
        if self.transform is not None and self.transform not in TRANSFORMS:
            raise ValueError(f"field `{self.name}`: unknown transform `{self.transform}`; expected one of {', '.join(TRANSFORMS)}")

    def raw(self, row: Node) -> str | None:
        n = first_within(row, self.css)
        if n is None:
            return None
        v = n.attrs.get(self.attr.lower()) if self.attr else find_first(n.text(), self.re) if self.re else n.text()
        return TRANSFORMS[self.transform](v) if v is not None and self.transform else v

    def settle(self, value: str | None) -> str | None:
        if value is not None or self.optional:
            return value
        return self.default if self.default is not None else ""


@dataclass(frozen=True)
class ExtractSpec:
    """The fields of an item."""

    fields: tuple[Field, ...]

    def __init__(self, *fields: Field):
        if not fields:
            raise ValueError("an item needs at least one field")
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise ValueError("field names must differ")
        object.__setattr__(self, "fields", tuple(fields))

    @classmethod
    def from_dict(cls, fields: Mapping[str, Mapping]) -> ExtractSpec:
        """From a mapping of names to options; unknown options are errors."""
        known = set(Field.__dataclass_fields__) - {"name"}
        for name, options in fields.items():
            for key in options:
                if key not in known:
                    raise ValueError(f"field `{name}`: unknown option `{key}`")
        return cls(*(Field(name, **options) for name, options in fields.items()))

    def extract(self, row: Node) -> dict[str, str | None]:
        return {f.name: f.settle(f.raw(row)) for f in self.fields}

    arrow = property(lambda self: pa.struct([(f.name, pa.string()) for f in self.fields]))
    schema = property(lambda self: T.StructType([T.StructField(f.name, T.StringType()) for f in self.fields]))


@dataclass(frozen=True)
class Rows:
    """An item for each element that matches ``selector``; with ``html``, also the element's outer HTML as ``_html``."""

    selector: str
    spec: ExtractSpec
    html: bool = False

    @property
    def types(self):
        a, s = list(self.spec.arrow), list(self.spec.schema)
        if self.html:
            a.append(pa.field("_html", pa.string()))
            s.append(T.StructField("_html", T.StringType()))
        return pa.list_(pa.struct(a)), T.ArrayType(T.StructType(s))

    def run(self, tree: Node, url: str | None):
        rows = within(tree, self.selector)
        if self.html:
            return [{**{f.name: f.raw(n) for f in self.spec.fields}, "_html": n.outer_html()} for n in rows]
        return [self.spec.extract(n) for n in rows]


Request = Css | XPath | Links | Count | Rows


@dataclass(frozen=True)
class ExtractPlan:
    """Named requests that are answered together."""

    requests: Mapping[str, Request] = field(default_factory=dict)

    def column(self, html: Column, url: Column | None = None) -> Column:
        """A struct with a field for each request.  A null body answers as an empty page."""
        requests = dict(self.requests)
        arrow = pa.struct([(k, r.types[0]) for k, r in requests.items()])
        schema = T.StructType([T.StructField(k, r.types[1]) for k, r in requests.items()])

        def run(bodies: pa.Array, urls: pa.Array) -> pa.Array:
            out = []
            for body, u in zip(bodies, urls):
                tree, u = parse_html(body.as_py()), u.as_py()
                out.append({k: r.run(tree, u) for k, r in requests.items()})
            return pa.array(out, arrow)

        # not deterministic, or a filter inferred from an explode would parse each page a second time
        return F.arrow_udf(run, schema).asNondeterministic()(html, F.lit(None).cast("string") if url is None else url)

    def apply(self, pages: DataFrame, keep: Sequence[str] = (), html: str = "html", url: str = "url") -> DataFrame:
        """The columns ``keep`` of ``pages`` and one for each request; the body itself is left behind."""
        return pages.select(*keep, self.column(F.col(html), F.col(url)).alias("_found")).select(*keep, *(f"_found.{k}" for k in self.requests))


def extract_rows(pages: DataFrame, selector: str, spec: ExtractSpec, keep: Sequence[str] = (), html: str = "html") -> DataFrame:
    """A row for each item: ``keep``, the place on the page (``pos``, from 0) and the fields."""
    found = pages.select(*keep, ExtractPlan({"rows": Rows(selector, spec)}).column(F.col(html))["rows"].alias("_rows"))
    return found.select(*keep, F.posexplode("_rows").alias("pos", "_item")).select(*keep, "pos", "_item.*")


def to_item(values: Mapping) -> str:
    """An item as JSON text with keys in order."""
    return json.dumps(values, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
