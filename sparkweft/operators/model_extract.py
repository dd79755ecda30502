"""Extraction by a language model behind a small interface.

The engine brings no provider; a client is any object with ``extract_json``.  Clients
are called on the executors, in batches of rows that need them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extract import ExtractPlan, ExtractSpec, Rows

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "cache_read_tokens", "cache_write_tokens")


class TokenUsage(NamedTuple):
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    cache_read_tokens: int = 0
    cache_write_tokens: int = 0


class ModelClient(Protocol):
    def extract_json(self, schema: dict[str, Any], html: str) -> tuple[Any, TokenUsage]:
        """A value that fits the JSON schema, from a page, and what it took."""


class ModelError(ValueError):
    """The client's answer does not fit."""


class FakeClient:
    """Answers from a list of (substring, answer); the first whose substring is in the page, else the last."""

    def __init__(self, *answers: tuple[str, Any], usage: TokenUsage = TokenUsage(1, 1, 2)):
        self.answers, self.usage = answers, usage

    def extract_json(self, schema: dict[str, Any], html: str) -> tuple[Any, TokenUsage]:
        return next((a for s, a in self.answers if s in html), self.answers[-1][1]), self.usage


_JSON_TYPES = {T.StringType: "string", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number", T.FloatType: "number", T.BooleanType: "boolean"}


def json_schema(kind: T.DataType) -> dict[str, Any]:
    """The JSON schema of a Spark type."""
    if isinstance(kind, T.StructType):
        return {
            "type": "object",
            "properties": {f.name: json_schema(f.dataType) for f in kind},
            "required": [f.name for f in kind if not f.nullable],
        }
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if type(kind) in _JSON_TYPES:
        return {"type": _JSON_TYPES[type(kind)]}
    raise ValueError(f"no JSON schema for {kind.simpleString()}")


def _fits(value: Any, kind: T.DataType, nullable: bool = True) -> bool:
    if value is None:
        return nullable
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(_fits(value.get(f.name), f.dataType, f.nullable) for f in kind)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    whole = isinstance(kind, (T.LongType, T.IntegerType))
    return isinstance(value, int if whole else (int, float)) and not isinstance(value, bool)


def model_extract(pages: DataFrame, client: ModelClient, schema: T.StructType | T.ArrayType, keep: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """``keep``, the extracted value as JSON text (``value``), an ``error`` where it did not fit, and the usage counters.

    Null bodies are extracted from as empty pages.
    """
    wanted = json_schema(schema)
    kept = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("_html"))
    out = T.StructType(
        [f for f in kept.schema if f.name != "_html"]
        + [T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]
        + [T.StructField(u, T.LongType()) for u in USAGE]
    )

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for body in b["_html"]:
                try:
                    v, usage = client.extract_json(wanted, body)
                    ok = _fits(v, schema, False)
                    rows.append((json.dumps(v, ensure_ascii=False, sort_keys=True) if ok else None, None if ok else "the answer does not fit", *usage))
                except ModelError as e:
                    rows.append((None, str(e), *TokenUsage()))
            yield pd.concat([b.drop(columns="_html").reset_index(drop=True), pd.DataFrame(rows, columns=["value", "error", *USAGE])], axis=1)

    return kept.mapInPandas(run, out)


def total_usage(found: DataFrame) -> DataFrame:
    """One row: the sums of the usage counters."""
    return found.agg(*(F.coalesce(F.sum(u), F.lit(0)).alias(u) for u in USAGE))


def extract_rows_with_fallback(pages: DataFrame, selector: str, spec: ExtractSpec, client: ModelClient, keep: tuple[str, ...] = (), html: str = "html") -> DataFrame:
    """:func:`.extract.extract_rows`, with the client asked for blank fields that allow it.

    An item with any such field absent or blank costs one call, with the schema of all
    fields that allow it and the element's HTML.  Only blank fields take the answer; a
    blank or non-text answer makes them absent.  Answers are not transformed.
    """
    flagged = [f for f in spec.fields if f.llm_fallback]
    wanted = {
        "type": "object",
        "properties": {f.name: {"type": "string", **({"description": f.llm_fallback} if isinstance(f.llm_fallback, str) else {})} for f in flagged},
    }
    found = pages.select(*keep, ExtractPlan({"rows": Rows(selector, spec, html=True)}).column(F.col(html))["rows"].alias("_rows"))
    items = found.select(*keep, F.posexplode("_rows").alias("pos", "_item")).select(*keep, "pos", "_item.*")
    out = T.StructType([f for f in items.schema if f.name != "_html"])

    def blank(v) -> bool:
        return v is None or not v.strip()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = b.to_dict("records")
            for r in rows:
                if any(blank(r[f.name]) for f in flagged):
                    answer, _ = client.extract_json(wanted, r["_html"])
                    for f in flagged:
                        if blank(r[f.name]):
                            v = answer.get(f.name) if isinstance(answer, dict) else None
                            r[f.name] = v if isinstance(v, str) and v.strip() else None
                for f in spec.fields:
                    r[f.name] = f.settle(r[f.name])
            yield pd.DataFrame(rows, columns=[*b.columns]).drop(columns="_html")

    return items.mapInPandas(run, out)
