"""Regular expressions with one dialect for Python and Catalyst.

Patterns are those of linear-time engines: no look-around, no back references;
``\\d``, ``\\w`` and ``\\s`` are Unicode; groups may be named ``(?P<name>...)``.
A match yields its first group where the pattern has one and it took part, and the
whole match otherwise.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_unsupported = re.compile(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=")


class InvalidPattern(ValueError):
    """The pattern does not compile in this dialect."""


@lru_cache(maxsize=512)
def compile_pattern(pattern: str) -> re.Pattern:
    if _unsupported.search(pattern):
        raise InvalidPattern(pattern)
    try:
        return re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", pattern))
    except re.error as e:
        raise InvalidPattern(f"{pattern}: {e}") from None


def find_all(text: str | None, pattern: str, strict: bool = False) -> list[str]:
    """What all matches yield, in order; nothing for an invalid pattern unless ``strict``, or for null."""
    try:
        compiled = compile_pattern(pattern)
    except InvalidPattern:
        if strict:
            raise
        return []
    if text is None:
        return []
    group = 1 if compiled.groups else 0
    return [m[group] if group and m[group] is not None else m[0] for m in compiled.finditer(text)]


def find_first(text: str | None, pattern: str) -> str | None:
    return next(iter(find_all(text, pattern)), None)


def _java(pattern: str) -> str:
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern)


def _first_group_always_takes_part(pattern: str) -> bool:
    """No alternatives, and no quantifier that could leave the first group out."""
    return "|" not in pattern and not re.search(r"\)(?:[?*]|\{0)", pattern)


def re_all(text: Column, pattern: str) -> Column:
    """:func:`find_all` as an expression where that is sure to agree, else as a pandas UDF."""
    try:
        groups = compile_pattern(pattern).groups
    except InvalidPattern:
        return F.array().cast("array<string>")
    if groups == 0 or _first_group_always_takes_part(pattern):
        found = F.regexp_extract_all(text, F.lit(_java(pattern)), F.lit(1 if groups else 0))
        return F.coalesce(found, F.array().cast("array<string>"))

    @F.pandas_udf("array<string>")
    def by_python(values: pd.Series) -> pd.Series:
        return values.map(lambda v: find_all(v, pattern))

    return by_python(text)


def re_first(text: Column, pattern: str) -> Column:
    """The first of :func:`re_all`, or null."""
    return F.get(re_all(text, pattern), F.lit(0))
