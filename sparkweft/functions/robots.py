"""Rules of robots.txt: groups by agent, longest match, ``*`` and ``$``."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import parse_url

Rule = tuple[bool, str]


@lru_cache(maxsize=1024)
def rules_for(text: str, agent: str) -> tuple[Rule, ...]:
    """The (allow, pattern) rules of the groups that name the agent, or else of those for ``*``."""
    product = re.match(r"[A-Za-z_-]*", agent)[0].lower()
    groups: list[tuple[list[str], list[Rule]]] = []
    open_group = False
    for line in text.lstrip("﻿").splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "user-agent":
            if not open_group:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_group = True
        elif key in ("allow", "disallow"):
            open_group = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
    named = [r for agents, r in groups if any(a != "*" and a and product == re.match(r"[a-z_-]*", a)[0] for a in agents)]
    chosen = named or [r for agents, r in groups if "*" in agents]
    return tuple(x for r in chosen for x in r)


@lru_cache(maxsize=4096)
def _compiled(pattern: str) -> re.Pattern:
    end = pattern.endswith("$")
    body = ".*".join(re.escape(p) for p in (pattern[:-1] if end else pattern).split("*"))
    return re.compile(body + ("$" if end else ""), re.DOTALL)


def allowed(text: str | None, agent: str, url: str | None) -> bool:
    """Whether the agent may fetch the URL; an absent file, or what is no URL, allows it."""
    u = parse_url(url) if url else None
    if text is None or u is None:
        return True
    path = (u.path or "/") + ("?" + u.query if u.query is not None else "")
    best, verdict = -1, True
    for allow, pattern in rules_for(text, agent):
        if len(pattern) >= best and _compiled(pattern).match(path):
            verdict = allow or (verdict and len(pattern) == best)
            best = len(pattern)
    return verdict


def robots_allowed(text: Column, url: Column, agent: str) -> Column:
    """:func:`allowed` by row; parsed files are kept by worker."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([allowed(t, agent, u) for t, u in zip(texts, urls)], dtype=bool)

    return run(text, url)


def origin(url: Column) -> Column:
    """Scheme and host, the port left out, of an http(s) URL; null for others."""
    scheme = F.lower(F.regexp_extract(url, r"^(?i:(https?))://", 1))
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host))
