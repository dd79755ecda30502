"""URLs as the URL standard parses, joins and writes them, and host rules."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPECIAL = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21", "file": ""}
_scheme = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):")
_bad_host = set("\0\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(i) for i in range(32)}
_PATH, _QUERY, _SPECIAL_QUERY, _FRAGMENT, _USER = (
    frozenset(' "#<>?`{}^'),
    frozenset(' "#<>'),
    frozenset(" \"#<>'"),
    frozenset(' "<>`'),
    frozenset(' "#<>?`{}/:;=@[\\]^|'),
)


class Url(NamedTuple):
    scheme: str
    user: str | None
    host: str | None
    port: str | None
    path: str
    query: str | None
    fragment: str | None
    opaque: bool = False

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            out += "//" + (self.user + "@" if self.user is not None else "") + self.host + (":" + self.port if self.port else "")
        elif not self.opaque and self.path.startswith("//"):
            out += "/."
        out += self.path
        return out + ("?" + self.query if self.query is not None else "") + ("#" + self.fragment if self.fragment is not None else "")


def _encode(s: str, also: frozenset[str]) -> str:
    if s.isascii() and s.isprintable() and not any(c in also for c in s):
        return s
    return "".join(c if " " <= c <= "~" and c not in also else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in s)


def _host(raw: str, special: bool) -> str | None:
    if raw.startswith("["):
        return raw.lower() if raw.endswith("]") else None
    if not special:
        return None if any(c in _bad_host and c != "%" for c in raw) else _encode(raw, frozenset())
    name = unquote_to_bytes(raw).decode("utf-8", "replace").lower()
    if not name.isascii():
        try:
            name = name.replace("。", ".").encode("idna").decode()
        except UnicodeError:
            return None
    return None if not name or any(c in _bad_host for c in name) else name


def _segments(path: str, onto: list[str], special: bool, file: bool) -> str:
    parts = re.split(r"[/\\]" if special else "/", path)
    out = list(onto)
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        dots = p.lower().replace("%2e", ".")
        if dots == "..":
            if out and not (file and len(out) == 1 and re.fullmatch("[a-zA-Z][:|]", out[0])):
                out.pop()
            if last:
                out.append("")
        elif dots == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(p, _PATH))
    return "/" + "/".join(out)


def _tail(rest: str, special: bool) -> tuple[str, str | None, str | None]:
    rest, mark, fragment = rest.partition("#")
    path, asked, query = rest.partition("?")
    return (
        path,
        _encode(query, _SPECIAL_QUERY if special else _QUERY) if asked else None,
        _encode(fragment, _FRAGMENT) if mark else None,
    )


def _authority(scheme: str, rest: str, special: bool) -> Url | None:
    m = re.match(r"[^/\\?#]*" if special else r"[^/?#]*", rest)
    auth, rest = m[0], rest[m.end() :]
    user = None
    if "@" in auth:
        login, _, auth = auth.rpartition("@")
        name, colon, word = login.partition(":")
        user = _encode(name, _USER) + (":" + _encode(word, _USER) if colon and word else "")
        user = user or None
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", auth)
    if not m or (m[2] and int(m[2]) > 65535):
        return None
    host = _host(m[1], special) if m[1] or scheme != "file" else ""
    if host is None or (special and scheme != "file" and not host):
        return None
    port = str(int(m[2])) if m[2] else None
    path, query, fragment = _tail(rest, special)
    path = _segments(path[1:], [], special, scheme == "file") if path else "/" if special else ""
    return Url(scheme, user, host, None if port == SPECIAL.get(scheme) else port, path, query, fragment)


@lru_cache(maxsize=4096)
def parse_url(text: str, base: Url | None = None) -> Url | None:
    """The URL that ``text`` means, relative to ``base``; None where the standard fails."""
    s = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    m = _scheme.match(s)
    if m:
        scheme, rest = m[1].lower(), s[m.end() :]
        special = scheme in SPECIAL
        if special and not (base is not None and base.scheme == scheme and not re.match(r"[/\\]", rest) and scheme != "file"):
            if scheme == "file":
                rest = re.sub(r"^[/\\]{2}", "", rest) if re.match(r"[/\\]{2}", rest) else rest
                return _authority(scheme, rest, True)
            return _authority(scheme, re.sub(r"^[/\\]*", "", rest), True)
        if not special:
            if rest.startswith("//"):
                return _authority(scheme, rest[2:], False)
            path, query, fragment = _tail(rest, False)
            if path.startswith("/"):
                return Url(scheme, None, None, None, _segments(path[1:], [], False, False), query, fragment)
            return Url(scheme, None, None, None, _encode(path, frozenset()), query, fragment, True)
        s = rest
    if base is None:
        return None
    if base.opaque:
        return base._replace(fragment=_encode(s[1:], _FRAGMENT)) if s.startswith("#") else None
    special = base.scheme in SPECIAL
    slash = r"[/\\]" if special else "/"
    if re.match(slash + "{2}", s):
        return _authority(base.scheme, re.sub(f"^{slash}*" if special else "^//", "", s), special)
    path, query, fragment = _tail(s, special)
    if not path:
        return base._replace(query=base.query if query is None else query, fragment=fragment)
    if re.match(slash, path):
        return base._replace(path=_segments(path[1:], [], special, base.scheme == "file"), query=query, fragment=fragment)
    onto = base.path.split("/")[1:-1]
    return base._replace(path=_segments(path, onto, special, base.scheme == "file"), query=query, fragment=fragment)


def join(base: str | None, path: str | None) -> str | None:
    """``path`` resolved against ``base``, normalised; ``path`` itself where that fails; null for a null path."""
    if path is None:
        return None
    from_ = parse_url(base) if base else None
    found = parse_url(path, from_)
    return path if found is None else str(found)


def host_of(url: str | None) -> str | None:
    """The host of a URL; None if it has none or is none."""
    u = parse_url(url) if url else None
    return (u.host or None) if u else None


def host_matches(host: str | None, domain: str) -> bool:
    """The host is the domain, or a host within it (by whole labels)."""
    return host is not None and (host == domain or host.endswith("." + domain))


@F.pandas_udf(StringType())
def url_join(base: pd.Series, path: pd.Series) -> pd.Series:
    """:func:`join` by column."""
    return pd.Series([join(b, p) for b, p in zip(base, path)], dtype=object)


@F.pandas_udf(StringType())
def url_host(url: pd.Series) -> pd.Series:
    """:func:`host_of` by column."""
    return pd.Series([host_of(u) for u in url], dtype=object)


def http_host(url: Column) -> Column:
    """The host of an absolute http(s) URL without Python: lower case, no user, no port; null for others."""
    authority = F.regexp_extract(url, r"^(?i:https?)://([^/?#\\]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))
    return F.when(host != "", host)


def without_fragment(url: Column) -> Column:
    """The URL up to its first ``#``."""
    return F.substring_index(url, "#", 1)


def in_domain(host: Column, domain: str) -> Column:
    """:func:`host_matches` as an expression."""
    return F.coalesce((host == domain) | host.endswith("." + domain), F.lit(False))
