"""Sitemaps and the sitemap lines of robots files: Catalyst expressions, and one page at a time for spiders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ADDRESS = r"<loc>\s*(https?://[^\s<]+)\s*</loc>"


def sitemap_url(base: str, from_robots: bool = False) -> str:
    return base.rstrip("/") + ("/robots.txt" if from_robots else "/sitemap.xml")


def locs(body: Column) -> Column:
    """The addresses of a sitemap or index, in order; entities stay as they are written."""
    return F.coalesce(F.regexp_extract_all(body, F.lit(_ADDRESS), F.lit(1)), F.array().cast("array<string>"))


def is_robots(body: Column) -> Column:
    return F.coalesce(body.rlike(r"(?m)^(User-agent:|Sitemap:)"), F.lit(False))


def is_index(body: Column) -> Column:
    return F.coalesce(body.contains("<sitemapindex"), F.lit(False))


def robots_sitemaps(body: Column) -> Column:
    """The addresses in the ``Sitemap:`` lines of a robots file."""
    found = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*[Ss]itemap:[ \t]*(\S+)"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def _part(block: Column, tag: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"<{tag}>\s*([^\s<]+)\s*</{tag}>", 1), F.lit(""))


def urlset_entries(body: Column) -> Column:
    """``array<struct<loc, lastmod, changefreq, priority>>``; none for an index or null.

    Entries without an http(s) address are left out; a priority that is no number is null.
    """
    blocks = F.coalesce(F.regexp_extract_all(body, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1)), F.array().cast("array<string>"))
    entries = F.transform(
        blocks,
        lambda b: F.struct(
            F.nullif(F.regexp_extract(b, _ADDRESS, 1), F.lit("")).alias("loc"),
            _part(b, "lastmod").alias("lastmod"),
            _part(b, "changefreq").alias("changefreq"),
            _part(b, "priority").try_cast("float").alias("priority"),
        ),
    )
    return F.when(is_index(body), F.filter(entries, lambda e: F.lit(False))).otherwise(F.filter(entries, lambda e: e["loc"].isNotNull()))


def follows(body: Column, own_url: Column) -> Column:
    """What a crawl of sitemaps goes on to: a robots file's sitemaps, an index's or urlset's addresses but its own."""
    entries = F.transform(urlset_entries(body), lambda e: e["loc"])
    return (
        F.when(is_robots(body), robots_sitemaps(body))
        .when(is_index(body), locs(body))
        .otherwise(F.filter(entries, lambda u: u != own_url))
    )


def entries(bodies: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each entry of each urlset: ``keep``, ``pos`` and the entry's fields."""
    plain = F.when(~is_robots(F.col(body)), urlset_entries(F.col(body)))
    return bodies.select(*keep, F.posexplode(plain).alias("pos", "_e")).select(*keep, "pos", "_e.*")


def read_sitemap(body: str | None) -> tuple[list[dict], list[str]]:
    """The entries of a urlset, and the sitemaps that a robots file or an index names, of one page; see :func:`follows`."""
    body = body or ""
    if re.search(r"(?m)^(User-agent:|Sitemap:)", body):
        return [], re.findall(r"(?m)^[ \t]*[Ss]itemap:[ \t]*(\S+)", body)
    if "<sitemapindex" in body:
        return [], re.findall(_ADDRESS, body)
    entries = []
    for block in re.findall(r"(?s)<url>(.*?)</url>", body):
        loc = re.search(_ADDRESS, block)
        if loc:
            parts = {tag: re.search(rf"<{tag}>\s*([^\s<]+)\s*</{tag}>", block) for tag in ("lastmod", "changefreq", "priority")}
            entry = {"loc": loc[1]} | {tag: m[1] if m else None for tag, m in parts.items()}
            try:
                entry["priority"] = None if entry["priority"] is None else float(entry["priority"])
            except ValueError:
                entry["priority"] = None
            entries.append(entry)
    return entries, []
