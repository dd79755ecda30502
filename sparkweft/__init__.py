"""Web-data extraction, crawling and page analytics on Spark.

All names for everyday use; the modules have the rest.  Names are imported when they
are first used: Python workers on executors import this package for any part of it.
"""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    ".functions.jsonpath": "InvalidJson InvalidPath json_body json_field jsonpath_all",
    ".functions.patterns": "re_all re_first",
    ".functions.policy": "AutoThrottle RetryPolicy StatusRules default_headers rate_limited resolve_attempts rotated",
    ".functions.response": "CssExtractor Element ElementList JsonPathExtractor RegexExtractor Response",
    ".functions.robots": "robots_allowed",
    ".functions.sitemap": "entries read_sitemap sitemap_url",
    ".functions.urls": "http_host in_domain url_join without_fragment",
    ".operators.extract": "Count Css ExtractPlan ExtractSpec Field Links Rows XPath extract_rows",
    ".operators.items": "DropDuplicates FilterItems MapItems RequireFields run_pipeline",
    ".operators.links": "LinkExtractor",
    ".operators.model_extract": "FakeClient ModelClient ModelError TokenUsage extract_rows_with_fallback model_extract total_usage",
    ".plans.crawl": "ABORT ERROR_KINDS SKIP Crawl CrawlAborted CrawlStats DeclarativeSpider ErrorPolicy Middleware Output SitemapSpider Spider retry",
    ".sources.pages": "AttemptSource CachingSource CorpusSource MockSource PageSource read_files responses",
    ".sources.stores": "ConsoleStore CsvStore JdbcStore JsonlStore JsonStore ObjectStore SqliteStore Store StoreError",
    ".streaming.items": "into item_stream page_stream running_counts",
}
_MODULE_OF = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = sorted(_MODULE_OF)  # noqa: PLE0605


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(import_module(_MODULE_OF[name], __name__), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
