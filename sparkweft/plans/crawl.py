"""Crawls: spiders, and the loop of levels that runs them over a page source."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.policy import AutoThrottle, RetryPolicy, StatusRules, rate_limited
from ..functions.response import Response
from ..functions.robots import origin
from ..functions.sitemap import read_sitemap, sitemap_url
from ..functions.urls import http_host
from ..operators.extract import ExtractSpec, to_item
from ..operators.frontier import allowed_by_robots, approximately_fresh, forced, fresh, in_domains, one_file_an_origin, within_depth
from ..operators.items import DropDuplicates, Step, run_pipeline
from ..operators.links import LinkExtractor
from ..operators.model_extract import ModelError
from ..sources.pages import CachingSource, PageSource
from ..sources.staging import BROADCAST_ROWS, staging_dir, written
from ..sources.stores import Store, StoreError

log = logging.getLogger(__name__)
_PARSED = "items array<string>, follow array<string>, error string, message string, verdict string"
_ARROW = pa.struct([("items", pa.list_(pa.string())), ("follow", pa.list_(pa.string())), ("error", pa.string()), ("message", pa.string()), ("verdict", pa.string())])
LEVEL = "spider string, url string, depth int, retry int, status int, elapsed_ms double, n_bytes bigint, items array<string>, follow array<string>, error string, message string, verdict string"
FRONTIER = "spider string, url string, depth int, retry int"
#: Kinds of errors: of a page (the first six), of a link that isn't followed (two), and of a run.
ERROR_KINDS = ("fetch", "http_status", "invalid_url", "parse", "model", "browser", "depth_exceeded", "domain_not_allowed", "store")
#: Tables of seen addresses after which they are written as one.
COMPACT_EVERY = 8


@dataclass
class Output:
    """What parsing a page gives: items (mappings) and addresses to follow."""

    items: list = field(default_factory=list)
    follow: list[str] = field(default_factory=list)

    def item(self, item) -> Output:
        self.items.append(item)
        return self

    def follow_many(self, urls: Sequence[str]) -> Output:
        self.follow.extend(urls)
        return self


class ErrorPolicy(NamedTuple):
    """What becomes of a page that failed: it is skipped, ends the crawl, or is requested again up to n times."""

    kind: str
    times: int = 0

    def __str__(self) -> str:
        return f"{self.kind}:{self.times}"


SKIP, ABORT = ErrorPolicy("skip"), ErrorPolicy("abort")


def retry(times: int) -> ErrorPolicy:
    return ErrorPolicy("retry", times)


class CrawlAborted(RuntimeError):
    """A page failed and its spider's policy is to abort."""


class Spider:
    """User code of a crawl; ``parse`` and ``on_error`` run on the executors, the hooks on the driver."""

    name = "spider"
    start_urls: Sequence[str] = ()
    max_depth: int | None = None
    allowed_domains: Sequence[str] = ()

    def parse(self, response: Response) -> Output:
        raise NotImplementedError

    def on_error(self, url: str, kind: str) -> ErrorPolicy:
        return SKIP

    def open(self) -> None:
        """Before the crawl; an exception keeps it from starting."""

    def close(self, stats: CrawlStats) -> None:
        """After the crawl; exceptions are logged only."""


class DeclarativeSpider(Spider):
    """A spider of an item spec for each match of ``rows`` and links to follow."""

    def __init__(self, name: str, start_urls: Sequence[str], rows: str, spec: ExtractSpec, links: LinkExtractor | None = None, max_depth: int | None = None, allowed_domains: Sequence[str] = ()):
        self.name, self.start_urls, self.rows, self.spec, self.links = name, start_urls, rows, spec, links
        self.max_depth, self.allowed_domains = max_depth, allowed_domains

    def parse(self, response: Response) -> Output:
        tree = response.tree
        if tree is None:
            return Output()
        items = [self.spec.extract(e.node) for e in response.css(self.rows)]
        return Output(items, self.links.of_tree(tree, response.url) if self.links else [])


class SitemapSpider(Spider):
    """Follows a site's sitemaps, from ``sitemap.xml`` or the lines of its robots file, and gives an item an entry.

    ``keep`` decides by address which entries become items and are followed.
    """

    def __init__(self, base: str, name: str = "sitemap", from_robots: bool = False, keep: Callable[[str], bool] | None = None, sitemap: str | None = None):
        self.name, self.keep = name, keep
        self.start_urls = [sitemap or sitemap_url(base, from_robots)]

    def filter_url(self, keep: Callable[[str], bool]) -> SitemapSpider:
        self.keep = keep
        return self

    def parse(self, response: Response) -> Output:
        entries, follow = read_sitemap(response.text())
        kept = [e for e in entries if self.keep is None or self.keep(e["loc"])]
        return Output(kept, follow + [e["loc"] for e in kept if e["loc"] != response.url])


class CrawlStats(NamedTuple):
    spider: str
    pages_crawled: int
    items_scraped: int
    errors: int
    bytes_downloaded: int
    interrupted: bool = False

    def pages_per_second(self, seconds: float) -> float:
        return self.pages_crawled / seconds if seconds > 0 else 0.0


class Middleware:
    """Transforms around the fetch of a level, in the order in which they were added; each by default does nothing."""

    def before_request(self, requests: DataFrame) -> DataFrame:
        """May drop requests, and add columns such as headers or a proxy."""
        return requests

    def after_response(self, responses: DataFrame) -> DataFrame:
        """May change the response columns ahead of parsing."""
        return responses

    def on_error(self, failures: DataFrame) -> None:
        """Gets the failed pages of each level (as in ``LEVEL``), whether they are requested again or not."""


def parse_column(spiders: Sequence[Spider], rules: StatusRules | None) -> Column:
    """The struct of ``_PARSED`` for fetched rows; each page is parsed once by its spider."""
    by = {s.name: s for s in spiders}
    bad = rules.is_error(F.col("url"), F.col("status")) if rules else F.lit(False)
    kind = F.when(http_host(F.col("url")).isNull(), "invalid_url").when(F.col("status").isNull(), "fetch").when(bad, "http_status")

    def one(spider: str, url: str, status: int | None, headers, ms: float, text, raw, depth: int, error: str | None) -> dict:
        s, message = by[spider], None
        if error is None:
            body = text if text is not None else raw if raw is not None else ""
            try:
                out = s.parse(Response(url, body, status, dict(headers or ()), ms, depth))
                return {"items": [to_item(i) for i in out.items], "follow": list(out.follow), "error": None, "message": None, "verdict": None}
            except Exception as e:  # user code; the page fails, the crawl goes on
                error, message = "model" if isinstance(e, ModelError) else "parse", repr(e)
        return {"items": [], "follow": [], "error": error, "message": message, "verdict": str(s.on_error(url, error))}

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns))], _ARROW)

    return F.arrow_udf(run, _PARSED)("spider", "url", "status", "headers", "elapsed_ms", "body_text", "body_bytes", "depth", kind)


@dataclass(frozen=True)
class Crawl:
    """How spiders are run.  Each method gives a changed copy.

    Robots files are respected: they are fetched from the source, unless a table of
    them is given.  Levels are written to ``state`` (by default a new folder for
    intermediate tables).  A crawl that finds levels of an earlier run there goes on after
    the last complete one.  A level is one table; the next one's requests are its links
    less all addresses of the levels so far.
    """

    spark: SparkSession
    source: PageSource
    middlewares: tuple[Middleware, ...] = ()
    steps: tuple[Step, ...] = ()
    stores: tuple[Store, ...] = ()
    rules: StatusRules | None = None
    robots: DataFrame | bool = True
    agent: str = "sparkweft"
    state: str | None = None
    stop: Callable[[], bool] | None = None
    seeds: DataFrame | None = None
    delay_ms: int = 0
    throttle: AutoThrottle | None = None
    per_second: float | None = None
    metrics_every: int = 0
    expected: int | None = None
    false_positives: float = 0.001

    def middleware(self, *added: Middleware) -> Crawl:
        return replace(self, middlewares=self.middlewares + added)

    def request_middleware(self, step: Step) -> Crawl:
        """A transform of requests ahead of the fetch; it may add columns."""
        m = Middleware()
        m.before_request = step
        return self.middleware(m)

    def pipeline(self, *steps: Step) -> Crawl:
        return replace(self, steps=self.steps + steps)

    def store(self, store: Store) -> Crawl:
        return replace(self, stores=(*self.stores, store))

    def status_retry(self, rules: StatusRules | None = None) -> Crawl:
        return replace(self, rules=rules or StatusRules())

    def retry_policy(self, policy: RetryPolicy) -> Crawl:
        """Retries within a fetch, for sources that have recorded attempts; others would give the same again."""
        with_retry = getattr(self.source, "with_retry", None)
        return replace(self, source=with_retry(policy)) if with_retry else self

    def retry(self, times: int) -> Crawl:
        return self.retry_policy(RetryPolicy(times))

    def respect_robots(self, robots: DataFrame | bool = True, agent: str = "sparkweft") -> Crawl:
        """With robots files as a table (``origin``, ``txt``), or from the source; False to ignore them."""
        return replace(self, robots=robots, agent=agent)

    def http_cache(self, path: str, ttl: int | None = None, now: int | None = None) -> Crawl:
        """Text responses are kept in a table at ``path`` and served from there for ``ttl`` seconds."""
        return replace(self, source=CachingSource(self.source, path, ttl, now))

    def seeded(self, urls: DataFrame) -> Crawl:
        """With the addresses in a table, of any size, as further seeds: (``spider``, ``url``), or ``url`` for every spider."""
        return replace(self, seeds=urls)

    def resumable(self, folder: str) -> Crawl:
        return replace(self, state=folder)

    def clear(self) -> None:
        """Removes the levels of a resumable crawl, so that it begins anew."""
        if self.state:
            path, system = self._path(self.state)
            system.delete(path, True)

    def stop_when(self, asked: Callable[[], bool]) -> Crawl:
        """``asked`` is called between levels; once true, no further level is begun."""
        return replace(self, stop=asked)

    def crawl_delay(self, ms: int) -> Crawl:
        """A pause ahead of each request: it shows in :meth:`log`, nothing sleeps."""
        return replace(self, delay_ms=ms)

    def _warned(self) -> Crawl:
        if self.throttle and self.per_second:
            log.warning("both a throttle and a rate limit are set; requests wait for the later of the two")
        return self

    def autothrottle(self, throttle: AutoThrottle) -> Crawl:
        return replace(self, throttle=throttle)._warned()

    def rate_limit(self, per_second: float) -> Crawl:
        return replace(self, per_second=per_second)._warned()

    def metrics_interval(self, levels: int) -> Crawl:
        """Running counters are logged after each so many levels."""
        return replace(self, metrics_every=levels)

    def max_urls(self, expected: int, false_positives: float = 0.001) -> Crawl:
        """Seen addresses are kept approximately, in a Bloom filter for so many: a few new ones may count as seen."""
        return replace(self, expected=expected, false_positives=false_positives)

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, system = self._path(path + "/_SUCCESS")
        return system.exists(p)

    def _recorded_robots(self) -> DataFrame | bool:
        """The robots files that count in the whole crawl, a row an origin; True if the source has to be asked at each level, False for none."""
        robots = self.robots
        if robots is True:
            of_source = getattr(self.source, "robots", None)
            robots = of_source() if of_source else True
        if isinstance(robots, bool):
            return robots
        files = written(one_file_an_origin(robots), staging_dir(self.spark, "robots"))
        n = files.count()
        return (F.broadcast(files) if n <= BROADCAST_ROWS else files) if n else False

    def _robots_of(self, requests: DataFrame) -> DataFrame:
        """The robots files of the requests' origins, as the source has them."""
        sites = requests.select(origin(F.col("url")).alias("origin")).where("origin is not null").distinct()
        files = self.source.fetch(sites.select("origin", F.concat("origin", F.lit("/robots.txt")).alias("url")))
        return one_file_an_origin(files.where("status between 200 and 299 and body_text is not null").select("origin", F.col("body_text").alias("txt")))

    def _level(self, spiders: Sequence[Spider], requests: DataFrame, robots: DataFrame | bool) -> DataFrame:
        if robots is not False:
            requests = allowed_by_robots(requests, self._robots_of(requests) if robots is True else robots, self.agent)
        for m in self.middlewares:
            requests = m.before_request(requests)
        fetched = self.source.fetch(requests)
        for m in self.middlewares:
            fetched = m.after_response(fetched)
        size = F.coalesce(F.octet_length("body_text"), F.octet_length("body_bytes"), F.lit(0)).cast("bigint")
        done = fetched.withColumn("_p", parse_column(spiders, self.rules))
        n_bytes = F.when(F.col("_p.error").isNull(), size).otherwise(F.lit(0)).cast("bigint").alias("n_bytes")
        return done.select("spider", "url", "depth", "retry", "status", "elapsed_ms", n_bytes, "_p.*")

    def _first(self, spiders: Sequence[Spider]) -> DataFrame:
        seeds = self.spark.createDataFrame([(s.name, u, 0, 0) for s in spiders for u in s.start_urls], FRONTIER)
        if self.seeds is not None and "spider" in self.seeds.columns:
            seeds = seeds.unionByName(self.seeds.select("spider", "url", F.lit(0).alias("depth"), F.lit(0).alias("retry")))
        elif self.seeds is not None:
            for s in spiders:
                seeds = seeds.unionByName(self.seeds.select(F.lit(s.name).alias("spider"), "url", F.lit(0).alias("depth"), F.lit(0).alias("retry")))
        return fresh(seeds, None)

    def _next(self, spiders: Sequence[Spider], level: DataFrame, seen: DataFrame) -> DataFrame:
        """The requests that follow a level: links that were not seen, and retries."""
        passes = F.lit(False)
        for s in spiders:
            passes = passes | ((F.col("spider") == s.name) & in_domains(F.col("url"), tuple(s.allowed_domains)))
        links = level.select("spider", F.explode("follow").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("retry"))
        links = links.where(within_depth(F.col("depth"), {s.name: s.max_depth for s in spiders}) & passes & F.col("url").isNotNull())
        times = F.regexp_extract("verdict", "^retry:([0-9]+)$", 1)
        again = level.where((times != "") & (F.col("retry") < times.try_cast("int")))
        again = again.select("spider", "url", "depth", (F.col("retry") + 1).alias("retry"))
        unseen = approximately_fresh(links, seen, self.expected, self.false_positives) if self.expected else fresh(links, seen)
        return forced(unseen, again)

    def levels(self, spiders: Sequence[Spider]) -> Iterator[DataFrame]:
        """The pages of each level, as each is done; closing the iterator ends the crawl."""
        spark, k = self.spark, 0
        root = self.state or staging_dir(spark, "crawl")
        at = lambda what, k: f"{root}/{what}/{k:06d}"
        level, pieces, robots = None, [], None
        while True:
            if not self._exists(at("level", k)):
                if self.stop and self.stop():
                    return
                following = self._first(spiders) if level is None else self._next(spiders, level, spark.read.schema("spider string, url string").parquet(*pieces))
                # materialised ahead of the fetch: its size decides whether joins with what was recorded broadcast it
                requests = following.persist()
                try:
                    if not requests.count():
                        return
                    robots = self._recorded_robots() if robots is None else robots
                    self._level(spiders, requests, robots).write.mode("overwrite").parquet(at("level", k))
                finally:
                    requests.unpersist()
                level = spark.read.schema(LEVEL).parquet(at("level", k))
                failed = level.where("error is not null")
                if self.middlewares or any(type(s).on_error is not Spider.on_error for s in spiders):
                    for m in self.middlewares:
                        m.on_error(failed)
                    aborted = failed.where("verdict like 'abort%'").orderBy("url").select("url", "error").first()
                    if aborted:
                        raise CrawlAborted(f"{aborted['url']}: {aborted['error']}")
                if isinstance(self.source, CachingSource):
                    self.source.remember(self.source.fetch(level.select("url").distinct()))
            else:
                level = spark.read.schema(LEVEL).parquet(at("level", k))
            yield level
            pieces.append(at("level", k))
            k += 1
            if len(pieces) > COMPACT_EVERY:
                if not self._exists(at("seen", k)):
                    spark.read.schema("spider string, url string").parquet(*pieces).distinct().write.mode("overwrite").parquet(at("seen", k))
                pieces = [at("seen", k)]

    def pages(self, spiders: Sequence[Spider]) -> DataFrame:
        """Crawls, and gives the pages of all levels with their ``level``."""
        done = self.spark.createDataFrame([], LEVEL).withColumn("level", F.lit(0))
        parts: list[DataFrame] = []
        for k, level in enumerate(self.levels(spiders)):
            parts.append(level.withColumn("level", F.lit(k)))
            if self.metrics_every and not (k + 1) % self.metrics_every:
                c = reduce(DataFrame.unionByName, parts).agg(F.count("*").alias("pages"), F.sum(F.size("items")).alias("items"), F.count("error").alias("errors")).first()
                log.info("after %d levels: %d pages, %d items, %d errors", k + 1, c["pages"], c["items"], c["errors"])
        return reduce(DataFrame.unionByName, parts) if parts else done

    def _items(self, pages: DataFrame) -> DataFrame:
        """The items of pages with their ``level``, in the order ``seq``."""
        each = pages.select("spider", "url", "depth", "level", F.posexplode("items").alias("pos", "item"))
        return each.withColumn("seq", F.struct("level", "url", "pos")).drop("level")

    def log(self, pages: DataFrame) -> DataFrame:
        """Events of a crawl's :meth:`pages`: what became of each request, and when it was due.

        ``event`` is ``fetch.ok``, ``retry``, ``skip`` or ``abort``; ``turn`` the place of a request
        when spiders take turns within a level; ``delay_ms`` the crawl's delay, or that of the
        throttle of the host if it is larger; ``due_us`` when its host's rate limit lets it start.
        """
        again = F.col("retry") < F.coalesce(F.regexp_extract("verdict", "^retry:([0-9]+)$", 1).try_cast("int"), F.lit(0))
        event = F.when(F.col("error").isNull(), "fetch.ok").when(F.col("verdict").startswith("abort"), "abort").when(again, "retry").otherwise("skip")
        order = Window.partitionBy("level", "spider").orderBy("url", "retry")
        out = pages.withColumn("turn", F.row_number().over(order)).withColumn("host", http_host(F.col("url"))).select(
            "level", "turn", "spider", "url", "host", "depth", "retry", event.alias("event"), "error", "message", "status", "n_bytes", F.size("items").alias("n_items"), "elapsed_ms"
        )
        delay, places = F.lit(float(self.delay_ms)), ("level", "turn", "spider", "url")
        if self.throttle:
            out = self.throttle.trace(out, ("host",), places).drop("ewma_ms").withColumn("delay_ms", F.greatest("delay_ms", delay))
        else:
            out = out.withColumn("delay_ms", delay)
        if self.per_second:
            out = rate_limited(out.withColumn("_at", F.lit(0).cast("bigint")), self.per_second, "_at", places, ("host",)).drop("_at").withColumnRenamed("start_us", "due_us")
        return out

    def run_all(self, spiders: Sequence[Spider]) -> list[CrawlStats]:
        """Crawls by all spiders, each with a frontier of its own; pipelines and stores see the items of all.

        Nothing is stored if the crawl aborts.  A store that fails ends the run; stores
        ahead of it keep what they have.  Keys of persistent deduplication are added last.
        """
        if not spiders:
            return []
        if len({s.name for s in spiders}) < len(spiders):
            raise ValueError("spiders need different names")
        for s in spiders:
            s.open()
        pages = self.pages(spiders)
        items, accepted = self._items(pages), []
        for step in self.steps:
            items = step(items)
            if isinstance(step, DropDuplicates) and step.seen:
                items = written(items, staging_dir(self.spark, "kept"))
                accepted.append((step, items))
        items = written(items, staging_dir(self.spark, "items"))
        for store in self.stores:
            try:
                store.write(items)
            except StoreError:
                raise
            except Exception as e:
                raise StoreError(f"{type(store).__name__}: {e}") from e
        for step, kept in accepted:
            step.remember(kept)
        interrupted = bool(self.stop and self.stop())
        counted = {r["spider"]: r for r in crawl_stats(pages, items).collect()}
        out = []
        for s in spiders:
            r = counted.get(s.name)
            stats = CrawlStats(s.name, *((r["pages_crawled"], r["items_scraped"], r["errors"], r["bytes_downloaded"]) if r else (0, 0, 0, 0)), interrupted)
            out.append(stats)
            try:
                s.close(stats)
            except Exception as e:  # user code, and the crawl is over
                log.warning("close of %s: %r", s.name, e)
        return out

    def run(self, spider: Spider) -> CrawlStats:
        return self.run_all([spider])[0]

    def stream(self, spider: Spider) -> Iterator[str]:
        """The items, level by level; a consumer that stops early stops the crawl.  Stores are not used."""
        spider.open()
        for k, level in enumerate(self.levels([spider])):
            for r in run_pipeline(self._items(level.withColumn("level", F.lit(k))), self.steps).select("item").toLocalIterator(prefetchPartitions=True):
                yield r[0]


def unfollowed(pages: DataFrame, spiders: Sequence[Spider]) -> DataFrame:
    """The links of crawled pages that their spiders' limits exclude: ``(spider, url, error)``, of one that both exclude ``depth_exceeded``."""
    passes = F.lit(False)
    for s in spiders:
        passes = passes | ((F.col("spider") == s.name) & in_domains(F.col("url"), tuple(s.allowed_domains)))
    links = pages.select("spider", F.explode("follow").alias("url"), (F.col("depth") + 1).alias("depth"))
    near = within_depth(F.col("depth"), {s.name: s.max_depth for s in spiders})
    return links.select("spider", "url", F.when(~near, "depth_exceeded").when(~passes, "domain_not_allowed").alias("error")).where("error is not null").distinct()


def crawl_stats(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Counters by spider: pages parsed (whatever their status), items kept, failures, and bytes of parsed bodies."""
    ok = F.col("error").isNull()
    by_page = pages.groupBy("spider").agg(
        F.count_if(ok).alias("pages_crawled"), F.count_if(~ok).alias("errors"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes_downloaded")
    )
    by_item = items.groupBy("spider").agg(F.count("*").alias("n"))
    return by_page.join(by_item, "spider", "left").select("spider", "pages_crawled", F.coalesce("n", F.lit(0)).alias("items_scraped"), "errors", "bytes_downloaded")
