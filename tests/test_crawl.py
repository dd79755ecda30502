"""Crawls, policies and stores on literal pages."""

from __future__ import annotations

import json
import os
import sqlite3
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sparkweft.functions.policy import AutoThrottle, RetryPolicy, StatusRules, rate_limited, resolve_attempts
from sparkweft.operators.extract import ExtractSpec, Field
from sparkweft.operators.items import DropDuplicates, RequireFields
from sparkweft.operators.links import LinkExtractor
from sparkweft.operators.frontier import approximately_fresh, fresh
from sparkweft.plans.crawl import ABORT, Crawl, CrawlAborted, DeclarativeSpider, Middleware, Output, SitemapSpider, Spider, retry, unfollowed
from sparkweft.plans.queries import BOOK, catalogue
from sparkweft.sources.pages import AttemptSource, CachingSource, CorpusSource, MockSource, read_files, responses, write_files
from sparkweft.sources.stores import CsvStore, JdbcStore, JsonlStore, JsonStore, ObjectStore, SqliteStore, StoreError, table_name
from sparkweft.streaming.items import into, item_stream, page_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SITE = {
    "http://a.com/": (200, "<title>home</title><a href='/b'>b</a><a href='/c'>c</a><a href='http://other.org/'>o</a>"),
    "http://a.com/b": (200, "<title>b</title><a href='/'>home</a><a href='/c'>c</a>"),
    "http://a.com/c": (503, "<title>busy</title>"),
}


class Titles(Spider):
    name = "titles"
    start_urls = ("http://a.com/", "http://a.com/")
    allowed_domains = ("a.com",)

    def parse(self, response):
        t = response.css("title").first()
        out = Output(follow=LinkExtractor().of_tree(response.tree, response.url))
        return out.item({"title": t.text()}) if t else out


class Retrying(Titles):
    name = "retrying"

    def on_error(self, url, kind):
        return retry(2)


class Aborting(Titles):
    name = "aborting"

    def on_error(self, url, kind):
        return ABORT


def test_crawl_visits_each_page_once_and_stays_in_its_domain(spark):
    s = Crawl(spark, MockSource(spark, SITE)).run(Titles())
    assert (s.pages_crawled, s.items_scraped, s.errors) == (3, 3, 0)


def test_status_errors_retries_and_abort(spark):
    crawl = Crawl(spark, MockSource(spark, SITE)).status_retry()
    assert crawl.run(Titles())[1:4] == (2, 2, 1)
    assert crawl.run(Retrying()).errors == 3  # the page and two more requests
    with pytest.raises(CrawlAborted):
        crawl.run(Aborting())


def test_two_spiders_have_frontiers_of_their_own_and_robots_are_respected(spark):
    robots = spark.createDataFrame([("http://a.com", "User-agent: *\nDisallow: /b")], "origin string, txt string")
    stats = Crawl(spark, MockSource(spark, SITE)).respect_robots(robots).run_all([Titles(), Retrying()])
    assert [s.pages_crawled for s in stats] == [2, 2]
    assert Crawl(spark, MockSource(spark, SITE)).run_all([]) == []


def test_a_crawl_resumes_after_its_last_level_and_streams(spark, tmp_path):
    crawl = Crawl(spark, MockSource(spark, SITE)).resumable(str(tmp_path / "s"))
    levels = crawl.levels([Titles()])
    next(levels)
    levels.close()
    dead = Crawl(spark, MockSource(spark, {}), state=crawl.state)  # the first level is read, not fetched
    assert dead.run(Titles()).items_scraped == 1
    stream = Crawl(spark, MockSource(spark, SITE)).stream(Titles())
    assert json.loads(next(stream)) == {"title": "home"}
    stream.close()


def test_catalogue_is_crawled_level_by_level(spark):
    pages = catalogue(spark).where("url rlike 'page-([1-4])[.]html'")
    spider = DeclarativeSpider("books", ["http://mockserver/catalogue/page-1.html"], "article.product_pod", BOOK, LinkExtractor().restrict_css("li.next"), max_depth=2)
    s = Crawl(spark, CorpusSource(responses(pages))).run(spider)
    assert s.items_scraped == 60 and s.errors == 0


def test_attempts_and_cache(spark, tmp_path):
    rows = [("u", 0, 503, ""), ("u", 1, 503, ""), ("u", 2, 200, "ok"), ("v", 0, None, None), ("v", 1, None, None)]
    tries = spark.createDataFrame(rows, "url string, attempt int, status int, body string")
    got = {r["url"]: r for r in resolve_attempts(tries, RetryPolicy(3, 100)).collect()}
    assert (got["u"]["fetches"], got["u"]["ok"], got["u"]["waited_ms"]) == (3, True, 300.0)
    assert (got["v"]["fetches"], got["v"]["ok"]) == (2, False)
    asked = spark.createDataFrame([("u", 0)], "url string, retry int")
    assert AttemptSource(tries, RetryPolicy(2)).fetch(asked).first()["status"] == 200
    assert AttemptSource(tries, RetryPolicy(1)).fetch(asked).first()["status"] == 503
    cache = CachingSource(MockSource(spark, SITE), str(tmp_path / "cache"), ttl=10, now=100)
    home = spark.createDataFrame([("http://a.com/",)], "url string")
    cache.remember(cache.fetch(home))
    later = CachingSource(MockSource(spark, {}), cache.path, ttl=10, now=109)
    assert later.fetch(home).first()["status"] == 200
    assert CachingSource(MockSource(spark, {}), cache.path, ttl=0, now=100).fetch(home).first()["status"] == 404


class Watching(Middleware):
    """Adds a header, turns one status, and keeps what failed."""

    def __init__(self):
        self.failed = []

    def before_request(self, requests):
        return requests.withColumn("sent", F.lit("x"))

    def after_response(self, responses):
        return responses.withColumn("status", F.when(F.col("sent") == "x", F.when(F.col("url").endswith("/b"), 500).otherwise(F.col("status"))))

    def on_error(self, failures):
        self.failed += [(r.url, r.error) for r in failures.collect()]


def test_middleware_sees_requests_responses_and_errors(spark):
    watching = Watching()
    pages = Crawl(spark, MockSource(spark, SITE)).middleware(watching).status_retry().pages([Retrying()])
    assert sorted(watching.failed) == [("http://a.com/b", "http_status")] * 3 + [("http://a.com/c", "http_status")] * 3
    far = unfollowed(pages, [Titles(), Retrying()]).collect()
    assert [(r.url, r.error) for r in far] == [("http://other.org/", "domain_not_allowed")]


def test_errors_have_kinds_and_messages(spark):
    class Broken(Titles):
        name, start_urls = "broken", ("http://a.com/", "mailto:a@b.org", "http://none.com/")

        def parse(self, response):
            raise KeyError("gone")

    source = MockSource(spark, {"http://a.com/": (200, "x")}, (None, None))
    got = {r.url: (r.error, r.message) for r in Crawl(spark, source).pages([Broken()]).collect()}
    assert got == {"http://a.com/": ("parse", "KeyError('gone')"), "mailto:a@b.org": ("invalid_url", None), "http://none.com/": ("fetch", None)}


def test_robots_files_come_from_the_source(spark):
    site = SITE | {"http://a.com/robots.txt": (200, "User-agent: *\nDisallow: /b")}
    for source in (MockSource(spark, site), CachingSource(MockSource(spark, site), "/nonexistent/none"), MockSource(spark, site).indexed()):
        assert len(Crawl(spark, source)._recorded_robots().collect()) == 1
    assert sorted(r.url for r in Crawl(spark, MockSource(spark, site)).pages([Titles()]).collect()) == ["http://a.com/", "http://a.com/c"]
    assert Crawl(spark, MockSource(spark, site)).respect_robots(False).run(Titles()).pages_crawled == 3
    anywhere = MockSource(spark, {"http://a.com/": SITE["http://a.com/"]}, (200, "User-agent: *\nDisallow: /c"))
    assert sorted(r.url for r in Crawl(spark, anywhere).pages([Titles()]).collect()) == ["http://a.com/", "http://a.com/b"]


def test_cache_seen_keys_and_log_of_a_crawl(spark, tmp_path):
    step = DropDuplicates.by_field("title").with_persistence(str(tmp_path / "seen"))
    crawl = Crawl(spark, MockSource(spark, SITE)).http_cache(str(tmp_path / "cache"), now=5).pipeline(step).metrics_interval(1).retry(2)
    assert crawl.run(Titles()).items_scraped == 3
    again = Crawl(spark, MockSource(spark, {})).http_cache(str(tmp_path / "cache")).pipeline(step)
    assert again.run(Titles())[1:3] == (3, 0)  # pages from the cache, items known
    crawl = Crawl(spark, MockSource(spark, SITE)).crawl_delay(40).autothrottle(AutoThrottle(1.0, 100, 10, 500)).rate_limit(1)
    rows = {r.url: r for r in crawl.log(crawl.max_urls(1000).pages([Titles()])).collect()}
    assert {u: (r.event, r.level) for u, r in rows.items()} == {"http://a.com/": ("fetch.ok", 0), "http://a.com/b": ("fetch.ok", 1), "http://a.com/c": ("fetch.ok", 1)}
    state, want = (100.0, 100.0), []
    for status in (200, 200, 503):
        state = AutoThrottle(1.0, 100, 10, 500).step(*state, 0.0, status)
        want.append(max(40.0, state[0]))
    assert [(rows[f"http://a.com/{u}"].delay_ms, rows[f"http://a.com/{u}"].due_us) for u in ("", "b", "c")] == [*zip(want, (0, 1_000_000, 2_000_000))]


def test_sitemaps_are_followed_and_filtered(spark):
    entry = lambda u, p: f"<url><loc>{u}</loc><lastmod>a b</lastmod><priority>{p}</priority></url>"
    site = {
        "http://s.org/robots.txt": (200, "User-agent: *\nSitemap: http://s.org/index.xml"),
        "http://s.org/index.xml": (200, "<sitemapindex><loc>http://s.org/m.xml</loc></sitemapindex>"),
        "http://s.org/m.xml": (200, entry("http://s.org/keep", "0.5") + entry("http://s.org/m.xml", "x") + entry("http://s.org/drop", "1")),
        "http://s.org/keep": (200, "<p>page</p>"),
    }
    spider = SitemapSpider("http://s.org/", from_robots=True).filter_url(lambda u: "drop" not in u)
    pages = Crawl(spark, MockSource(spark, site)).pages([spider]).collect()
    assert {(r.url, r.depth) for r in pages} == {("http://s.org/robots.txt", 0), ("http://s.org/index.xml", 1), ("http://s.org/m.xml", 2), ("http://s.org/keep", 3)}
    items = [json.loads(i) for r in pages for i in r["items"]]
    assert items == [{"loc": "http://s.org/keep", "lastmod": None, "changefreq": None, "priority": 0.5}, {"loc": "http://s.org/m.xml", "lastmod": None, "changefreq": None, "priority": None}]
    assert SitemapSpider("http://s.org/").start_urls == ["http://s.org/sitemap.xml"]


def test_approximate_frontier_never_passes_a_seen_address(spark):
    seen = spark.range(2000).select(F.lit("s").alias("spider"), F.concat(F.lit("u"), "id").alias("url"))
    asked = spark.range(1000, 4000).select(F.lit("s").alias("spider"), F.concat(F.lit("u"), "id").alias("url"))
    exact = {r.url for r in fresh(asked, seen).collect()}
    got = {r.url for r in approximately_fresh(asked, seen, 2000, 0.01).collect()}
    assert got <= exact and len(got) > 0.97 * len(exact)
    assert approximately_fresh(asked, seen.limit(0), 10).count() == 3000


def test_jdbc_store_on_an_embedded_database(spark):
    url = "jdbc:derby:memory:items;create=true"
    items = spark.createDataFrame([(1, '{"a":"x"}'), (2, '{"b":[1]}')], "seq int, item string")
    for _ in range(2):
        JdbcStore(url, "t_1", [("a", "CLOB")], {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).write(items)
    rows = spark.read.jdbc(url, '"t_1"', properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).collect()
    assert sorted((r["data"], r["a"] or "") for r in rows) == [('{"a":"x"}', "x")] * 2 + [('{"b":[1]}', "")] * 2 and len({r["id"] for r in rows}) == 4
    assert JdbcStore("jdbc:mysql://h/d").ddl().startswith("CREATE TABLE IF NOT EXISTS `items` (`id` BIGINT AUTO_INCREMENT PRIMARY KEY, `data` JSON")
    with pytest.raises(StoreError):
        JdbcStore("jdbc:other:x")


def test_a_store_that_fails_ends_the_run(spark, tmp_path):
    class Full:
        def write(self, items):
            raise OSError("disk full")

    good = JsonlStore(str(tmp_path / "good"))
    with pytest.raises(StoreError, match="Full: disk full"):
        Crawl(spark, MockSource(spark, SITE)).store(good).store(Full()).run(Titles())
    assert spark.read.text(str(tmp_path / "good")).count() == 3
    ObjectStore(str(tmp_path), kind="json", filename="none.json").write(spark.createDataFrame([], "item string"))
    assert not (tmp_path / "none.json").exists()


def test_objects_are_read_item_by_item(spark, tmp_path):
    # an array was read as one value, whose size is bounded
    given = ['{"b":1,"a":"x, ]"}', '{\n"c": [\r\n2]}', '{"d":"[,"}']
    for kind in ("json", "jsonl"):
        store = ObjectStore(str(tmp_path), kind=kind, filename=f"o.{kind}")
        assert store.read(spark).collect() == []
        store.write(spark.createDataFrame([(t,) for t in given], "item string"))
        assert sorted(r.item for r in store.read(spark).collect()) == sorted(t.replace("\n", " ").replace("\r", " ") for t in given)
        plan = store.read(spark)._jdf.queryExecution().optimizedPlan().toString()
        assert "wholetext" not in plan and "parse_json" not in plan
    (part,) = (tmp_path / "o.json").glob("part-*")
    assert len(json.loads(part.read_text())) == 3


def test_page_files_are_listed_and_read_by_tasks(spark, tmp_path):
    # each page had a folder and a commit of its own, and all files were listed by the driver
    rows = [(i, "é" * i) for i in range(50)]
    write_files(spark.createDataFrame(rows, "page_id bigint, html string"), str(tmp_path / "f"), per_folder=10)
    (tmp_path / "f" / "0" / "other.csv").write_text("x")
    assert len(list((tmp_path / "f").iterdir())) == 5
    read = read_files(spark, f"{tmp_path}/f/*/*.txt")
    assert not read.inputFiles()
    assert sorted((r.url.rsplit("=")[1], r.status, r.body_text) for r in read.collect()) == sorted((f"{i}.txt", 200, t + "\n") for i, t in rows)
    assert read_files(spark, f"{tmp_path}/f/0/*.csv").first()["url"].endswith("/f/0/other.csv")
    assert read_files(spark, f"{tmp_path}/none/*/*.txt").count() == 0


def test_policies(spark):
    log = spark.createDataFrame([(i, 0) for i in range(5)], "id int, at bigint")
    assert [r.start_us for r in rate_limited(log, 2, "at", ("id",)).orderBy("id").collect()] == [0, 0, 500_000, 1_000_000, 1_500_000]
    t = AutoThrottle(1.0, 500, 10, 2000)
    log = spark.createDataFrame([("h", i, 100.0, s) for i, s in enumerate([200, 429, 429, 429, 200])], "host string, i int, elapsed_ms double, status int")
    want, state = [], (500.0, 500.0)
    for s in (200, 429, 429, 429, 200):
        state = t.step(*state, 100.0, s)
        want.append(state[0])
    assert [r.delay_ms for r in t.trace(log, ("host",), ("i",)).orderBy("i").collect()] == want
    rules = StatusRules().for_pattern("^x", [])
    row = spark.createDataFrame([("xa", 500), ("b", 500)], "url string, status int").select(rules.is_error(F.col("url"), F.col("status")).alias("e"))
    assert [r.e for r in row.collect()] == [False, True]


def test_stores(spark, tmp_path):
    items = spark.createDataFrame([(1, '{"a":"x, \\"y\\"","b":null}'), (2, '{"a":1,"c":[1]}')], "seq int, item string")
    JsonStore(str(tmp_path / "o" / "i.json")).write(items)
    assert json.loads((tmp_path / "o" / "i.json").read_text())[1] == {"a": 1, "c": [1]}
    JsonStore(str(tmp_path / "none.json")).write(items.limit(0))
    assert (tmp_path / "none.json").read_text() == "[]"
    for _ in range(2):
        JsonlStore(str(tmp_path / "l")).write(items)
    assert spark.read.text(str(tmp_path / "l")).count() == 4
    CsvStore(str(tmp_path / "c"), order=("seq",)).write(items.coalesce(1))
    assert {r[0] for r in spark.read.text(str(tmp_path / "c")).collect()} == {"a,b", '"x, ""y""",', "1,"}
    SqliteStore(str(tmp_path / "db"), "t_1", columns=[("a", "TEXT")]).write(items)
    with sqlite3.connect(tmp_path / "db") as db:
        assert db.execute("select a from t_1 order by id").fetchall() == [('x, "y"',), ("1",)]
    for bad in ("", "a" * 64, "items; DROP TABLE users;--"):
        with pytest.raises(StoreError):
            table_name(bad)
    kept = RequireFields("b")(items).collect()
    assert [r.seq for r in kept] == [1]
    assert DropDuplicates.by_field("a")(items.unionByName(items)).count() == 2


def test_stream_of_pages(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>a</p><p>b</p>"), (2, "v", "<p>a</p>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "in"))
    items = item_stream(page_stream(spark, str(tmp_path / "in")), "p", ExtractSpec(Field("t", "p")))
    into(DropDuplicates.by_field("t").on_stream(items), JsonlStore(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"t":"a"}', '{"t":"b"}']


def test_invalid_specs():
    for options in ({"css": "a", "colour": "x"}, {"attr": "href"}, {"css": "a", "transform": "rot13"}):
        with pytest.raises(ValueError):
            ExtractSpec.from_dict({"f": options})


def test_public_names_are_there_and_lazy():
    code = "import sys, sparkweft; assert not [m for m in sys.modules if m.startswith('sparkweft.')]; from sparkweft import *; print(Crawl.__name__, LinkExtractor.__name__)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split() == ["Crawl", "LinkExtractor"], out.stderr
