"""Page sources: where a crawl's requests find their responses.

There is no network; a fetch is a left join of requests with a recorded corpus.  A
source takes requests (``url`` and any other columns) and adds the columns of
:data:`RESPONSE`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from fnmatch import fnmatchcase
from typing import Protocol

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.robots import origin
from .staging import staging_dir

RESPONSE = ("status", "headers", "elapsed_ms", "body_text", "body_bytes")


class PageSource(Protocol):
    def fetch(self, requests: DataFrame) -> DataFrame:
        """``requests`` with the response columns; a null ``status`` means that the fetch failed."""


def is_text(content_type: Column) -> Column:
    """Bodies of this content type are text: ``text/...`` and JSON, and those without a type."""
    return F.coalesce(content_type.startswith("text/") | content_type.contains("application/json"), F.lit(True))


def responses(
    pages: DataFrame,
    url: str = "url",
    body: str = "html",
    status: str | None = None,
    content_type: str | None = None,
    elapsed_ms: str | None = None,
) -> DataFrame:
    """A table of recorded responses from any table with addresses and bodies."""
    kind = F.col(content_type) if content_type else F.lit(None).cast("string")
    text = is_text(kind)
    headers = F.when(kind.isNotNull(), F.create_map(F.lit("content-type"), kind)).otherwise(F.create_map().cast("map<string,string>"))
    return pages.select(
        F.col(url).alias("url"),
        (F.col(status) if status else F.lit(200)).cast("int").alias("status"),
        headers.alias("headers"),
        (F.col(elapsed_ms) if elapsed_ms else F.lit(0.0)).cast("double").alias("elapsed_ms"),
        F.when(text, F.col(body).cast("string")).alias("body_text"),
        F.when(~text, F.col(body).cast("binary")).alias("body_bytes"),
    )


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):  # Hadoop's paths have no escapes, as URIs do
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_files(pages: DataFrame, folder: str, name: str = "page_id", body: str = "html", per_folder: int = 1000) -> None:
    """Writes each row as a file ``<folder>/<n>/<name>=<value>.txt`` of its text and a line break; folders ``n`` have about ``per_folder`` files.

    ``folder`` is shared by all executors, in a file system that Arrow knows.  A file is
    written under another name and then renamed, so tasks that run again or twice leave
    whole files.
    """
    folders = max(1, -(-pages.count() // per_folder))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _system(folder)
        made = set()
        for b in batches:
            for n, value, text in zip(*(c.to_pylist() for c in b.columns)):
                if n not in made:
                    system.create_dir(f"{root}/{n}", recursive=True)
                    made.add(n)
                part = f"{root}/{n}/.{value}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write((text or "").encode() + b"\n")
                system.move(part, f"{root}/{n}/{name}={value}.txt")
        yield pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64())})

    at = F.pmod(F.xxhash64(name), F.lit(folders))
    pages.select(at.alias("n"), F.col(name).cast("string"), body).mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Local HTML files as recorded pages: ``url`` is the path, the status 200.

    ``path`` is a pattern such as ``folder/*/*.txt``.  Only folders are listed by the
    driver; their files are listed and read by tasks, which hold a few MB of them.
    """
    folders, _, names = path.rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(folders)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                system, inner = _system(folder)
                files = (f for f in system.get_file_info(fs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_")))
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{f.base_name}" for f in files if fnmatchcase(f.base_name, names)], pa.string())})

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, bodies, size = [], [], 0
            for p in b.column(0).to_pylist():
                system, inner = _system(p)
                with system.open_input_stream(inner, compression=None) as f:
                    bodies.append(f.read())
                paths.append(p)
                size += len(bodies[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(bodies, pa.binary())})
                    paths, bodies, size = [], [], 0
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(bodies, pa.binary())})

    roots = spark.createDataFrame([(s.getPath().toString(),) for s in found if s.isDirectory()], "folder string").repartition(n)
    files = roots.mapInArrow(listed, "path string").repartition(n).mapInArrow(contents, "path string, content binary")
    return responses(files.select(F.col("path").alias("url"), F.decode("content", "UTF-8").alias("html")))


class CorpusSource:
    """Responses by exact address; of several for one address the first by status and body.

    Addresses that the corpus lacks get ``default`` (status, body), by default status
    404 and an empty text.  The corpus is only joined, never collected; Spark
    broadcasts the requests of a level where they are the small side.
    """

    def __init__(self, recorded: DataFrame, default: tuple[int | None, str | None] = (404, ""), unique: bool = False):
        self.recorded, self.default, self.unique = recorded, default, unique

    @staticmethod
    def _one_each(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("url").orderBy("status", "body_text")
        return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")

    def indexed(self, buckets: int | None = None) -> CorpusSource:
        """The same source with its corpus written once, a row an address, in buckets of addresses and sorted within.

        A fetch then shuffles its requests to the buckets, or broadcasts them, and never
        shuffles the corpus: for crawls of many levels.
        """
        spark = self.recorded.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"corpus_{uuid.uuid4().hex}"
        one = self.recorded if self.unique else self._one_each(self.recorded)
        one.select("url", *RESPONSE).repartition(n, "url").write.bucketBy(n, "url").sortBy("url").option("path", staging_dir(spark, name)).saveAsTable(name)
        return CorpusSource(spark.table(name), self.default, unique=True)

    def robots(self) -> DataFrame | bool:
        """The robots files in the corpus: (``origin``, ``txt``); True if any address has an answer, so that each must be asked for."""
        status, body = self.default
        if status is not None and 200 <= status < 300 and body:
            return True
        mine = self.recorded.where(F.col("url").endswith("/robots.txt") & F.col("status").between(200, 299) & F.col("body_text").isNotNull())
        return mine.where(F.col("url") == F.concat(origin(F.col("url")), F.lit("/robots.txt"))).select(origin(F.col("url")).alias("origin"), F.col("body_text").alias("txt"))

    def fetch(self, requests: DataFrame) -> DataFrame:
        # only the addresses that are asked for are made unique, not the whole corpus
        asked = self.recorded.join(requests.select("url"), "url", "left_semi")
        one = (asked if self.unique else self._one_each(asked)).select("url", *RESPONSE, F.lit(True).alias("_hit"))
        found = requests.join(one, "url", "left")
        status, body = self.default
        missing = F.col("_hit").isNull()
        return found.select(
            *requests.columns,
            F.when(missing, F.lit(status)).otherwise(F.col("status")).cast("int").alias("status"),
            F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
            F.coalesce("elapsed_ms", F.lit(0.0)).alias("elapsed_ms"),
            F.when(missing, F.lit(body)).otherwise(F.col("body_text")).alias("body_text"),
            "body_bytes",
        )


class MockSource(CorpusSource):
    """A source over literal pages, for tests: ``{url: (status, body)}``; a bytes body is binary."""

    def __init__(self, spark: SparkSession, pages: dict[str, tuple[int, str | bytes]], default: tuple[int | None, str | None] = (404, "")):
        rows = [(u, s, {}, 0.0, b if isinstance(b, str) else None, b if isinstance(b, bytes) else None) for u, (s, b) in pages.items()]
        schema = "url string, status int, headers map<string,string>, elapsed_ms double, body_text string, body_bytes binary"
        super().__init__(spark.createDataFrame(rows, schema), default)


def fresh(cached_at: Column, now: Column, ttl: int | None) -> Column:
    """An entry's age in whole seconds (0 at least) is below ``ttl``; without one entries stay fresh."""
    if ttl is None:
        return F.lit(True)
    return F.greatest(now - cached_at, F.lit(0).cast("bigint")) < F.lit(ttl)


class CachingSource:
    """A cache table ahead of another source.

    The cache at ``path`` has (url, status, body, cached_at) and is appended to; of an
    address the latest entry counts, of several as late the first by status and body.  Hits have no headers and take no time.  Only text
    bodies are cached, by :meth:`remember`.
    """

    def __init__(self, inner: PageSource, path: str, ttl: int | None = None, now: int | None = None):
        self.inner, self.path, self.ttl, self.now = inner, path, ttl, now

    def entries(self, spark: SparkSession) -> DataFrame | None:
        try:
            kept = spark.read.schema("url string, status int, body string, cached_at bigint").parquet(self.path)
            kept.limit(0).count()
        except AnalysisException:  # nothing was cached so far
            return None
        latest = Window.partitionBy("url").orderBy(F.desc("cached_at"), "status", "body")
        kept = kept.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        return kept.where(fresh(F.col("cached_at"), self._now(), self.ttl))

    def _now(self) -> Column:
        return F.lit(self.now).cast("bigint") if self.now is not None else F.unix_timestamp()

    def robots(self) -> DataFrame | bool:
        of_inner = getattr(self.inner, "robots", None)
        return of_inner() if of_inner else True

    def fetch(self, requests: DataFrame) -> DataFrame:
        kept = self.entries(requests.sparkSession)
        if kept is None:
            return self.inner.fetch(requests)
        hits = requests.join(kept, "url").select(
            *requests.columns,
            "status",
            F.create_map().cast("map<string,string>").alias("headers"),
            F.lit(0.0).alias("elapsed_ms"),
            F.col("body").alias("body_text"),
            F.lit(None).cast("binary").alias("body_bytes"),
        )
        return hits.unionByName(self.inner.fetch(requests.join(kept.select("url"), "url", "left_anti")))

    def remember(self, fetched: DataFrame) -> None:
        """Adds the text responses among ``fetched`` that the cache lacks."""
        new = fetched.where("body_text is not null and status is not null")
        kept = self.entries(fetched.sparkSession)
        if kept is not None:
            new = new.join(kept.select("url"), "url", "left_anti")
        new.select("url", "status", F.col("body_text").alias("body"), self._now().alias("cached_at")).dropDuplicates(["url"]).write.mode("append").parquet(self.path)


class AttemptSource:
    """Responses by address and attempt, resolved under a retry policy (see :mod:`..functions.policy`)."""

    def __init__(self, attempts: DataFrame, retry, default: tuple[int | None, str | None] = (404, "")):
        self.attempts, self.retry, self.default = attempts, retry, default

    def with_retry(self, retry) -> AttemptSource:
        return AttemptSource(self.attempts, retry, self.default)

    def fetch(self, requests: DataFrame) -> DataFrame:
        from ..functions.policy import resolve_attempts

        # later requests for an address go on where the retries of earlier ones ended
        width = self.retry.max_retries + 1
        asked = requests.select("url", "retry").distinct() if "retry" in requests.columns else requests.select("url", F.lit(0).alias("retry")).distinct()
        mine = self.attempts.join(asked, "url").where(F.floor(F.col("attempt") / width) == F.col("retry"))
        settled = resolve_attempts(mine.withColumn("attempt", F.col("attempt") % width), self.retry, by=("url", "retry"))
        keys = ["url", "retry"] if "retry" in requests.columns else ["url"]
        found = requests.join(settled.select(*keys, F.col("status").alias("_s"), F.col("body").alias("_b"), F.lit(True).alias("_hit")), keys, "left")
        status, body = self.default
        return found.select(
            *requests.columns,
            F.when(F.col("_hit"), F.col("_s")).otherwise(F.lit(status)).cast("int").alias("status"),
            F.create_map().cast("map<string,string>").alias("headers"),
            F.lit(0.0).alias("elapsed_ms"),
            F.when(F.col("_hit"), F.col("_b")).otherwise(F.lit(body)).alias("body_text"),
            F.lit(None).cast("binary").alias("body_bytes"),
        )
