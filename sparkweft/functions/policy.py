"""Request policies: retries, status rules, rate limits, throttling, rotation and headers.

All are expressions or window functions over a log or plan of requests; only the
throttle, whose state is a fold in order, runs in Python, a key at a time and batch by
batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import _java, compile_pattern

RETRY_STATUSES = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class RetryPolicy:
    """How often and after what delays to fetch again.

    The delay before retry ``a`` (from 0) is ``base_ms * 2**a``, at most ``max_ms``; with
    jitter, up to a quarter more, at most ``max_ms`` again.  Without ``statuses`` all
    failed fetches and HTTP errors are retried, with them only those statuses.
    """

    max_retries: int = 0
    base_ms: int = 500
    max_ms: int = 60_000
    with_jitter: bool = False
    statuses: tuple[int, ...] = ()

    def base_delay(self, ms: int) -> RetryPolicy:
        return replace(self, base_ms=ms)

    def max_delay(self, ms: int) -> RetryPolicy:
        return replace(self, max_ms=ms)

    def jitter(self, on: bool = True) -> RetryPolicy:
        return replace(self, with_jitter=on)

    def on_status(self, *statuses: int) -> RetryPolicy:
        return replace(self, statuses=self.statuses + statuses)

    def delay_ms(self, attempt: Column, seed: int = 0) -> Column:
        """The delay before retry ``attempt``, a double."""
        plain = F.least(F.lit(float(self.base_ms)) * F.pow(F.lit(2.0), attempt), F.lit(float(self.max_ms)))
        return F.least(plain * (1 + F.rand(seed) * 0.25), F.lit(float(self.max_ms))) if self.with_jitter else plain

    def is_retriable(self, error_kind: Column, status: Column) -> Column:
        """Whether an error (``http_status``, ``fetch`` or another kind) is worth another fetch."""
        http = status.isin(*self.statuses) if self.statuses else F.lit(True)
        return F.when(error_kind == "http_status", F.coalesce(http, F.lit(False))).when(error_kind == "fetch", F.lit(not self.statuses)).otherwise(F.lit(False))


@dataclass(frozen=True)
class StatusRules:
    """Which statuses are errors: the codes of the first pattern that matches the address, else ``codes``."""

    codes: tuple[int, ...] = RETRY_STATUSES
    patterns: tuple[tuple[str, tuple[int, ...]], ...] = ()

    def for_pattern(self, pattern: str, codes: Sequence[int]) -> StatusRules:
        """An empty list of codes lets everything on these addresses pass."""
        compile_pattern(pattern)
        return replace(self, patterns=(*self.patterns, (pattern, tuple(codes))))

    def is_error(self, url: Column, status: Column) -> Column:
        def among(codes: tuple[int, ...]) -> Column:
            return F.coalesce(status.isin(*codes), F.lit(False)) if codes else F.lit(False)

        if not self.patterns:
            return among(self.codes)
        pattern, codes = self.patterns[0]
        out = F.when(url.rlike(_java(pattern)), among(codes))
        for pattern, codes in self.patterns[1:]:
            out = out.when(url.rlike(_java(pattern)), among(codes))
        return out.otherwise(among(self.codes))


def resolve_attempts(attempts: DataFrame, policy: RetryPolicy, by: Sequence[str] = ("url",), rules: StatusRules | None = None) -> DataFrame:
    """The outcome of each request from its recorded attempts.

    ``attempts`` has ``by``, ``attempt`` (from 0) and ``status`` (null: the fetch failed).  A
    request ends with its first attempt that is no retriable error, or with the last
    that the policy allows.  Gives that attempt's columns with ``fetches`` (how many were
    made), ``ok``, and ``waited_ms`` (the sum of delays ahead of it).
    """
    rules = rules or StatusRules()
    url = F.col("url") if "url" in attempts.columns else F.lit("")
    bad = F.col("status").isNull() | rules.is_error(url, F.col("status"))
    kind = F.when(F.col("status").isNull(), "fetch").when(bad, "http_status")
    tried = attempts.where(F.col("attempt") <= policy.max_retries)
    again = bad & F.coalesce(policy.is_retriable(kind, F.col("status")), F.lit(False))
    order = Window.partitionBy(*by).orderBy("attempt")
    ended = F.max(F.when(again, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    delay = F.when(F.col("attempt") > 0, policy.delay_ms(F.col("attempt") - 1)).otherwise(F.lit(0.0))
    return (
        tried.withColumn("_ended", F.coalesce(ended, F.lit(0)))
        .withColumn("fetches", F.row_number().over(order))
        .withColumn("waited_ms", F.sum(delay).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("ok", ~bad)
        .where("_ended = 0")
        .withColumn("_last", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("attempt"))))
        .where("_last = 1")
        .drop("_ended", "_last")
    )


def rate_limited(log: DataFrame, per_second: float, at: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``log`` with ``start_us``: when each request may start under a rate limit.

    ``at`` is the arrival in microseconds.  The rate is rounded up to a whole number, 1
    at least, which is also the burst.  The limiter's fold over arrivals has a closed
    form as a running maximum, so it is one window function; with ``by`` each key has a
    limiter of its own and keys are spread over tasks.
    """
    rate = max(1, math.ceil(per_second))
    gap = 1_000_000 // rate
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = within.orderBy(at, *order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    n = F.row_number().over(ordered)
    full = log.withColumn("_n", n).withColumn("_tat", F.max(F.col(at) - (F.col("_n") - 1) * gap).over(upto) + F.col("_n") * gap)
    return full.withColumn("start_us", F.greatest(F.col(at), F.col("_tat") - rate * gap)).drop("_n", "_tat")


@dataclass(frozen=True)
class AutoThrottle:
    """A delay that follows the latency: halfway to the smoothed latency by concurrency, doubled on overload."""

    target_concurrency: float = 1.0
    start_ms: float = 500.0
    min_ms: float = 0.0
    max_ms: float = 60_000.0
    backoff_statuses: tuple[int, ...] = (429, 503)

    def step(self, delay: float, ewma: float, latency: float, status: int | None) -> tuple[float, float]:
        ewma = 0.3 * latency + 0.7 * ewma
        delay = min(delay * 2.0, self.max_ms) if status in self.backoff_statuses else (delay + ewma / max(self.target_concurrency, 0.1)) / 2.0
        return min(max(delay, self.min_ms), self.max_ms), ewma

    def trace(self, log: DataFrame, by: Sequence[str], order: Sequence[str], latency: str = "elapsed_ms", status: str = "status") -> DataFrame:
        """``log`` with ``delay_ms`` and ``ewma_ms`` after each response; ``by`` has a throttle a key.

        Rows are shuffled by key and sorted; the fold keeps two numbers and passes
        over Arrow batches, so a key may be of any length.  Null latencies count as 0.
        """
        step, start = self.step, self.start_ms
        columns, n = log.columns, len(by)
        schema = T.StructType([*log.schema.fields, T.StructField("delay_ms", T.DoubleType()), T.StructField("ewma_ms", T.DoubleType())])
        where, what, code = [columns.index(c) for c in by], columns.index(latency), columns.index(status)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, delay, ewma = None, start, start
            for b in batches:
                keys = list(zip(*(b.column(k).to_pylist() for k in where))) if n else [()] * b.num_rows
                delays, smooth = [], []
                for key, ms, s in zip(keys, b.column(what).to_pylist(), b.column(code).to_pylist()):
                    if key != current:
                        current, delay, ewma = key, start, start
                    delay, ewma = step(delay, ewma, ms or 0.0, s)
                    delays.append(delay)
                    smooth.append(ewma)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(delays, pa.float64()), pa.array(smooth, pa.float64())], names=[*b.schema.names, "delay_ms", "ewma_ms"])

        spread = log.repartition(*by) if by else log.coalesce(1)
        return spread.sortWithinPartitions(*by, *order).mapInArrow(run, schema)


BROWSERS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/124.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) AppleWebKit/537.36 Chrome/124.0",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/123.0",
    "Mozilla/5.0 (Windows NT 10.0; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:124.0) Gecko/20100101 Firefox/124.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_4) Version/17.4 Safari/605.1",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) Version/17.4 Mobile Safari/604.1",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Edg/124.0",
)


def rotation_index(n: int, order: Sequence[str], by: Sequence[str] = (), random_seed: int | None = None) -> Column:
    """Which of ``n`` values each row takes: in turn by ``order``, or by a seeded hash of it."""
    if random_seed is not None:
        return F.pmod(F.xxhash64(*order, F.lit(random_seed)), F.lit(n)).cast("int")
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return ((F.row_number().over(within.orderBy(*order)) - 1) % n).cast("int")


def rotated(requests: DataFrame, column: str, values: Sequence[str], order: Sequence[str], by: Sequence[str] = (), random_seed: int | None = None) -> DataFrame:
    """``requests`` with one of ``values`` in ``column``; null if there are none.

    Taking turns over all rows needs one order of all; ``by`` (a host) gives each key
    turns of its own, and a random seed needs no order, so both spread over tasks.
    """
    if not values:
        return requests.withColumn(column, F.lit(None).cast("string"))
    return requests.withColumn(column, F.get(F.array(*map(F.lit, values)), rotation_index(len(values), order, by, random_seed)))


def default_headers(existing: Column, headers: Mapping[str, str]) -> Column:
    """A header map (names in lower case) with ``headers`` set; names and values that HTTP forbids are left out."""
    token = set("!#$%&'*+-.^_`|~0123456789abcdefghijklmnopqrstuvwxyz")
    good = {k.lower(): v for k, v in headers.items() if k and set(k.lower()) <= token and all(" " <= c != "\x7f" or c == "\t" for c in v)}
    old = F.map_filter(F.coalesce(existing, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*good)) if good else existing
    return F.map_concat(old, F.create_map(*[F.lit(x) for kv in good.items() for x in kv])) if good else old
