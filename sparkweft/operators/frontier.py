"""The crawl frontier: levels of a breadth-first search over (spider, url).

A level is written before the next one is made, so lineage never grows and a
crawl can go on after a failure.  Addresses are compared as they are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robots import origin, robots_allowed
from ..functions.urls import http_host

KEYS = ("spider", "url")


def fresh(candidates: DataFrame, seen: DataFrame | None, by: Sequence[str] = KEYS) -> DataFrame:
    """Distinct candidates that were not seen; of several with one key that of the smallest depth."""
    rest = [c for c in candidates.columns if c not in by]
    one = candidates.groupBy(*by).agg(*(F.min(c).alias(c) for c in rest)).select(*candidates.columns) if rest else candidates.distinct()
    return one if seen is None else one.join(seen.select(*by), list(by), "left_anti").select(*candidates.columns)


def _bits(h: np.ndarray, m: int, k: int) -> np.ndarray:
    """Places of k bits of m for each 64-bit hash, shape (k, rows)."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return (low[None, :] + np.arange(k, dtype=np.uint64)[:, None] * (high | np.uint64(1))[None, :]) % np.uint64(m)


def approximately_fresh(candidates: DataFrame, seen: DataFrame, expected: int, false_positives: float = 0.001, by: Sequence[str] = KEYS) -> DataFrame:
    """:func:`fresh`, with ``seen`` as a Bloom filter for ``expected`` keys: no seen key passes, some new ones don't.

    The filter's size follows from ``expected`` alone.  Each task makes one of its part,
    and they are merged two by two.
    """
    m = 64 * math.ceil(max(64, -expected * math.log(false_positives) / math.log(2) ** 2) / 64)
    k = max(1, round(m / max(1, expected) * math.log(2)))
    key = F.xxhash64(*by)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(m, bool)
        for b in batches:
            flags[_bits(b.column(0).to_numpy(zero_copy_only=False), m, k).ravel()] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(flags).tobytes()]})

    parts = seen.select(key.alias("h")).mapInArrow(build, "bits binary").rdd.map(lambda r: bytes(r[0]))
    whole = parts.treeReduce(lambda a, b: (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()) if parts.getNumPartitions() else bytes(m // 8)
    shared = seen.sparkSession.sparkContext.broadcast(whole)

    def new(hashes: pa.Array) -> pa.Array:
        at = _bits(hashes.to_numpy(zero_copy_only=False), m, k)
        raw = np.frombuffer(shared.value, np.uint8)
        hit = (raw[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
        return pa.array(~hit.astype(bool).all(axis=0))

    one = fresh(candidates, None, by)
    return one.where(F.arrow_udf(new, "boolean")(key))


def forced(level: DataFrame, retries: DataFrame) -> DataFrame:
    """The level with retries, which bypass the set of seen addresses."""
    return level.unionByName(retries)


def _by_spider(values: Mapping[str, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for name, v in values.items():
        out = F.when(F.col("spider") == name, F.lit(v).cast(kind)).otherwise(out)
    return out


def within_depth(depth: Column, limits: Mapping[str, int | None]) -> Column:
    """The depth is at most its spider's limit; without one all pass."""
    return F.coalesce(depth <= _by_spider({k: v for k, v in limits.items() if v is not None}, "int"), F.lit(True))


def in_domains(url: Column, domains: Sequence[str]) -> Column:
    """The host ends with one of ``domains``, letter by letter; addresses without a host fail.  An empty list passes all."""
    if not domains:
        return F.lit(True)
    host = http_host(url)
    ok = F.lit(False)
    for d in domains:
        ok = ok | host.endswith(d)
    return F.coalesce(ok, F.lit(False))


def one_file_an_origin(robots: DataFrame) -> DataFrame:
    """(``origin``, ``txt``): of several files of one origin the first by text."""
    return robots.groupBy("origin").agg(F.min("txt").alias("txt"))


def allowed_by_robots(requests: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """The requests that the robots files (``origin``, ``txt``, one an origin) of their hosts allow; without a file all are."""
    joined = requests.withColumn("_o", origin(F.col("url"))).join(files.select(F.col("origin").alias("_o"), F.col("txt").alias("_txt")), "_o", "left")
    return joined.where(F.col("_txt").isNull() | robots_allowed(F.col("_txt"), F.col("url"), agent)).select(*requests.columns)
