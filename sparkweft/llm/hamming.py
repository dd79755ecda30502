"""Exact k nearest neighbours of binary codes by incremental multi-index hashing.

Codes are cut into m segments, each with an index of its own.  If two codes differ
in at most r bits, then in some segment they differ in few: after the first
a + 1 segments were searched to radius s and the others to radius s - 1, every
code within distance r = m s + a has been met.  The search grows r one segment at
a time, and a query is done when its k-th best verified distance is at most r.

A candidate is taken up only at the first segment and radius at which it can be
met, so none is verified twice.

Equal codes are searched for once, and of the rows of one code only those can be
results that have the smallest ids, one more than are asked for.  What is left is
cut into blocks of a million codes and a million queries, and each pair of blocks
is one independent search: it builds its index once and streams its queries past
it.  Blocks bound the memory of a task whatever the size of the table; up to a
million codes there is one index.  The best of all blocks are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches, stored

K = 10
#: Codes in the index of one search, and queries of one search.
BLOCK_CODES = 1_000_000
BLOCK_QUERIES = 1_000_000
#: Queries that go through the index together, and lookups of theirs at once.
QUERIES_AT_ONCE = 2_048
LOOKUPS_AT_ONCE = 400_000
#: Rows whose id is divisible by this are the queries.
QUERY_EVERY = 20


@lru_cache(maxsize=256)
def masks(bits: int, weight: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which ``weight`` are set."""
    if weight > bits or not weight:
        return np.zeros(int(not weight), np.uint64)
    rows = np.array(list(combinations(range(bits), weight)), np.uint64).reshape(-1, weight)
    return (np.uint64(1) << rows).sum(axis=1, dtype=np.uint64)


class Index:
    """Segment indexes over codes, a (n, words) array of uint64."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, bits: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        length = int(np.clip(round(np.log2(max(2, len(ids)))), 4, 20))
        self.m = max(1, -(-bits // length))
        edges = [bits * j // self.m for j in range(self.m + 1)]
        self.segments = list(zip(edges[:-1], edges[1:]))
        self.bits = bits
        self.order, self.starts = [], []
        for j in range(self.m):
            v = self.segment(self.codes, j)
            self.order.append(np.argsort(v, kind="stable"))
            lo, hi = self.segments[j]
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(v.astype(np.int64), minlength=1 << (hi - lo)))]))

    def segment(self, codes: np.ndarray, j: int) -> np.ndarray:
        """The bits of segment j of each code, as a number."""
        lo, hi = self.segments[j]
        word, shift = lo // 64, lo % 64
        v = codes[:, word] >> np.uint64(shift)
        if shift + hi - lo > 64:
            v = v | codes[:, word + 1] << np.uint64(64 - shift)
        return v & np.uint64((1 << (hi - lo)) - 1)

    def search(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, distance) of the k nearest ids of each query, in that order."""
        best_q, best_c, best_d = (np.zeros(0, np.int64) for _ in range(3))
        n = len(codes)
        kth = np.full(n, self.bits + 1)
        got = np.zeros(n, np.int64)
        own = [self.segment(codes, j) for j in range(self.m)]
        live = np.arange(n if len(self.ids) else 0)
        for r in range(self.bits + self.m):
            if not len(live):
                break
            s, a = divmod(r, self.m)
            flips = masks(self.segments[a][1] - self.segments[a][0], s)
            new = []
            step = max(1, LOOKUPS_AT_ONCE // max(1, len(live)))
            for lo in range(0, len(flips), step):
                v = (own[a][live][:, None] ^ flips[None, lo : lo + step]).astype(np.int64)
                first = self.starts[a][v]
                many = self.starts[a][v + 1] - first
                rows, columns = np.nonzero(many)
                many, first = many[rows, columns], first[rows, columns]
                total = int(many.sum())
                if not total:
                    continue
                run = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(total)
                q, c = np.repeat(live[rows], many), self.order[a][run]
                x = codes[q] ^ self.codes[c]
                d = np.bitwise_count(x).sum(axis=1).astype(np.int64)
                fresh = d <= kth[q]
                q, c, x, d = q[fresh], c[fresh], x[fresh], d[fresh]
                for j in range(self.m):  # met before in an earlier segment, or at a smaller radius in a later one
                    if j != a:
                        far = np.bitwise_count(self.segment(x, j)) > (s if j < a else s - 1)
                        q, c, x, d = q[far], c[far], x[far], d[far]
                new.append((q, c, d))
            if new:
                best_q = np.concatenate([best_q, *[x[0] for x in new]])
                best_c = np.concatenate([best_c, *[x[1] for x in new]])
                best_d = np.concatenate([best_d, *[x[2] for x in new]])
                order = np.lexsort((best_c, best_d, best_q))  # codes are in the order of their ids
                best_q, best_c, best_d = best_q[order], best_c[order], best_d[order]
                opens = np.flatnonzero(np.append(True, best_q[1:] != best_q[:-1])) if len(best_q) else np.zeros(0, np.int64)
                size = np.diff(np.append(opens, len(best_q)))
                keep = np.arange(len(best_q)) - np.repeat(opens, size) < k
                best_q, best_c, best_d = best_q[keep], best_c[keep], best_d[keep]
                got[:] = np.bincount(best_q, minlength=n)
                last = np.flatnonzero(np.append(best_q[1:] != best_q[:-1], True)) if len(best_q) else np.zeros(0, np.int64)
                full = got[best_q[last]] >= k
                kth[best_q[last[full]]] = best_d[last[full]]
            live = live[(kth[live] > r) & (got[live] < len(self.ids))]
        return best_q, self.ids[best_c], best_d


def sign_codes(vectors: DataFrame, bits: int) -> DataFrame:
    """``(vec_id, code)``: a bit for each of the first ``bits`` numbers of ``embedding``, set where it is above 0.

    Missing, null and NaN numbers give 0.  Rows without an id or embedding are left out;
    of several rows of one id that with the smallest code stays.
    """
    words = -(-bits // 64)
    bound_batches(vectors.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
            positive = np.zeros((len(size), 64 * words), np.uint8)
            inside = place < bits
            positive[np.repeat(np.arange(len(size)), size)[inside], place[inside]] = flat[inside] > 0
            codes = np.packbits(positive, axis=1, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "code"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null")
    return rows.mapInArrow(run, "vec_id bigint, code binary").groupBy("vec_id").agg(F.min("code").alias("code"))


def _search(bits: int, k: int):
    """A mapInArrow function over (search, role, place, vec_id, code), codes (role 0) before queries, to the k nearest of each query.

    ``place`` names a query's code.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, parts, waiting = None, None, [], []

        def asked() -> Iterator[pa.RecordBatch]:
            nonlocal index, parts, waiting
            if index is None and parts and waiting:
                index, parts = Index(*(np.concatenate([p[x] for p in parts]) for x in range(2)), bits), []
            if index is not None and waiting:
                place, codes = (np.concatenate([w[x] for w in waiting]) for x in range(2))
                for lo in range(0, len(place), QUERIES_AT_ONCE):
                    q, found, d = index.search(codes[lo : lo + QUERIES_AT_ONCE], k)
                    yield pa.RecordBatch.from_arrays([pa.array(place[lo : lo + QUERIES_AT_ONCE][q]), pa.array(found), pa.array(d.astype(np.int32))], names=["place", "neighbor_id", "distance"])
            waiting = []

        for batch in batches:
            if not batch.num_rows:
                continue
            search, role, place, ids = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            raw = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(len(ids), -1)
            ends = np.flatnonzero(np.append(search[1:] != search[:-1], True)) + 1
            lo = 0
            for hi in ends.tolist():
                if search[lo] != current:
                    yield from asked()
                    current, index, parts = search[lo], None, []
                mid = lo + int((role[lo:hi] == 0).sum())
                if lo < mid:
                    parts.append((ids[lo:mid], raw[lo:mid]))
                if mid < hi:
                    waiting.append((place[mid:hi], raw[mid:hi]))
                if sum(len(w[0]) for w in waiting) >= QUERIES_AT_ONCE:
                    yield from asked()
                lo = hi
        yield from asked()

    return run


def nearest_codes(
    codes: DataFrame, bits: int, k: int = K, every: int = QUERY_EVERY, block_codes: int = BLOCK_CODES, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """``(vec_id, neighbor_id, distance, rank)``: for each query the ``k`` other rows at the smallest Hamming distance.

    ``codes`` has distinct ``vec_id`` and ``code``, little-endian words of 64 bits.  Queries
    are the rows whose id is divisible by ``every``; all rows are searched.  Equal
    distances are ranked by the neighbour's id, so the result is unique.  Where there are
    fewer than ``k`` others, all are given.
    """
    held = stored(codes.select("vec_id", "code"), "codes")
    # k + 1 rows of a code are enough: one of them may be the query itself
    of_code = Window.partitionBy("code").orderBy("vec_id")
    base = stored(held.withColumn("_n", F.row_number().over(of_code)).where(F.col("_n") <= k + 1).select("vec_id", "code"), "base")
    asks = stored(held.where(F.col("vec_id") % every == 0).groupBy("code").agg(F.min("vec_id").alias("place")), "asks")
    nb, nq = max(1, -(-base.count() // block_codes)), max(1, -(-asks.count() // block_queries))
    to = lambda q, b: (q * nb + b).cast("bigint").alias("search")
    as_code = base.select(
        F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(nb)).alias("b"), "vec_id", "code"
    ).select(to(F.col("q"), F.col("b")), F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("place"), "vec_id", "code")
    as_query = asks.select(
        F.pmod(F.xxhash64("code", F.lit(1)), F.lit(nq)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), "place", "code"
    ).select(to(F.col("q"), F.col("b")), F.lit(1).alias("role"), "place", F.lit(0).cast("bigint").alias("vec_id"), "code")
    # searches are few and heavy: one partition each, so that none waits for another
    rows = as_code.unionByName(as_query).repartition(nq * nb, "search").sortWithinPartitions("search", "role")
    found = rows.mapInArrow(_search(bits, k + 1), "place bigint, neighbor_id bigint, distance int")
    of_place = Window.partitionBy("place").orderBy("distance", "neighbor_id")
    best = found.withColumn("_n", F.row_number().over(of_place)).where(F.col("_n") <= k + 1)
    lists = best.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    queries = held.where(F.col("vec_id") % every == 0).join(asks, "code").join(lists, "place")
    others = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("vec_id")), 1, k)
    return queries.select("vec_id", F.posexplode(others).alias("at", "near")).select(
        "vec_id", "near.neighbor_id", "near.distance", (F.col("at") + 1).alias("rank")
    )


def nearest(vectors: DataFrame, k: int = K, bits: int | None = None, **options) -> DataFrame:
    """:func:`nearest_codes` over the sign bits of ``embedding``; by default as many bits as the longest has.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are ignored, and an empty
    table gives no rows.
    """
    if bits is None:
        bits = vectors.agg(F.max(F.size("embedding"))).first()[0]
    return nearest_codes(sign_codes(vectors, max(1, bits or 1)), max(1, bits or 1), k, **options)
