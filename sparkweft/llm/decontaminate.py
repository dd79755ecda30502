"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so plain MinHash, which sees the
Jaccard similarity, would miss an item inside a long text.  Items are therefore
partitioned by size, each partition holding those of ``s/2 + 1`` to ``s``
n-grams for a power of two ``s``, and searched for in windows of ``2 s`` n-grams
that overlap by half: whatever the length of the document, a passage of ``s``
n-grams lies within one window, whose similarity to an item of the partition
that it contains has a fixed lower bound.

A window's MinHash values are minima over blocks, and blocks of one partition
are pairs of blocks of the one below, so all partitions together cost one
evaluation of each hash function for each n-gram.  A window that shares a value
with an item makes the document and the item a candidate, which is verified by
counting the item's n-grams that the whole document has.

The index of items goes to the executors as a broadcast of bounded size; more
items are searched for in several passes.  No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .text import chunks, minhash_multipliers, shingle_hashes, word_hashes

N = 3
CONTAINMENT = 0.6
FUNCTIONS = 48
#: Items searched for in one pass over the documents; bounds what is broadcast.
ITEMS_A_PASS = 100_000


@dataclass
class Partition:
    """Items of one size class: by hash function, sorted values and the items that have each."""

    block: int
    values: list[np.ndarray]
    starts: list[np.ndarray]
    items: list[np.ndarray]


@dataclass
class ItemIndex:
    ids: np.ndarray
    grams: list[np.ndarray]
    partitions: list[Partition]
    functions: int
    n: int

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]], n: int, functions: int) -> ItemIndex:
        ids, grams = [], []
        texts = [r[1] for r in rows]
        for lo, hi in chunks(texts):
            s, at = shingle_hashes(*word_hashes(texts[lo:hi]), n)
            for i in range(hi - lo):
                u = np.unique(s[at[i] : at[i + 1]])
                if len(u):
                    ids.append(rows[lo + i][0])
                    grams.append(u)
        a = minhash_multipliers(functions)
        by_block: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            by_block.setdefault(max(2, 1 << (len(g) - 1).bit_length()), []).append(i)
        partitions = []
        for block in sorted(by_block):
            mine = np.array(by_block[block])
            with np.errstate(over="ignore"):
                least = np.array([(grams[i][None, :] * a[:, None]).min(axis=1) for i in mine])
            p = Partition(block, [], [], [])
            for k in range(functions):
                order = np.argsort(least[:, k], kind="stable")
                values, starts = np.unique(least[order, k], return_index=True)
                p.values.append(values)
                p.starts.append(np.append(starts, len(order)))
                p.items.append(mine[order])
            partitions.append(p)
        return cls(np.array(ids, np.int64), grams, partitions, functions, n)

    def candidates(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a MinHash value in some window."""
        if not self.partitions or not len(s):
            return np.zeros((0, 2), np.int64)
        size = np.diff(at)
        low = self.partitions[0].block
        blocks = -(-size // low)
        first = np.concatenate([np.zeros(1, np.int64), np.cumsum(blocks)])
        starts = np.repeat(at[:-1] - low * first[:-1], blocks) + low * np.arange(first[-1])
        levels = []  # by size of block: the place of each window's two blocks, and its text
        block, count, begin = low, blocks, first
        for p in self.partitions:
            steps = []
            while block < p.block:
                half = -(-count // 2)
                to = np.concatenate([np.zeros(1, np.int64), np.cumsum(half)])
                left = np.repeat(begin[:-1] - 2 * to[:-1], half) + 2 * np.arange(to[-1])
                steps.append((left, np.minimum(left + 1, np.repeat(begin[1:] - 1, half))))
                block, count, begin = 2 * block, half, to
            text = np.repeat(np.arange(len(count)), count)
            following = np.minimum(np.arange(begin[-1]) + 1, np.repeat(begin[1:] - 1, count))
            levels.append((p, steps, text, following))
        found = []
        with np.errstate(over="ignore"):
            for k, a in enumerate(minhash_multipliers(self.functions)):
                least = np.minimum.reduceat(s * a, starts)
                for p, steps, text, following in levels:
                    for x, y in steps:
                        least = np.minimum(least[x], least[y])
                    window = np.minimum(least, least[following])
                    pos = np.searchsorted(p.values[k], window)
                    pos[pos == len(p.values[k])] = 0
                    hit = np.flatnonzero(p.values[k][pos] == window)
                    if len(hit):
                        lo, hi = p.starts[k][pos[hit]], p.starts[k][pos[hit] + 1]
                        many = hi - lo
                        which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                        found.append(np.stack([np.repeat(text[hit], many), p.items[k][which]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def matches(self, texts: list[str | None], containment: float) -> Iterator[tuple[int, int, float]]:
        """(text, item, share of the item's n-grams in the text) of at least ``containment``."""
        for lo, hi in chunks(texts):
            s, at = shingle_hashes(*word_hashes(texts[lo:hi]), self.n)
            last, grams = -1, None
            for t, i in self.candidates(s, at).tolist():
                if t != last:
                    last, grams = t, np.unique(s[at[t] : at[t + 1]])
                g = self.grams[i]
                pos = np.searchsorted(grams, g)
                pos[pos == len(grams)] = 0
                share = int((grams[pos] == g).sum()) / len(g)
                if share >= containment:
                    yield lo + t, i, share


def indexes(items: DataFrame, n: int, functions: int, items_a_pass: int) -> list[Broadcast]:
    """Broadcast indexes of ``items_a_pass`` items or so each."""
    bound_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    passes = max(1, -(-rows.count() // items_a_pass))
    sc = items.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    return [sc.broadcast(ItemIndex.build([tuple(r) for r in rows.where(part == p).collect()], n, functions)) for p in range(passes)]


def find_items(
    docs: DataFrame,
    items: DataFrame,
    n: int = N,
    containment: float = CONTAINMENT,
    functions: int = FUNCTIONS,
    items_a_pass: int = ITEMS_A_PASS,
) -> DataFrame:
    """``(doc_id, item_id, containment)`` for each document that has at least that share of an item's n-grams.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``;
    other columns are ignored.  Rows with a null id or text, and texts without
    words, match nothing.  A text of fewer than ``n`` words has one n-gram, all its
    words.  Each row of ``docs`` is searched on its own, so repeated rows give
    repeated matches; of several items with one id each is searched for.
    """

    def scan(index: Broadcast):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[t], int(index.value.ids[i]), share) for t, i, share in index.value.matches(batch.column(1).to_pylist(), containment)]
                columns = list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    names=["doc_id", "item_id", "containment"],
                )

        return run

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = [texts.mapInArrow(scan(x), "doc_id bigint, item_id bigint, containment double") for x in indexes(items, n, functions, items_a_pass)]
    return reduce(DataFrame.unionByName, found)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    n: int = N,
    containment: float = CONTAINMENT,
    functions: int = FUNCTIONS,
    items_a_pass: int = ITEMS_A_PASS,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    What holds an item is as in :func:`find_items`; rows with a null text stay, and
    so do those with a null id if their text is clean.
    """

    def keep(index: Broadcast, at: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for t, _, _ in index.value.matches(batch.column(at).to_pylist(), containment):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        return run

    for x in indexes(items, n, functions, items_a_pass):
        docs = docs.mapInArrow(keep(x, docs.columns.index("text")), docs.schema)
    return docs
