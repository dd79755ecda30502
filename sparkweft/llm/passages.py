"""Removal of repeated passages wherever they begin and end.

:mod:`.substrings` compares whole sentences and so misses what a passage shares
with another at its edges.  Here three kinds of pieces are hashed: sentences of at
least ``MIN_WORDS`` words, whole lines of any length, and runs of ``RUN`` words
that are chosen by content alone (winnowing: of each ``RUN`` runs in a row the one
of smallest hash), so that a passage gives the same runs in any host.  Any ``2 *
RUN - 1`` words that occur twice share a run, and shared runs overlap.

Of the pieces with one digest the earliest stays and all others go.  Where pieces
that go leave a gap or end, the words beyond are compared with those beyond the
earliest occurrence, one by one, and go as far as they agree; that gives a
passage its exact edges and takes short sentences inside it.  Short lines aren't
carried on: what stands beside them agrees by chance.

Digests and offsets are shuffled once, texts are not.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, bound_batches, stored
from .substrings import _P, _Q, MIN_WORDS, _alnum, _cut, _powers, _simple_lower, units
from .text import chunks, codepoints, mix64

#: Words of a run, and runs of which one is chosen.
RUN = 12

_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of each word of all texts a hash, the start and the end (in the text); and n + 1 word offsets by text."""
    cp, ends = codepoints(texts)
    word = _alnum()[cp]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    begin, close = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.searchsorted(begin, ends)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, close, at
    size = close - begin
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)[:-1]])
    letters = _simple_lower()[cp[word]].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        letters *= _powers(_P, int(size.max()))[np.arange(len(letters)) - np.repeat(first, size)]
        h = mix64(np.add.reduceat(letters, first) ^ (size.astype(np.uint64) << np.uint64(40)))
    host = np.repeat(ends[:-1], np.diff(at))
    return h, begin - host, close - host, at


def runs(texts: list[str | None], run: int) -> tuple[np.ndarray, ...]:
    """The chosen runs of ``run`` words: text, start, end, and two 64-bit digests."""
    h, begin, close, at = words(texts)
    none = np.zeros(0, np.int64)
    if len(h) < run:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    n = len(h) - run + 1
    a, b, g = np.zeros(n, np.uint64), np.zeros(n, np.uint64), mix64(h ^ _Q)
    with np.errstate(over="ignore"):
        for p, q, k in zip(_powers(_P, run), _powers(_Q, run), range(run)):
            a += h[k : k + n] * p
            b += g[k : k + n] * q
    a, b = mix64(a), mix64(b)
    # the last run - 1 places of a text begin no run, so no choice is made across texts
    key = np.where(of[:n] == of[run - 1 :], a >> np.uint64(1), np.uint64(2**64 - 1))
    pad = np.full(run - 1, np.uint64(2**64 - 1))
    padded = np.concatenate([pad, key, pad])
    best = np.argmin(np.lib.stride_tricks.sliding_window_view(padded, run), axis=1) + np.arange(n + run - 1) - (run - 1)
    best = np.unique(best[(best >= 0) & (best < n)])
    best = best[key[best] < np.uint64(2**63)]
    return of[best], begin[best], close[best + run - 1], a[best], b[best]


def _piece_rows(min_words: int, run: int):
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            texts = batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                for wide, found in ((True, units(part, min_words)), (True, runs(part, run)), (False, units(part, 1, sentences=False))):
                    at, start, end, a, b = found
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[lo + at]),
                            pa.array(ties[lo + at]),
                            pa.array(start.astype(np.int32)),
                            pa.array(end.astype(np.int32)),
                            pa.array(np.full(len(at), wide)),
                            pa.array(a.view(np.int64)),
                            pa.array(b.view(np.int64)),
                        ],
                        names=["doc_id", "tie", "start", "end", "wide", "d1", "d2"],
                    )

    return rows


def _beside(run: int):
    """A mapInArrow function from (doc_id, tie, text, places) to the hashes and far ends of the words beside each place."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts, places = (batch.column(k).to_pylist() for k in range(4))
            out: list[list] = [[] for _ in range(6)]
            for i, tie, text, asked in zip(ids, ties, texts, places):
                h, begin, close, _ = words([text])
                for p in asked:
                    k = int(np.searchsorted(begin, p["at"]))
                    if p["right"]:
                        take, far = slice(k, k + run), close[k : k + run]
                        near = h[take]
                    else:
                        near, far = h[max(0, k - run) : k][::-1], begin[max(0, k - run) : k][::-1]
                    for column, x in zip(out, (i, tie, p["at"], p["right"], near.view(np.int64), far.astype(np.int32))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "tie", "at", "right", "near", "far"])

    return rows


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            whole: list[dict] = []
            for lo, hi in sorted((x["start"], x["end"]) for x in spans):
                if whole and lo <= whole[-1]["end"]:
                    whole[-1]["end"] = max(whole[-1]["end"], hi)
                else:
                    whole.append({"start": lo, "end": hi})
            out.append(whole)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, _PLACES)], names=["doc_id", "tie", "spans"])


def _with_texts(rows: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` joined with stored lists by document, which are broadcast if they have few entries in all."""
    entries = lists.agg(F.sum(F.size(column))).first()[0] or 0
    return rows.join(F.broadcast(lists) if entries <= BROADCAST_ROWS else lists, ["doc_id", "tie"], how)


def remove_passages(docs: DataFrame, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """``(doc_id, text, removed)``: each row of ``docs`` without the passages that occur earlier in the corpus.

    Every word that goes stands at an earlier place as well, in the same surroundings.
    Columns, ranks and awkward rows are those of :func:`.substrings.remove_repeats`;
    parts of ``removed`` that touch or overlap are given as one.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    known = rows.where("doc_id is not null and text is not null")
    found = known.mapInArrow(_piece_rows(min_words, run), "doc_id bigint, tie bigint, start int, end int, wide boolean, d1 bigint, d2 bigint")
    rank = F.struct("doc_id", "tie", "start")
    first = F.min(F.struct("doc_id", "tie", "start", "end")).over(Window.partitionBy("d1", "d2"))
    gone = stored(
        found.withColumn("first", first)
        .where(rank != F.struct("first.doc_id", "first.tie", "first.start"))
        .select("doc_id", "tie", "start", "end", "wide", "first"),
        "gone",
    )
    inside = Window.partitionBy("doc_id", "tie").orderBy("start", F.desc("end"))
    so_far = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    edges = (
        gone.where("wide")
        .select("doc_id", "tie", "start", "end", "first")
        .dropDuplicates(["doc_id", "tie", "start", "end"])
        .withColumn("open_left", F.coalesce(so_far < F.col("start"), F.lit(True)))
        .withColumn("open_right", F.coalesce(F.greatest("end", so_far) < F.lead("start").over(inside), F.lit(True)))
    )
    side = lambda right: F.struct(
        F.lit(right).alias("right"), F.col("end" if right else "start").alias("at"), F.col("first.end" if right else "first.start").alias("from_at"), F.col("first.end").alias("from_end")
    )
    ends = stored(
        edges.select(
            "doc_id", "tie", F.col("first.doc_id").alias("from_id"), F.col("first.tie").alias("from_tie"),
            F.explode(F.array_compact(F.array(F.when(F.col("open_left"), side(False)), F.when(F.col("open_right"), side(True))))).alias("s"),
        ).select("doc_id", "tie", "from_id", "from_tie", "s.*"),
        "ends",
    )
    asked = stored(
        ends.select("doc_id", "tie", "right", "at")
        .unionByName(ends.select(F.col("from_id").alias("doc_id"), F.col("from_tie").alias("tie"), "right", F.col("from_at").alias("at")))
        .groupBy("doc_id", "tie")
        .agg(F.collect_set(F.struct("right", "at")).alias("places")),
        "asked",
    )
    beside = stored(
        _with_texts(known.select("doc_id", "tie", "text"), asked, "places", "inner")
        .select("doc_id", "tie", "text", "places")
        .mapInArrow(_beside(run), "doc_id bigint, tie bigint, at int, right boolean, near array<bigint>, far array<int>")
        .dropDuplicates(["doc_id", "tie", "at", "right"]),
        "beside",
    )
    there = beside.select(F.col("doc_id").alias("from_id"), F.col("tie").alias("from_tie"), F.col("at").alias("from_at"), "right", F.col("near").alias("other"))
    compared = ends.join(beside, ["doc_id", "tie", "at", "right"]).join(there, ["from_id", "from_tie", "from_at", "right"])
    differ = F.array_position(F.zip_with("near", "other", lambda x, y: x.eqNullSafe(y)), False)
    agree = F.when(differ > 0, differ - 1).otherwise(F.size("near")).cast("int")
    further = compared.withColumn("far", F.get("far", agree - 1)).where(F.col("far").isNotNull())
    # a piece that overlaps its own first occurrence goes from the end of that
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tie") == F.col("tie"))
    spans = gone.select("doc_id", "tie", F.when(same, F.greatest("start", "first.end")).otherwise(F.col("start")).alias("start"), "end")
    on_left = F.when((F.col("from_id") == F.col("doc_id")) & (F.col("from_tie") == F.col("tie")), F.greatest("far", "from_end")).otherwise(F.col("far"))
    spans = spans.unionByName(
        further.select("doc_id", "tie", F.when(F.col("right"), F.col("at")).otherwise(on_left).alias("start"), F.when(F.col("right"), F.col("far")).otherwise(F.col("at")).alias("end"))
    ).where("start < end")
    merged = stored(
        spans.groupBy("doc_id", "tie")
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        .mapInArrow(_merged, "doc_id bigint, tie bigint, spans array<struct<start: int, end: int>>"),
        "spans",
    )
    return (
        _with_texts(rows, merged, "spans", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id bigint, text string, removed array<struct<start: int, end: int>>")
    )
