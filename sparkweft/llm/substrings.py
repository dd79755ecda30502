"""Removal of repeated passages by hashing their units across the corpus.

A text is cut into units: after every line break, and after every space that
follows a full stop, exclamation mark or question mark.  Cutting within lines
finds passages that were pasted into the middle of one.  Units are normalised
(lower case; letters and digits only, one space between words) and hashed to 128
bits; of the units with one digest the earliest by document id and place stays,
and all others are removed.  Only digests and offsets are shuffled to find them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, bound_batches, stored
from .text import chunks, codepoints, mix64

#: Units of fewer words are left alone: short ones recur by chance.
MIN_WORDS = 5

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _simple_lower() -> np.ndarray:
    lower = (chr(i).lower() for i in range(0x110000))
    return np.fromiter((ord(x) if len(x) == 1 else i for i, x in enumerate(lower)), np.uint32, 0x110000)


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def units(texts: list[str | None], min_words: int, sentences: bool = True) -> tuple[np.ndarray, ...]:
    """The units of at least ``min_words`` words: text, start, end (characters), and two 64-bit digests.

    Without ``sentences`` they are whole lines.
    """
    cp, ends = codepoints(texts)
    stop = (cp == 46) | (cp == 33) | (cp == 63)
    after_stop = np.zeros(len(cp), bool)
    after_stop[1:] = (cp[1:] == 32) & stop[:-1]
    cut = np.flatnonzero((cp == 10) | after_stop if sentences else cp == 10) + 1
    start = np.concatenate([np.zeros(1, np.int64), cut[:-1]])
    of = np.searchsorted(ends, start, "right") - 1
    last = np.minimum(cut, ends[of + 1] - 1)  # without the line break that codepoints() adds

    word = _alnum()[cp]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    begin, close = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    none = np.zeros(0, np.int64)
    if not len(begin):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    # digests are sums over a unit's letters, with a separator ahead of each word
    letters = word.copy()
    letters[begin - 1] = True
    letters[close] = True
    value = np.where(word, _simple_lower()[cp], np.uint32(0)).astype(np.uint64) + np.uint64(1)
    kept = np.flatnonzero(letters & (word | np.append(word[1:], False)))
    unit = np.searchsorted(cut, kept, "right")
    unit = np.minimum(unit, len(cut) - 1)
    lone = ~word[kept]  # a separator belongs to the unit of the word it precedes
    unit[lone] = np.searchsorted(cut, kept[lone] + 1, "right")
    opens = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    size = np.diff(np.append(opens, len(unit)))
    place = np.arange(len(unit)) - np.repeat(opens, size)
    # the separator ahead of a unit's first word is there or not by what precedes the unit: left out
    first_lone = lone[opens]
    place -= np.repeat(first_lone.astype(np.int64), size)
    v = value[kept]
    v[opens[first_lone]] = 0
    place[place < 0] = 0
    n = int(place.max()) + 1
    with np.errstate(over="ignore"):
        a = np.add.reduceat(v * _powers(_P, n)[place], opens)
        b = np.add.reduceat(mix64(v) * _powers(_Q, n)[place] * (v > 0), opens)
    length = size - first_lone
    which = unit[opens]
    words = np.bincount(np.searchsorted(cut, begin, "right"), minlength=len(cut))[which]
    ok = words >= min_words
    which = which[ok]
    a, b = mix64(a[ok] ^ length[ok].astype(np.uint64)), mix64(b[ok] + length[ok].astype(np.uint64))
    at = of[which]
    return at, start[which] - ends[at], last[which] - ends[at], a, b


def _unit_rows(min_words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            texts = batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                at, start, end, a, b = units(texts[lo:hi], min_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo + at]),
                        pa.array(ties[lo + at]),
                        pa.array(start.astype(np.int32)),
                        pa.array(end.astype(np.int32)),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                    ],
                    names=["doc_id", "tie", "start", "end", "d1", "d2"],
                )

    return run


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept, removed = [], []
        for text, gone in zip(texts, spans):
            if gone:
                gone = sorted((g["start"], g["end"]) for g in gone)
                at, parts = 0, []
                for lo, hi in gone:
                    parts.append(text[at:lo])
                    at = hi
                text = "".join([*parts, text[at:]])
            kept.append(text)
            removed.append([{"start": lo, "end": hi} for lo, hi in gone or []])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, kind)], names=["doc_id", "text", "removed"])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, text, removed)``: each row of ``docs`` without the units that occur earlier in the corpus.

    ``removed`` has the cut-out parts as offsets (start, end) in characters of the
    original text, in order.  Earlier means a smaller ``doc_id``, or the same and a
    smaller offset.  ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.
    Every row comes back: null and empty texts as they are, rows with a null id
    untouched (they have no rank), repeated rows alike, as one occurrence; rows of one
    id and different texts are ranked by a hash of the text.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    found = stored(
        rows.where("doc_id is not null and text is not null").mapInArrow(
            _unit_rows(min_words), "doc_id bigint, tie bigint, start int, end int, d1 bigint, d2 bigint"
        ),
        "units",
    )
    rank = F.struct("doc_id", "tie", "start")
    repeated = found.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("final")).where("first <> final").drop("final")
    gone = stored(
        found.join(repeated, ["d1", "d2"]).where(rank != F.col("first")).select("doc_id", "tie", "start", "end").distinct(), "gone"
    )
    spans = gone.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    if gone.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    return (
        rows.join(spans, ["doc_id", "tie"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut, "doc_id bigint, text string, removed array<struct<start: int, end: int>>")
    )
