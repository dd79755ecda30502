"""Line deduplication by a log-template tree of fixed depth.

Lines are split at white space and tokens that hold a digit become ``<*>``.  The
tree sends a line by its number of tokens and its ``LEADING`` first tokens to a
leaf.  A leaf keeps templates: a line joins the one with which it shares the
largest part of its tokens, if that is at least ``SIMILARITY``, and tokens in which
the two differ become variable; else it founds a template.  Lines arrive in order
of document and place.  Templates that occur in at least ``MIN_DOCS`` documents are
boilerplate, and their lines are dropped.

Leaves are independent, so they are the unit of distribution: lines are
shuffled by leaf once, and each task walks through its leaves in order.  Within a
leaf only templates that share a block of tokens with the line are compared;
by the pigeonhole principle no other can be similar enough.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, bound_batches, stored

LEADING = 2
SIMILARITY = 0.7
MIN_DOCS = 3
VARIABLE = "<*>"
#: Characters of different lines that a task holds before it passes them on.
HELD_CHARS = 4 << 20

_digit = re.compile(r"\d")


def masked(line: str) -> list[str]:
    """The tokens of a line, those with a digit as ``VARIABLE``."""
    tokens = line.split()
    return [VARIABLE if _digit.search(t) else t for t in tokens] if _digit.search(line) else tokens


def _digest(text: str, salt: bytes = b"") -> tuple[int, int]:
    d = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=salt).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Leaf:
    """The templates of one leaf."""

    def __init__(self, length: int, similarity: float):
        self.fewest = similarity * length
        allowed = int(length - self.fewest + 1e-9)  # differing tokens
        k = min(length, allowed + 1)
        self.blocks = [(length * b // k, length * (b + 1) // k) for b in range(k)]
        self.templates: list[list[str | None]] = []
        self.founders: list[tuple[int, int]] = []
        self.index: dict[tuple, list[int]] = {}

    def place(self, tokens: list[str], digest: tuple[int, int]) -> tuple[int, int]:
        """The founder's digest of the template that takes the line."""
        keys = [(lo, *tokens[lo:hi]) for lo, hi in self.blocks]
        near = sorted({t for key in keys for t in self.index.get(key, ())})
        best, most = -1, -1
        for t in near:
            same = sum(a == b for a, b in zip(tokens, self.templates[t]))
            if same > most:
                best, most = t, same
        if best >= 0 and most >= self.fewest - 1e-9:
            template = self.templates[best]
            for i, x in enumerate(tokens):
                if template[i] is not None and template[i] != x:
                    template[i] = None
            return self.founders[best]
        self.templates.append(list(tokens))
        self.founders.append(digest)
        for key in keys:
            self.index.setdefault(key, []).append(len(self.templates) - 1)
        return digest


def _lines(text: str, leading: int) -> Iterator[tuple[int, str, str]]:
    """Number, leaf and masked text of each line that has tokens."""
    for k, line in enumerate(text.split("\n")):
        tokens = masked(line)
        if tokens:
            yield k, f"{len(tokens)} {' '.join(tokens[:leading])}", " ".join(tokens)


_KEYS = [("d1", pa.int64()), ("d2", pa.int64())]


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("line", pa.int32()), *_KEYS])
    for batch in batches:
        rows = []
        for i, tie, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows += [(i, tie, k, *_digest(m)) for k, _, m in _lines(text, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


def _by_leaf(leading: int):
    schema = pa.schema([("leaf", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), *_KEYS, ("masked", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[str, tuple] = {}  # of equal lines that a task meets the earliest is enough
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(_digest(leaf, b"leaf")[0], i, k, *_digest(m), m) for m, (i, k, leaf) in first.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for k, leaf, m in _lines(text, leading):
                    known = first.get(m)
                    if known is None:
                        held += len(m)
                    if known is None or (i, k) < known[:2]:
                        first[m] = (i, k, leaf)
                if held > HELD_CHARS:
                    yield from out()
                    first, held = {}, 0
        yield from out()

    return run


def _assign(leading: int, similarity: float):
    schema = pa.schema([*_KEYS, ("t1", pa.int64()), ("t2", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, leaves, known = None, {}, {}
        for batch in batches:
            out = []
            for leaf, d1, d2, m in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4, 5))):
                if leaf != current:
                    current, leaves, known = leaf, {}, {}
                if (d1, d2) in known:
                    continue
                tokens = m.split(" ")
                own = (len(tokens), *tokens[:leading])
                if own not in leaves:
                    leaves[own] = Leaf(len(tokens), similarity)
                known[d1, d2] = t = leaves[own].place(tokens, (d1, d2))
                out.append((d1, d2, *t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _drop_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        kept, removed = [], []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            spans = []
            if gone:
                gone, at, parts = set(gone), 0, []
                for k, line in enumerate(text.split("\n")):
                    if k in gone:
                        spans.append({"start": at, "end": at + len(line)})
                    else:
                        parts.append(line)
                    at += len(line) + 1
                text = "\n".join(parts)
            kept.append(text)
            removed.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(removed, kind)], names=["doc_id", "text", "removed"])


def line_templates(docs: DataFrame, leading: int = LEADING, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, tie, line, t1, t2)``: the template of each line with tokens, stored.

    A template is named by the digest of the line that founded it.  ``tie`` tells
    rows of one id and different texts apart.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    bound_batches(docs.sparkSession)
    rows = rows.where("doc_id is not null and text is not null")
    occurrences = rows.mapInArrow(_occurrences, "doc_id bigint, tie bigint, line int, d1 bigint, d2 bigint")
    assigned = (
        rows.mapInArrow(_by_leaf(leading), "leaf bigint, doc_id bigint, line int, d1 bigint, d2 bigint, masked string")
        .repartition("leaf")
        .sortWithinPartitions("leaf", "doc_id", "line", "d1", "d2")
        .mapInArrow(_assign(leading, similarity), "d1 bigint, d2 bigint, t1 bigint, t2 bigint")
    )
    return stored(occurrences.join(assigned, ["d1", "d2"]).drop("d1", "d2"), "templates")


def drop_recurring_lines(docs: DataFrame, leading: int = LEADING, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(doc_id, text, removed)``: each row of ``docs`` without the lines whose template occurs in ``min_docs`` documents.

    All lines of such a template go, the first as well.  ``removed`` has their
    offsets (start, end) in characters of the original text, without the line break.
    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Every row comes
    back: null texts as null, empty lines and texts as they are, rows with a null id
    untouched.  Repeated rows count as one document and are treated alike.
    """
    lines = line_templates(docs, leading, similarity)
    recurring = lines.groupBy("t1", "t2").agg(F.countDistinct("doc_id").alias("docs")).where(F.col("docs") >= min_docs).select("t1", "t2")
    gone = stored(lines.join(recurring, ["t1", "t2"]).select("doc_id", "tie", "line").distinct(), "gone")
    spans = gone.groupBy("doc_id", "tie").agg(F.collect_list("line").alias("spans"))
    if gone.count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return (
        rows.join(spans, ["doc_id", "tie"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_drop_lines, "doc_id bigint, text string, removed array<struct<start: int, end: int>>")
    )
