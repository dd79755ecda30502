"""N-gram Jaccard join with Bayesian pruning of candidates.

Documents are sets of word n-grams (see :mod:`.text` for the normalisation).
The join links documents whose sets have a Jaccard similarity of at least
``threshold``:

1.  One pass over the texts makes MinHash values.  Documents with the same set
    form a class, and only classes are compared.
2.  Rows ``(band key, class, values)`` of buckets with more than one class are shuffled by band key.  Two classes in
    one bucket are a candidate; it is taken up only in the first band the two
    share, so no pair appears twice and no ``distinct`` is needed.  Buckets of
    more than ``BUCKET_ROWS`` classes are cut into parts, and each pair of parts
    is a tile of its own, so no task holds or compares more than that.
3.  Within a tile further MinHash values are compared a few at a time.
    After each batch the posterior probability that the similarity reaches the
    threshold (uniform prior) is looked up, and the pair dropped if that falls
    below ``tolerance``.
4.  The rest is verified exactly.  Pairs of one neighbourhood are verified in
    the same place, so a document travels about once and not once a pair;
    large neighbourhoods are tiled to keep the memory of a task bounded.  What
    leaves a tile are sums and a spanning forest, a row a class, and no pairs.

:func:`deduplicate` needs groups only, not links, and keeps its work in
proportion to the rows of buckets: members of a large bucket are first compared
with its smallest class alone, and then with those that this left in other groups.

Steps 2 and 3 move 8 bytes a band, about 150 bytes for each class of a bucket that has
more than one, and never text; step 4 reads the texts of classes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, small_enough, stored
from .text import chunks, mix64, minhash, shingle_hashes, word_hashes

N = 3
THRESHOLD = 0.5
#: 32 bands of 3 values meet 98.6 % of pairs at similarity 0.5 and 99.97 % at 0.6; at this tolerance
#: pruning keeps 99.8 % of the former and all but a few in a hundred thousand of the latter.
BANDS = 32
ROWS = 3
COMPARED = 64
STEP = 16
TOLERANCE = 0.001
TILE_DOCS = 512
PAIRS_AT_ONCE = 200_000
#: Classes of a bucket that one task compares with each other; larger buckets are tiled.
BUCKET_ROWS = 4_096
#: Classes of a bucket up to which :func:`deduplicate` compares all at once.
FEW = 16


@lru_cache(maxsize=16)
def least_matches(threshold: float, tolerance: float, compared: int = COMPARED, step: int = STEP) -> tuple[int, ...]:
    """For each batch, the fewest matches so far with which a pair goes on.

    Values are compared by one byte each, so two of them match with probability
    ``p = s + (1 - s) / 256`` at similarity ``s``.  With a uniform prior on ``s``
    the posterior density of ``p`` is proportional to the binomial likelihood on
    ``[1/256, 1]``.
    """
    p = np.linspace(1 / 256, 1 - 1e-9, 20_001)
    reach = p >= threshold + (1 - threshold) / 256
    out = []
    for m in range(step, compared + 1, step):
        for k in range(m + 1):
            log = k * np.log(p) + (m - k) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[reach].sum() / like.sum() >= tolerance:
                break
        out.append(k)
    return tuple(out)


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        s, at = shingle_hashes(*word_hashes(texts[lo:hi]), n)
        for i in range(hi - lo):
            yield np.unique(s[at[i] : at[i + 1]])


def _signer(n: int, bands: int, rows: int, compared: int):
    """A mapInArrow function from (doc_id, tie, text) to (doc_id, tie, cls, bands, payload); without words the last three are null."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                s, at = shingle_hashes(*word_hashes(texts[lo:hi]), n)
                sig = minhash(s, at, bands * rows + compared)
                none = np.diff(at) == 0
                name = np.zeros(hi - lo, np.uint64)
                for i in range(hi - lo):
                    u = np.unique(s[at[i] : at[i + 1]])
                    v = mix64(u ^ np.uint64(0x5851F42D4C957F2D))
                    parts = np.array([u.sum(dtype=np.uint64), v.sum(dtype=np.uint64), len(u)], np.uint64)
                    name[i] = np.bitwise_xor.reduce(mix64(parts + np.arange(1, 4, dtype=np.uint64)))
                keys = np.zeros((hi - lo, bands), np.uint64)
                for b in range(bands):
                    acc = np.full(hi - lo, np.uint64(b + 1))
                    for r in range(rows):
                        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
                    keys[:, b] = acc
                prints = (keys >> np.uint64(48)).astype(np.uint16)
                payload = np.hstack([prints.view(np.uint8).reshape(hi - lo, -1), sig[:, bands * rows :].astype(np.uint8)])
                no = none.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        ties.slice(lo, hi - lo),
                        pa.array(name.view(np.int64), mask=none),
                        pa.array([None if x else k for k, x in zip(keys.view(np.int64), no)], pa.list_(pa.int64())),
                        pa.array([None if x else p.tobytes() for p, x in zip(payload, no)], pa.binary()),
                    ],
                    names=["doc_id", "tie", "cls", "bands", "payload"],
                )

    return sign


def _ahead(first: np.ndarray, stop: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with ``first[i] <= j < stop[i]``, in bounded portions."""
    counts = np.maximum(stop - first, 0)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + at_once, "right")) - 1)
        c = counts[lo:hi]
        if c.any():
            i = np.repeat(np.arange(lo, hi), c)
            yield i, first[i] + np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], c)
        lo = hi


def _run_ends(*columns: np.ndarray) -> np.ndarray:
    """For each row, where the run of rows that are equal in all columns ends."""
    new = np.zeros(len(columns[0]), bool)
    new[-1:] = True
    for c in columns:
        new[:-1] |= c[1:] != c[:-1]
    ends = np.flatnonzero(new) + 1
    return np.repeat(ends, np.diff(ends, prepend=0))


def _runs(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[list]:
    """The columns of consecutive batches, cut where the first ``by`` (int64) columns change; payloads as matrices."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = []
        for c, field in zip(batch.columns, batch.schema):
            if pa.types.is_binary(field.type):
                now.append(np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            else:
                now.append(c.to_numpy(zero_copy_only=False))
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        last = np.ones(len(now[0]), bool)
        for c in now[:by]:
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if held is not None:
        yield held


class _Pruning:
    """Comparison of payloads: the 16-bit prints of band keys, then MinHash values of a byte."""

    def __init__(self, bands: int, compared: int, threshold: float, tolerance: float):
        self.bands, self.least = bands, least_matches(threshold, tolerance, compared, STEP)

    def first_met(self, payload: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs that share no earlier band: the others are taken up there."""
        prints = np.ascontiguousarray(payload[:, : 2 * self.bands]).view(np.uint16)
        for b in range(self.bands):
            new = (band[i] <= b) | (prints[i, b] != prints[j, b])
            i, j = i[new], j[new]
        return i, j

    def likely(self, left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows of two payload matrices that survive all batches."""
        matches = np.zeros(len(i), np.int64)
        for step, fewest in enumerate(self.least):
            part = slice(2 * self.bands + step * STEP, 2 * self.bands + (step + 1) * STEP)
            matches += (left[i, part] == right[j, part]).sum(axis=1)
            on = matches >= fewest
            i, j, matches = i[on], j[on], matches[on]
        return i, j


def _pair_batch(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    differ = a != b
    if differ.any():
        yield pa.RecordBatch.from_arrays([pa.array(a[differ]), pa.array(b[differ])], names=["a", "b"])


def _tile_pairer(pruning: _Pruning):
    """A mapInArrow function over (key, lo, hi, part, comp, cls, band, payload), sorted, to pairs that survive pruning.

    A tile is the rows of one (key, lo, hi).  With part -1 all its rows are compared, with parts 0 and 1
    those of one with those of the other; rows of the same comp never.
    """

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lo, hi, part, comp, cls, band, payload in _runs(batches, 3):
            stop = _run_ends(key, lo, hi)
            first = np.where(part < 0, _run_ends(key, lo, hi, part, comp), np.where(part == 0, _run_ends(key, lo, hi, part), stop))
            for i, j in _ahead(first, stop, PAIRS_AT_ONCE):
                across = comp[i] != comp[j]
                i, j = pruning.first_met(payload, band, i[across], j[across])
                i, j = pruning.likely(payload, payload, i, j)
                yield from _pair_batch(cls[i], cls[j])

    return pair


def _star_pairer(pruning: _Pruning, few: int):
    """A mapInArrow function over (key, cls, band, payload), sorted by key and cls, to pairs that survive pruning.

    All pairs of a bucket of up to ``few`` rows, otherwise those of its smallest class with the others.
    """

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cls, band, payload in _runs(batches, 1):
            stop, row = _run_ends(key), np.arange(len(key))
            start = np.maximum.accumulate(np.where(np.append(True, stop[1:] != stop[:-1]), row, 0))
            large = stop - start > few
            for i, j in _ahead(np.where(large, stop, row + 1), stop, PAIRS_AT_ONCE):
                i, j = pruning.first_met(payload, band, i, j)
                i, j = pruning.likely(payload, payload, i, j)
                yield from _pair_batch(cls[i], cls[j])
            rest = np.flatnonzero(large)
            i, j = pruning.likely(payload, payload, start[rest], rest)
            if len(i):
                once = np.unique(np.stack([cls[i], cls[j]], axis=1), axis=0)
                yield from _pair_batch(once[:, 0], once[:, 1])

    return pair


def _leader_pairer(pruning: _Pruning):
    """A mapInArrow function over (cls, payload, lead, lead_payload) to the pairs (lead, cls) that survive pruning."""

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cls, payload, lead, lead_payload in _runs(batches, 0):
            i, _ = pruning.likely(lead_payload, payload, np.arange(len(cls)), np.arange(len(cls)))
            yield from _pair_batch(lead[i], cls[i])

    return pair


def _forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """For each end of a pair the smallest value that it is connected with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in [*up]}


def _verifier(n: int, threshold: float, sums: bool):
    """A mapInArrow function over rows (tile, a, b, size, text) sorted by tile, texts (b null) before pairs.

    To the similar pairs ``(a, b, jaccard)``; with ``sums`` to ``(a, b, links)`` for each
    class of a tile that has a similar one: the smallest class it is connected with, and the
    number of documents in the classes that are similar to it.
    """

    def settle(sets: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray):
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        known = np.array([x in sets and y in sets for x, y in pairs.tolist()], bool)
        pairs = pairs[known]
        flat = [*sets.items()]
        if not len(pairs):
            return pairs, np.zeros(0)
        if len(pairs) > 2 * len(flat):
            place = {i: k for k, (i, _) in enumerate(flat)}
            size = np.array([len(s) for _, s in flat], np.int64)
            common, column = np.unique(np.concatenate([s for _, s in flat]), return_inverse=True)
            row = np.repeat(np.arange(len(flat)), size)
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            shared = np.zeros((len(flat), len(flat)), np.float32)
            for lo in range(0, len(common), 4096):
                x, y = np.searchsorted(column, [lo, lo + 4096])
                m = np.zeros((len(flat), min(4096, len(common) - lo)), np.float32)
                m[row[x:y], column[x:y] - lo] = 1
                shared += m @ m.T
            i = np.fromiter((place[x] for x in pairs[:, 0].tolist()), np.int64, len(pairs))
            j = np.fromiter((place[x] for x in pairs[:, 1].tolist()), np.int64, len(pairs))
            both = shared[i, j].astype(np.int64)
            return pairs, both / (size[i] + size[j] - both)
        found = np.zeros(len(pairs))
        for k, (x, y) in enumerate(pairs.tolist()):
            s, t = sets[x], sets[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            found[k] = both / max(1, len(s) + len(t) - both)
        return pairs, found

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, sizes, left, right = None, {}, {}, [], []

        def close():
            if not left:
                return
            pairs, found = settle(sets, np.concatenate(left), np.concatenate(right))
            a, b = pairs[found >= threshold].T
            if len(a) and not sums:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(found[found >= threshold])], names=["a", "b", "jaccard"])
            elif len(a):
                ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                weight = np.array([sizes[x] for x in ends.tolist()], np.float64)
                links = np.bincount(at, weights=np.concatenate([weight[at[len(a) :]], weight[at[: len(a)]]]))
                roots = _forest(a, b)
                least = np.array([roots[x] for x in ends.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(least), pa.array(links.astype(np.int64))], names=["a", "b", "links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tiles, a = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            is_text = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            b = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            size = batch.column(3).to_numpy(zero_copy_only=False)
            made = shingle_sets(batch.column(4).filter(pa.array(is_text)).to_pylist(), n)
            ends = np.flatnonzero(np.append(tiles[1:] != tiles[:-1], True)) + 1
            lo = 0
            for hi in ends.tolist():
                if tiles[lo] != tile:
                    yield from close()
                    tile, sets, sizes, left, right = tiles[lo], {}, {}, [], []
                first_pair = lo + int(is_text[lo:hi].sum())
                for k in range(lo, first_pair):
                    sets[int(a[k])], sizes[int(a[k])] = next(made), int(size[k])
                if first_pair < hi:
                    left.append(a[first_pair:hi])
                    right.append(b[first_pair:hi])
                lo = hi
        yield from close()

    return verify


class _Signed:
    """What one pass over the texts leaves, stored.

    ``members`` (doc_id, tie, cls), ``classes`` (cls, doc_id, tie, size, bands, payload), and ``in_buckets``
    (key, n, cls, band): the classes of each bucket that has more than one, and how many it has.  Most
    buckets have one, so payloads are shuffled for the others only.
    """

    def __init__(self, docs: DataFrame, n: int, bands: int, rows: int, compared: int):
        bound_batches(docs.sparkSession)
        self.texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").where("doc_id is not null")
        signed = stored(
            self.texts.mapInArrow(_signer(n, bands, rows, compared), "doc_id bigint, tie bigint, cls bigint, bands array<bigint>, payload binary"), "signed"
        )
        self.members = signed.select("doc_id", "tie", "cls")
        sizes = signed.where("cls is not null").select("doc_id", "cls").distinct().groupBy("cls").agg(F.count("*").alias("size"))
        one = signed.where("cls is not null").groupBy("cls").agg(
            F.min(F.struct("doc_id", "tie")).alias("least"), F.first("bands").alias("bands"), F.first("payload").alias("payload")
        )
        self.classes = stored(one.join(sizes, "cls").select("cls", "least.*", "size", "bands", "payload"), "classes")

        bands_of = self.classes.select("cls", F.posexplode("bands").alias("band", "key"))
        shared = stored(bands_of.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        self.in_buckets = stored(bands_of.join(small_enough(shared), "key").select("key", "n", "cls", "band"), "buckets")

    def with_payload(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.classes.select("cls", "payload"), "cls")


def _parts(n: Column) -> Column:
    return F.ceil(n / F.lit(BUCKET_ROWS)).cast("int")


def _part_of(parts: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(3)), parts).cast("int")


def _tile(lo: Column, hi: Column, part: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), part.cast("int").alias("part"))


def _square(own: Column, parts: Column, shift: Column) -> Column:
    """The tiles in which a row of part ``own`` meets all parts."""

    def one(j: Column) -> Column:
        return _tile(shift + F.least(own, j), shift + F.greatest(own, j), F.when(own == j, -1).otherwise((own > j).cast("int")))

    return F.transform(F.sequence(F.lit(0), parts - 1), one)


def _tile_pairs(rows: DataFrame, pruning: _Pruning) -> DataFrame:
    """The pairs that survive, from rows (key, tile, comp, cls, band, payload)."""
    flat = rows.select("key", "tile.lo", "tile.hi", "tile.part", "comp", "cls", "band", "payload")
    order = ("key", "lo", "hi", "part", "comp", "cls")
    return flat.repartition("key", "lo", "hi").sortWithinPartitions(*order).mapInArrow(_tile_pairer(pruning), "a bigint, b bigint")


def _candidates(signed: _Signed, pruning: _Pruning) -> DataFrame:
    """All pairs of classes that share a bucket and survive pruning, once each; stored."""
    rows = signed.with_payload(signed.in_buckets).withColumn("parts", _parts(F.col("n")))
    whole = F.array(_tile(F.lit(0), F.lit(0), F.lit(-1)))
    tiles = F.when(F.col("parts") == 1, whole).otherwise(_square(_part_of(F.col("parts")), F.col("parts"), F.lit(0)))
    tiled = rows.select("key", F.explode(tiles).alias("tile"), F.col("cls").alias("comp"), "cls", "band", "payload")
    return stored(_tile_pairs(tiled, pruning), "candidates")


def _verified(signed: _Signed, pairs: DataFrame, n: int, threshold: float, tile_docs: int, sums: bool) -> DataFrame:
    """What :func:`_verifier` makes of stored candidates (a, b)."""
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label"))
    labelled = pairs.join(label, "a")
    sizes = labelled.groupBy("label").agg(
        F.ceil(F.approx_count_distinct("a") / F.lit(tile_docs)).alias("ka"), F.ceil(F.approx_count_distinct("b") / F.lit(tile_docs)).alias("kb")
    )
    tiled = stored(
        labelled.join(sizes, "label").select(
            F.xxhash64("label", F.pmod(F.xxhash64("a"), "ka"), F.pmod(F.xxhash64("b"), "kb")).alias("tile"), "a", "b"
        ),
        "tiles",
    )
    needed = tiled.select("tile", F.explode(F.array("a", "b")).alias("cls")).distinct()
    needed = stored(needed.join(signed.classes.select("cls", "doc_id", "tie", "size"), "cls"), "needed")
    texts = signed.texts.join(small_enough(needed), ["doc_id", "tie"]).select(
        "tile", F.col("cls").alias("a"), F.lit(None).cast("bigint").alias("b"), "size", "text"
    )
    both = texts.unionByName(tiled.select("tile", "a", "b", F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("text")))
    return (
        both.repartition("tile")
        .sortWithinPartitions("tile", F.col("b").isNotNull())
        .mapInArrow(_verifier(n, threshold, sums), "a bigint, b bigint, " + ("links bigint" if sums else "jaccard double"))
    )


def class_pairs(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    compared: int = COMPARED,
    tolerance: float = TOLERANCE,
    tile_docs: int = TILE_DOCS,
) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, cls)`` and the similar pairs of classes ``(a, b, jaccard)``, of which there may be quadratically many.

    Texts without words are in no class (null).
    """
    signed = _Signed(docs, n, bands, rows, compared)
    pairs = _candidates(signed, _Pruning(bands, compared, threshold, tolerance))
    return signed.members.select("doc_id", "cls").distinct(), _verified(signed, pairs, n, threshold, tile_docs, sums=False)


def jaccard_join(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    compared: int = COMPARED,
    tolerance: float = TOLERANCE,
    tile_docs: int = TILE_DOCS,
) -> DataFrame:
    """One row a document: ``(doc_id, class_id, copies, links)``.

    ``links`` is the number of other documents whose n-gram sets are similar to this
    one's, ``copies`` of those the ones with the same set; ``class_id`` is the smallest
    ``doc_id`` of all documents that links connect with this one, directly or over others.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Rows without
    an id are left out.  Texts without words (null, empty, punctuation only) have no
    links and are classes of their own.  Texts of fewer than ``n`` words have one n-gram,
    all their words.  Repeated rows count once; an id with several different sets has a
    row for each, which count as different documents.  No link is capped away; ``bands``
    and ``rows`` set the recall (at similarity s it is 1 - (1 - s**rows)**bands) and every
    link was verified exactly.
    """
    signed = _Signed(docs, n, bands, rows, compared)
    pairs = _candidates(signed, _Pruning(bands, compared, threshold, tolerance))
    found = stored(_verified(signed, pairs, n, threshold, tile_docs, sums=True), "found")
    links = found.groupBy("a").agg(F.sum("links").alias("near")).withColumnRenamed("a", "cls")
    known = signed.classes.select("cls", "doc_id", "size").join(links, "cls", "left").join(groups(found).withColumnRenamed("id", "cls"), "cls", "left")
    known = stored(known.select("cls", "doc_id", "size", F.coalesce("near", F.lit(0)).alias("near"), "group_id"), "known")
    least = known.where("group_id is not null").groupBy("group_id").agg(F.min("doc_id").alias("least"))
    by_class = known.join(least, "group_id", "left").select(
        "cls", F.coalesce("least", "doc_id").alias("class_id"), (F.col("size") - 1).alias("copies"), (F.col("size") - 1 + F.col("near")).alias("links")
    )
    zero = F.lit(0).cast("bigint")
    return (
        signed.members.select("doc_id", "cls")
        .distinct()
        .join(by_class, "cls", "left")
        .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", zero).alias("copies"), F.coalesce("links", zero).alias("links"))
    )


def groups(pairs: DataFrame) -> DataFrame:
    """Connected components of the pairs ``(a, b)``: ``(id, group_id)``, the group's smallest id.

    Alternating large and small stars (Kiveris et al., 2014) until no edge moves: each
    id passes its larger, then its smaller neighbours on to the smallest id around it.
    Edges are stored after each step, and there are never more of them than pairs.
    """
    edges = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    while True:
        # large: of all neighbours the larger ones
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        # small: of the smaller neighbours all, and the id itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = new
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    return found.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())


def _star_candidates(signed: _Signed, pruning: _Pruning) -> DataFrame:
    """Candidates that connect each bucket's members with its smallest class; of small buckets all pairs.  Stored."""
    rows = signed.with_payload(signed.in_buckets)
    large = rows.where(F.col("n") > BUCKET_ROWS)
    lead = stored(large.groupBy("key").agg(F.min(F.struct("cls", "payload")).alias("lead")), "leaders")
    led = large.join(small_enough(lead), "key").select("cls", "payload", F.col("lead.cls").alias("lead"), F.col("lead.payload").alias("lead_payload"))
    plain = rows.where(F.col("n") <= BUCKET_ROWS).select("key", "cls", "band", "payload")
    pairs = plain.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(_star_pairer(pruning, FEW), "a bigint, b bigint")
    return stored(pairs.unionByName(led.mapInArrow(_leader_pairer(pruning), "a bigint, b bigint")).distinct(), "candidates")


def _across_candidates(signed: _Signed, comp: DataFrame, pruning: _Pruning) -> DataFrame:
    """Candidates among the members of buckets of more than ``FEW`` that are in different components.  Stored.

    In a bucket that is cut into parts, the component of the smallest class is not compared with itself,
    so its parts are repeated for those of the other members only.
    """
    rows = signed.in_buckets.where(F.col("n") > FEW).join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = stored(rows, "members")
    mixed = rows.groupBy("key").agg(F.min(F.struct("cls", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = stored(mixed.where("lo <> hi").select("key", F.col("lead.comp").alias("lead")), "mixed")
    in_mixed = rows.join(small_enough(mixed), "key")
    others = in_mixed.where(F.col("n") > BUCKET_ROWS).groupBy("key").agg(F.count_if(F.col("comp") != F.col("lead")).alias("others"))
    cut = in_mixed.join(small_enough(stored(others, "others")), "key", "left")
    cut = cut.withColumns({"own": F.greatest(_parts(F.col("n") - F.col("others")), F.lit(1)), "few": F.greatest(_parts(F.col("others")), F.lit(1))})
    at_own, at_few = _part_of(F.col("own")), _part_of(F.col("few"))
    inside = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda b: _tile(at_own, F.col("own") + b, F.lit(0)))
    outside = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda p: _tile(p, F.col("own") + at_few, F.lit(1))), _square(at_few, F.col("few"), F.col("own"))
    )
    whole = F.array(_tile(F.lit(0), F.lit(0), F.lit(-1)))
    tiles = F.when(F.col("others").isNull(), whole).when(F.col("comp") == F.col("lead"), inside).otherwise(outside)
    tiled = signed.with_payload(cut).select("key", F.explode(tiles).alias("tile"), "comp", "cls", "band", "payload")
    return stored(_tile_pairs(tiled, pruning), "across")


def deduplicate(
    docs: DataFrame,
    n: int = N,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
    compared: int = COMPARED,
    tolerance: float = TOLERANCE,
    tile_docs: int = TILE_DOCS,
) -> DataFrame:
    """``docs`` without all but the smallest ``doc_id`` of each group of similar documents.

    Groups are those that :func:`jaccard_join` gives as ``class_id``.  Rows without an
    id, and texts without words, stay.  Columns and repeated rows of what stays are
    unchanged; rows of one id and different texts are judged one by one.
    """
    signed, pruning = _Signed(docs, n, bands, rows, compared), _Pruning(bands, compared, threshold, tolerance)
    edges = stored(_verified(signed, _star_candidates(signed, pruning), n, threshold, tile_docs, sums=True).select("a", "b"), "edges")
    part = stored(groups(edges).select(F.col("id").alias("cls"), F.col("group_id").alias("comp")), "parts")
    across = _across_candidates(signed, part, pruning)
    if not across.isEmpty():
        more = stored(_verified(signed, across, n, threshold, tile_docs, sums=True).select("a", "b"), "edges")
        if not more.isEmpty():
            part = groups(edges.unionByName(more)).select(F.col("id").alias("cls"), F.col("group_id").alias("comp"))
    known = stored(signed.classes.select("cls", "doc_id", "size").join(part, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "known")
    least = known.groupBy("comp").agg(F.min("doc_id").alias("least"), F.sum("size").alias("docs")).where("docs > 1")
    judged = signed.members.join(known.join(least, "comp").select("cls", "least"), "cls").where("doc_id <> least")
    gone = small_enough(stored(judged.select(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).distinct(), "gone"))
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_tie"]), "left_anti")
