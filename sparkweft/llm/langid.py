"""Language identification by interpolated Kneser-Ney character models.

A model holds, for each language and order, the n-grams seen in training as a
sorted array of 32-bit hashes with their interpolated log-probabilities, and
the back-off weights of contexts in the same form.  For scoring, the tables of
all languages are merged: one sorted array of hashes by order, with a column of
log-probabilities by language, so a character costs one binary search however
many languages there are; only n-grams that no language has seen go on to lower
orders.

Texts are lower-cased, and runs of anything but letters become one space.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches
from .text import chunks

ORDER = 4
#: Labelled documents a language that are looked at, for training and calibration together.
SAMPLE_DOCS = 600
#: Share of them that is held out to calibrate rejection.
HELD_OUT = 0.25
#: Share of held-out documents beyond the limit of rejection, and the distance added to it.
FALSE_REJECTIONS = 0.001
MARGIN = 6.0
#: Bits a symbol above the mean that a text must have besides, to be rejected: a text in two known
#: languages is odd to either model but is not unknown.
EXCESS_BITS = 1.2
#: Size of the alphabet for the uniform distribution below the unigrams.
ALPHABET = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def symbols(texts: Sequence[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Normalised code points of all texts, each after ``order - 1`` zeros; where each text's zeros start."""
    pad = "\0" * (order - 1)
    joined = pad + pad.join((t or "").lower().replace("\0", " ") for t in texts) if texts else ""
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[cp]
    zero = cp == 0
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = letter[:-1]
    keep = letter | zero | before
    flat = np.where(letter | zero, cp, np.uint32(32))[keep]
    zeros = np.flatnonzero(flat == 0)
    return flat, zeros[:: order - 1] if order > 1 else np.zeros(len(texts), np.int64)


def gram_hashes(flat: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the n symbols that end at each position (short ones at the start are padded by zeros)."""
    acc = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc[k:] += flat[: len(flat) - k] + np.uint64(1)
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
    return (acc >> np.uint64(32)).astype(np.uint32)


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``keys`` in a sorted table, and which were found."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


@dataclass
class LanguageModel:
    """Sorted hash arrays of one language: log-probabilities and back-off weights by order."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    order: int

    @classmethod
    def train(cls, texts: Sequence[str | None], order: int = ORDER) -> LanguageModel:
        """Interpolated Kneser-Ney estimates with one discount an order."""
        parts = [symbols(texts[lo:hi], order)[0] for lo, hi in chunks(texts)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        scored = flat != 0
        hashes = [gram_hashes(flat, n)[scored] for n in range(1, order + 1)]
        shifted = [gram_hashes(np.concatenate([np.zeros(1, np.uint32), flat[:-1]]), n)[scored] for n in range(1, order)]
        grams, logp, contexts, backoff = [], [], [], []
        lower: dict[str, np.ndarray] | None = None
        for n in range(1, order + 1):
            keys, first, inverse, count = np.unique(hashes[n - 1], return_index=True, return_inverse=True, return_counts=True)
            if n < order:  # how many different symbols come before
                longer, at = np.unique(hashes[n], return_index=True)
                count = np.bincount(inverse[at], minlength=len(keys))
            context = shifted[n - 2][first] if n > 1 else np.zeros(len(keys), np.uint32)
            ctx, of = np.unique(context, return_inverse=True)
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total = np.bincount(of, weights=count, minlength=len(ctx))
            gamma = d * np.bincount(of, minlength=len(ctx)) / np.maximum(total, 1e-300)
            if n == 1:
                below = np.full(len(keys), 1 / ALPHABET)
            else:
                at, _ = find(lower["keys"], hashes[n - 2][first])
                below = lower["p"][at]
            p = (count - d) / total[of] + gamma[of] * below if len(keys) else np.zeros(0)
            grams.append(keys)
            logp.append(np.log(p))
            contexts.append(ctx)
            backoff.append(np.log(gamma))
            lower = {"keys": keys, "p": p}
        return cls(grams, logp, contexts, backoff, order)

    def log_probabilities(self, by_order: list[np.ndarray], context_by_order: list[np.ndarray]) -> np.ndarray:
        """Log-probability of the symbol at each position, given hashes by order."""
        n = len(by_order[0])
        floor = (self.backoff[0][0] if len(self.backoff[0]) else 0.0) - np.log(ALPHABET)
        out = np.full(n, floor)
        for k in range(self.order):
            at, seen = find(self.grams[k], by_order[k])
            if k:
                c, known = find(self.contexts[k], context_by_order[k])
                out += np.where(known, self.backoff[k][c] if len(self.backoff[k]) else 0.0, 0.0)
            if len(self.logp[k]):
                out = np.where(seen, self.logp[k][at], out)
        return out


@dataclass
class Identifier:
    """Merged tables of all languages, and the limits of rejection."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]  # (n-grams, languages) by order
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray
    by_symbol: np.ndarray
    spread: np.ndarray
    limit: np.ndarray
    excess_bits: float = EXCESS_BITS

    @classmethod
    def merge(cls, models: dict[str, LanguageModel]) -> Identifier:
        languages = sorted(models)
        order = next(iter(models.values())).order if models else ORDER
        grams, logp, contexts, backoff = [], [], [], []
        size = len(languages)
        floor = np.array([(m.backoff[0][0] if len(m.backoff[0]) else 0.0) - np.log(ALPHABET) for m in (models[x] for x in languages)])
        for k in range(order):
            every = [models[x].grams[k] for x in languages]
            grams.append(np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint32))
            ctx = [models[x].contexts[k] for x in languages]
            contexts.append(np.unique(np.concatenate(ctx)) if ctx else np.zeros(0, np.uint32))
            weight = np.zeros((len(contexts[k]), size), np.float32)
            table = np.full((len(grams[k]), size), np.nan, np.float32)
            for i, x in enumerate(languages):
                at, seen = find(models[x].grams[k], grams[k])
                table[seen, i] = models[x].logp[k][at[seen]]
                at, seen = find(models[x].contexts[k], contexts[k])
                weight[seen, i] = models[x].backoff[k][at[seen]]
            logp.append(table)
            backoff.append(weight)
        return cls(
            languages, order, grams, logp, contexts, backoff, floor.astype(np.float32),
            mean=np.zeros(size), by_symbol=np.ones(size), spread=np.zeros(size), limit=np.full(size, np.inf),
        )

    def complete(self, texts: Sequence[str | None]) -> None:
        """Fills in what a language has not seen of the others' n-grams, from the texts that hold them."""
        for lo, hi in chunks(texts):
            flat, _ = symbols(texts[lo:hi], self.order)
            by, ctx, _ = self._hashes(flat)
            below = np.broadcast_to(self.floor, (len(by[0]), len(self.languages))).copy()
            for k in range(self.order):
                if k:
                    c, known = find(self.contexts[k], ctx[k])
                    below += np.where(known[:, None], self.backoff[k][c], 0)
                at, seen = find(self.grams[k], by[k])
                rows = self.logp[k][at]
                below = np.where(np.isnan(rows) | ~seen[:, None], below, rows)
                self.logp[k][at[seen]] = below[seen]

    def _hashes(self, flat: np.ndarray):
        scored = flat != 0
        before = np.concatenate([np.zeros(1, np.uint32), flat[:-1]])
        by = [gram_hashes(flat, n)[scored] for n in range(1, self.order + 1)]
        ctx = [np.zeros(0, np.uint32)] + [gram_hashes(before, n)[scored] for n in range(1, self.order)]
        return by, ctx, scored

    def _rows(self, flat: np.ndarray, scored: np.ndarray, k: int, where: np.ndarray | None) -> np.ndarray:
        """(positions, languages) log-probabilities at order k + 1, falling back to lower orders."""
        if k < 0:
            return np.broadcast_to(self.floor, (int(scored.sum()) if where is None else len(where), len(self.languages)))
        places = np.flatnonzero(scored) if where is None else where
        keys = gram_hashes(flat, k + 1)[places] if where is None else self._at(flat, places, k + 1, 0)
        at, seen = find(self.grams[k], keys)
        out = self.logp[k][at] if len(self.grams[k]) else np.zeros((len(places), len(self.languages)), np.float32)
        miss = np.flatnonzero(~seen)
        if len(miss):
            lower = self._rows(flat, scored, k - 1, places[miss])
            if k:
                c, known = find(self.contexts[k], self._at(flat, places[miss], k, 1))
                lower = lower + np.where(known[:, None], self.backoff[k][c], np.float32(0))
            out[miss] = lower
        return out

    @staticmethod
    def _at(flat: np.ndarray, places: np.ndarray, n: int, back: int) -> np.ndarray:
        """The hash of the n symbols that end ``back`` before each of some positions."""
        index = places[:, None] - back - np.arange(n)[None, :]
        window = np.where(index >= 0, flat[np.maximum(index, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        acc = np.zeros(len(places), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n - 1, -1, -1):
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + window[:, k]
            acc ^= acc >> np.uint64(29)
            acc *= np.uint64(0xBF58476D1CE4E5B9)
        return (acc >> np.uint64(32)).astype(np.uint32)

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in bits a symbol, (texts, languages), and the symbols of each text."""
        size = np.zeros(len(texts), np.int64)
        bits = np.zeros((len(texts), len(self.languages)))
        for lo, hi in chunks(texts):
            flat, starts = symbols(texts[lo:hi], self.order)
            scored = flat != 0
            n = np.diff(np.append(starts, len(flat))) - (self.order - 1)
            size[lo:hi] = n
            some = np.flatnonzero(n > 0)
            if len(some):
                first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)[:-1]])[some]
                rows = self._rows(flat, scored, self.order - 1, None)
                bits[lo + some] = np.add.reduceat(rows, first, axis=0, dtype=np.float64) / (-np.log(2) * n[some, None])
        return bits, size

    def distance(self, bits: np.ndarray, size: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far above its language's mean a text is, in standard deviations at its length."""
        row = bits[np.arange(len(best)), best]
        return (row - self.mean[best]) / np.sqrt(self.by_symbol[best] / np.maximum(size, 1) + self.spread[best])

    def accepted(self, bits: np.ndarray, size: np.ndarray, best: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Whether each text has letters and is near enough to its language."""
        row = bits[np.arange(len(best)), best]
        return (size > 0) & ((distance <= self.limit[best]) | (row <= self.mean[best] + self.excess_bits))

    def calibrate(self, texts: Sequence[str | None], labels: Sequence[str], rate: float, margin: float) -> None:
        bits, size = self.scores(texts)
        for i, x in enumerate(self.languages):
            mine = np.flatnonzero((np.array(labels) == x) & (size > 0))
            if not len(mine):
                continue
            b, n = bits[mine, i], size[mine]
            self.mean[i] = (b * n).sum() / n.sum()
            squares = (b - self.mean[i]) ** 2
            short = n <= np.median(n)
            # variances from medians (0.455 is that of a squared normal), so that a few odd texts don't widen them
            self.by_symbol[i] = max(1.0, float(np.median(squares[short] * n[short])) / 0.455)
            self.spread[i] = float(np.median(squares[~short])) / 0.455 if (~short).any() else 0.0
            z = self.distance(b[:, None].repeat(len(self.languages), 1), n, np.full(len(mine), i))
            self.limit[i] = max(0.0, float(np.quantile(z, 1 - rate))) + margin


def shares(languages: dict[str, tuple[int, int]], bound: int) -> dict[str, int]:
    """For each language the 63-bit hash below which its documents are drawn, from (documents, smallest hash).

    In expectation ``bound`` documents are; the one of the smallest hash always is, so no
    language is left out however many or few documents it has.
    """
    return {x: min(2**63 - 1, max(2**63 * bound // n, least + 1)) for x, (n, least) in languages.items()}


def sample(docs: DataFrame, bound: int, seed: int) -> list[tuple[str, str, int]]:
    """Up to twice ``bound`` labelled documents a language, ``bound`` in expectation, drawn by a hash of the id: (lang, text, hash)."""
    labelled = docs.where("lang is not null and text is not null and doc_id is not null")
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    counted = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(h).alias("least")).collect()
    if not counted:
        return []
    below = shares({r["lang"]: (r["n"], r["least"]) for r in counted}, bound)
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    drawn = labelled.select("lang", "text", h.alias("h")).where(F.col("h") < limit[F.col("lang")])
    first = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"))  # ids that repeat have one hash
    rows = drawn.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * bound).select("lang", "text", F.xxhash64("h", F.lit(seed + 1)).alias("h")).collect()
    found = sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: (r[0], r[2], r[1]))
    absent = set(below) - {r[0] for r in found}
    if absent:
        raise RuntimeError(f"no documents were drawn for {sorted(absent)}")
    return found


def train(
    docs: DataFrame,
    order: int = ORDER,
    sample_docs: int = SAMPLE_DOCS,
    held_out: float = HELD_OUT,
    false_rejections: float = FALSE_REJECTIONS,
    margin: float = MARGIN,
    seed: int = 11,
) -> Identifier:
    """An identifier from a bounded sample of the rows of ``docs`` that have a label in ``lang``.

    The sample is ``sample_docs`` documents a language in expectation and twice as many
    at most, so what the driver holds does not depend on the size of the corpus.  Every
    language with a labelled document is in the model.
    """
    rows = sample(docs, sample_docs, seed)
    aside = {i for i, r in enumerate(rows) if r[2] % 1000 < 1000 * held_out}
    by: dict[str, list[str]] = {}
    for i, (lang, text, _) in enumerate(rows):
        by.setdefault(lang, [])
        if i not in aside:
            by[lang].append(text)
    for i in sorted(aside):  # a language so rare that all its rows were held out
        if not by[rows[i][0]]:
            by[rows[i][0]].append(rows[i][1])
    model = Identifier.merge({lang: LanguageModel.train(texts, order) for lang, texts in by.items()})
    model.complete([t for texts in by.values() for t in texts])
    held = [rows[i] for i in sorted(aside)]
    model.calibrate([r[1] for r in held], [r[0] for r in held], false_rejections, margin)
    return model


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """``(doc_id, lang_found, bits, distance)`` for each row of ``docs``, which needs ``doc_id`` and ``text``.

    ``lang_found`` is the language of lowest cross-entropy a symbol (``bits``; of
    equals the first by name), or ``und`` where the text is further above the mean
    of that language than held-out text ever was (``distance`` in standard
    deviations at that length) and by more than ``EXCESS_BITS``, or has no letters
    (null and empty texts; ``bits`` and ``distance`` are then null).  Rows are neither dropped nor merged, null ids
    stay, other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            bits, size = m.scores(batch.column(1).to_pylist())
            if m.languages:
                best = bits.argmin(axis=1)
                z = m.distance(bits, size, best)
                least = bits[np.arange(len(best)), best]
                good = m.accepted(bits, size, best, z)
            else:
                best, z, least, good = (np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), bool))
            none = (size == 0) | (not m.languages)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.languages[b] if g else UNKNOWN for b, g in zip(best.tolist(), good.tolist())], pa.string()),
                    pa.array(least, pa.float64(), mask=none),
                    pa.array(z, pa.float64(), mask=none),
                ],
                names=["doc_id", "lang_found", "bits", "distance"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, lang_found string, bits double, distance double"
    )


def keep_identified(docs: DataFrame, model: Identifier) -> DataFrame:
    """The rows of ``docs`` whose language is identified, with it in ``lang``; other columns as they are."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            bits, size = m.scores(batch.column(names.index("text")).to_pylist())
            if not m.languages or not len(size):
                continue
            best = bits.argmin(axis=1)
            good = m.accepted(bits, size, best, m.distance(bits, size, best))
            found = pa.array([m.languages[b] for b in best.tolist()], batch.schema.field("lang").type)
            columns = [found if x == "lang" else batch.column(k) for k, x in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
