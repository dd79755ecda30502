"""Token ids as a wavelet matrix a shard, in one compressed file.

A wavelet matrix keeps a sequence of numbers as one bit-plane a bit, most
significant first; each plane holds the bits of the sequence in the order that
results from moving all numbers with a 0 in the plane before ahead of those with
a 1.  With rank and select on the planes, a token can be read, the occurrences of
a token in a range counted, and its k-th occurrence found, each in one step a
plane and without expanding the sequence.

The file holds a header, the ids and offsets of the documents, and the planes in
blocks that are compressed one by one, with the number of ones ahead of each, so
that a lookup expands one or two blocks a plane.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, stored
from .tokens import VOCABULARY, encoding, vocabulary_bytes

MAGIC = b"WVMX0001"
#: Tokens after which a shard is closed; a document is never split.
SHARD_TOKENS = 4_000_000
BLOCK_BITS = 1 << 18
LEVEL = 3
#: Expanded blocks (about 300 kB each) that a reader keeps.
CACHED_BLOCKS = 256


def pack(tokens: np.ndarray, doc_ids: Sequence[int | None], offsets: np.ndarray, bits: int) -> bytes:
    """The file of a shard: token ids below ``2**bits``, and n + 1 offsets of its n documents."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    cur = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    zeros, ones, sizes, parts = [], [], [], []
    for plane in range(bits - 1, -1, -1):
        bit = ((cur >> plane) & 1).astype(bool)
        packed = np.packbits(bit)
        cur = np.concatenate([cur[~bit], cur[bit]])
        total = 0
        for lo in range(0, len(packed), BLOCK_BITS // 8):
            block = packed[lo : lo + BLOCK_BITS // 8]
            ones.append(total)
            total += int(np.bitwise_count(block).sum())
            parts.append(squeeze(block.tobytes()))
            sizes.append(len(parts[-1]))
        zeros.append(len(tokens) - total)
    ids = np.array([i or 0 for i in doc_ids], np.int64)
    tables = [
        squeeze(x.tobytes())
        for x in (ids, np.array([i is None for i in doc_ids], np.uint8), offsets.astype(np.int64), np.array(zeros, np.int64), np.array(ones, np.int64), np.array(sizes, np.int64))
    ]
    head = json.dumps({"tokens": len(tokens), "documents": len(ids), "bits": bits, "block_bits": BLOCK_BITS, "tables": [len(t) for t in tables]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *tables, *parts])


class WaveletShard:
    """Reads a shard's file without expanding the sequence.

    ``data`` is the file's bytes, or a function from an offset and a length to the bytes
    there (see :meth:`open`), so that a lookup reads the blocks it needs and no more.
    """

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self._read = data if callable(data) else lambda at, n: data[at : at + n]
        fixed = len(MAGIC) + 4
        start = self._read(0, fixed)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = struct.unpack_from("<I", start, len(MAGIC))[0]
        head = json.loads(self._read(fixed, size))
        at = fixed + size
        self._expand = zstandard.ZstdDecompressor().decompress
        tables = []
        for n, kind in zip(head["tables"], (np.int64, np.uint8, *[np.int64] * 4)):
            tables.append(np.frombuffer(self._expand(self._read(at, n)), kind))
            at += n
        ids, null, self.offsets, self.zeros, self._ones, sizes = tables
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.n_tokens, self.bits, self._block_bits = head["tokens"], head["bits"], head["block_bits"]
        self._blocks = -(-self.n_tokens // self._block_bits)
        self._at = at + np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        self._block = lru_cache(maxsize=CACHED_BLOCKS)(self._load)

    @classmethod
    def open(cls, path: str) -> WaveletShard:
        """A shard's file in any file system that Arrow knows (a local path, ``hdfs:``, ``s3:``, ``gs:``)."""
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        file = system.open_input_file(inner)

        def read(at: int, n: int) -> bytes:
            return file.read_at(n, int(at))

        return cls(read)

    def _raw(self, k: int) -> np.ndarray:
        return np.frombuffer(self._expand(self._read(int(self._at[k]), int(self._at[k + 1] - self._at[k]))), np.uint8)

    def _load(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones ahead of each byte within it."""
        raw = self._raw(level * self._blocks + b)
        return raw, np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(raw), dtype=np.int64)])

    def _bit(self, level: int, i: int) -> int:
        raw, _ = self._block(level, i // self._block_bits)
        j = i % self._block_bits
        return int(raw[j >> 3]) >> (7 - (j & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones ahead of position ``i`` of a plane."""
        if i >= self.n_tokens:
            return self.n_tokens - int(self.zeros[level])
        raw, ahead = self._block(level, i // self._block_bits)
        j = i % self._block_bits
        part = int(raw[j >> 3]) >> (8 - (j & 7)) if j & 7 else 0
        return int(self._ones[level * self._blocks + i // self._block_bits]) + int(ahead[j >> 3]) + part.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) ``bit`` of a plane."""
        lo, hi = 0, self.n_tokens - 1
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            token = token << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``token`` in positions ``lo`` to ``hi``."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, max(0, lo), self.n_tokens if hi is None else min(hi, self.n_tokens))
        return max(0, b - a)

    def locate(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of ``token``; -1 if there is none."""
        if not 0 <= k < self.count(token):
            return -1
        i = self._range(token, 0, self.n_tokens)[0] + k
        for level in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - level) & 1:
                i = self._select(level, 1, i - int(self.zeros[level]))
            else:
                i = self._select(level, 0, i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence."""
        out = np.zeros(self.n_tokens, np.uint32)
        to = np.arange(self.n_tokens)
        for level in range(self.bits):
            raw = [self._raw(k) for k in range(level * self._blocks, (level + 1) * self._blocks)]
            bit = np.unpackbits(np.concatenate(raw) if raw else np.zeros(0, np.uint8), count=self.n_tokens).astype(bool)
            out[to] |= bit.astype(np.uint32) << np.uint32(self.bits - 1 - level)
            to = np.concatenate([to[~bit], to[bit]])
        return out

    def document(self, k: int) -> list[int]:
        """The tokens of the k-th document."""
        return [self.access(i) for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))]


def wavelet_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(shard_id, doc_ids, n_docs, n_tokens, n_bytes, data)``: the texts' token ids, a wavelet matrix a shard.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Shards are cut
    from each input partition in its order, so nothing is shuffled and a task that
    runs again gives the same shards.  Every row is in exactly one shard, whole and
    in its place: null and empty texts as documents without tokens, repeated rows
    repeatedly, null ids as null.  A shard is closed with the document that brings
    it to ``shard_tokens``; an empty table has no shards.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        bits = max(1, (enc.n_vocab - 1).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        shard = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0

        def close() -> pa.RecordBatch:
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts], dtype=np.int64)])
            data = pack(np.concatenate(parts), ids, offsets, bits)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([len(data)], pa.int64()),
                    pa.array([data], pa.binary()),
                ],
                names=["shard_id", "doc_ids", "n_docs", "n_tokens", "n_bytes", "data"],
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.array(enc.encode_ordinary(text.as_py() or ""), kind)
                ids.append(i)
                parts.append(tokens)
                size += len(tokens)
                if size >= shard_tokens:
                    yield close()
                    shard += 1
                    ids, parts, size = [], [], 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "shard_id bigint, doc_ids array<bigint>, n_docs bigint, n_tokens bigint, n_bytes bigint, data binary"
    )


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each row of :func:`wavelet_shards` as one file of ``folder``: ``(shard_id, path, n_docs, n_tokens, n_bytes)``, stored.

    ``folder`` is shared by all executors, in a file system that Arrow knows.  A file is
    named by its shard, written under another name and then renamed, so tasks that run
    again or twice leave whole files, and the same ones.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            names = [f"shard-{i:016x}.wvm" for i in batch.column(0).to_pylist()]
            for name, data in zip(names, batch.column(4)):
                part = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with system.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                system.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f"{folder}/{n}" for n in names], pa.string()), *(batch.column(k) for k in (1, 2, 3))],
                names=["shard_id", "path", "n_docs", "n_tokens", "n_bytes"],
            )

    listed = shards.select("shard_id", "n_docs", "n_tokens", "n_bytes", "data").mapInArrow(run, "shard_id bigint, path string, n_docs bigint, n_tokens bigint, n_bytes bigint")
    return stored(listed, "files")
