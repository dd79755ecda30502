"""Byte-level BPE by tiktoken from a public vocabulary file, for use on executors."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import tiktoken

#: Where the vocabulary is by default; any file of base64 tokens and ranks will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver; executors get it as a broadcast."""
    return Path(path).read_bytes()


@lru_cache(maxsize=2)
def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary file's contents; texts have no special tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
