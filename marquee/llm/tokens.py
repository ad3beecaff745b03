"""Byte-level tokens of a public vocabulary file; the file is read on the driver and sent along."""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pattern that the vocabulary's merges were made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_KEPT = 400_000


def read(path: str = VOCABULARY) -> bytes:
    return Path(path).read_bytes()


class Tokens:
    """Encodes texts piece by piece, a piece being a blank and what follows up to the next one.

    Pieces are kept with their ids, so that common words are encoded once. The ids of a text are
    the joined ids of its pieces, and their bytes are the text's bytes whatever the pieces.
    """

    def __init__(self, file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
        self.size = len(ranks)
        self.end = self.size  # the first free id
        self._encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self.dtype = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self._kept: dict[str, bytes] = _Kept(self._encode)

    def _encode(self, piece: str) -> bytes:
        return np.array(self._encoding.encode_ordinary(piece), self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian numbers of ``dtype``."""
        if len(self._kept) > _KEPT:
            self._kept.clear()
        first, *rest = text.split(" ")
        # Pieces after a blank are kept under the text behind it, the first one under its own mark.
        head = self._encode(first) if first else b""
        return head + b"".join(map(self._kept.__getitem__, rest))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // self.dtype.itemsize

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, self.dtype).tolist()
        return b"".join(self._bytes.get(i, b"") for i in own).decode("utf-8", "replace")


class _Kept(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self._encode(" " + piece)
        return out
