"""Whole texts as byte arrays: what the Arrow operators share.

A batch of texts is one buffer with a line feed after every text, so that words
and lines never cross texts and all work on it is vectorised. Slices are cut by
bytes, not rows: one very long text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes that separate words.
SPACES = b" \t\n\v\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Just under a power of two, as the tables of powers are.
SLICE_BYTES = (1 << 20) - (1 << 15)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_TO_LOWER = bytes(LOWER)

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def encoded(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def lowered(text: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return text.translate(_TO_LOWER)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of batches with at most SLICE_BYTES of text, or one row, and their texts."""
    for batch in batches:
        texts = encoded(batch.column(column))
        start, held = 0, 0
        for at, text in enumerate(texts):
            size = len(text or b"")
            if at > start and held + size > SLICE_BYTES:
                yield batch.slice(start, at - start), texts[start:at]
                start, held = at, 0
            held += size
        if start < len(texts):
            yield batch.slice(start), texts[start:]


class Pages:
    """Texts of a slice in one buffer; ``starts`` and ``ends`` bound each text in it."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        held = [text or b"" for text in texts]
        joined = b"\n".join([*held, b""]) if held else b""
        self.buffer = np.frombuffer(lowered(joined) if lower else joined, np.uint8)
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.count = len(held)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word, in order."""
        space = _IS_SPACE[self.buffer]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        return starts, ends, np.searchsorted(self.ends, starts, side="left")

    def prefix_sums(self) -> PrefixHash:
        return PrefixHash(self.buffer)


class PrefixHash:
    """A hash of any span of a buffer in constant time: sums of byte times a power of an odd base, mod 2^64."""

    def __init__(self, buffer: np.ndarray):
        """A table of random values per byte keeps close bytes from giving close hashes; 64-bit values are taken as they are."""
        n = len(buffer)
        values = _BYTE_VALUES[buffer] if buffer.dtype == np.uint8 else buffer
        self.powers, self.inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * self.powers[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; those for an ordinary slice are kept between calls."""
    held = _KEPT.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << n.bit_length(), base, U64)
        held[:1] = 1
        held = np.cumprod(held, dtype=U64)
        if n <= 2 * SLICE_BYTES:
            _KEPT[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def word_grams(hashes: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows that stay in one text, and the place of the first word of each."""
    if len(hashes) < n:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(text_of[n - 1 :] == text_of[: len(text_of) - n + 1])
    out = np.zeros(len(at), U64)
    for k in range(n):
        out = out * U64(_BASE) + hashes[at + k]
    return mixed(out), at


def sha256_hex(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()
