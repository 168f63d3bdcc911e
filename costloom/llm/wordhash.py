"""Words, digests and rolling shingle hashes over raw UTF-8 bytes, used inside tasks.

`bytes.split()` cuts at exactly \\x20 and \\x09-\\x0D and `bytes.lower()` maps exactly A-Z, so words are the
matches of `[^\\x20\\x09-\\x0D]+` and no other character is touched.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class WordIds(dict):
    """Word -> 64-bit digest, computed once per distinct word; emptied at `limit` words (some 30 MB) to bound memory."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit digest per window of k words; fewer words are one window, no words none."""
    n = len(ids)
    if n == 0:
        return ids
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _MULT + ids[i : n - width + 1 + i]
    return mix(out)


def set_digest(values: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a sorted array, as two signed longs."""
    h = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def pieces(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `most` bytes in one string column: what a task holds beside its batch stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow string column as UTF-8 bytes (no decoding)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def _give_back() -> None:
    """Hands memory that is free but still held back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """A task's function over an iterator of batches that gives its memory back when it ends. Workers are reused and several wait
    idle beside the ones that run, so what one holds on to counts for as long as the executor lives."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return wrapped


class PlainIds(WordIds):
    """As `WordIds`, of words in lower case (A-Z) and without punctuation at their ends."""

    ENDS = b".,;:!?\"'()[]{}<>*#"

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word.lower().strip(self.ENDS))
        return out
