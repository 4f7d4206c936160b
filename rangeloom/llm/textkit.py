"""Whole-batch word scanning and hashing with numpy, shared by the text operators.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]`` in the UTF-8 bytes. A hash of a byte run is the difference of two
prefix sums of ``T[byte] * P**position`` (mod 2**64), divided by ``P**start`` and mixed, so one pass over the bytes
gives the hash of any run. Equal runs always have equal hashes; different runs of equal hash are a 2**-64 event.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators where punctuation doesn't belong to words: ASCII but for letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


def _lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[0x41:0x5B] = table[0x61:0x7B]
    return out


_P = 0xD6E8FEB86659FD93
_P_INV = pow(_P, -1, 1 << 64)
_TABLES = {seed: (_table(seed), _lowered(_table(seed))) for seed in (11, 29)}
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` mod 2**64; kept and doubled as longer ones are asked for."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


#: Runs that are hashed at a time: what a block needs beyond its result stays small and in the processor's cache.
BLOCK = 1 << 15


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs ``values[starts:ends]`` (unsigned 64-bit values, or places in ``table``); quickest where starts ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    for at in range(0, len(starts), BLOCK):
        a, b = starts[at : at + BLOCK], ends[at : at + BLOCK]
        lo, hi = int(a.min()), int(b.max())
        part = values[lo:hi] if table is None else table[values[lo:hi]]
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(part * powers(_P, hi - lo), out=total[1:])
        a, b = a - lo, b - lo
        h = total[b] - total[a]
        h *= powers(_P_INV, hi - lo + 1)[a]
        h += (b - a).astype(np.uint64) * U(0x9E3779B97F4A7C15)
        out[at : at + BLOCK] = mix(h)
    return out


class Texts:
    """The texts of one batch, as bytes and word arrays. ``w0[i]:w0[i+1]`` are the words of text ``i``."""

    def __init__(self, column: pa.Array, *, lower: bool = False, hashes: bool = True, separators: np.ndarray = SPACE):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        if column.null_count:
            column = column.fill_null("")
        n = self.n = len(column)
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        self.buf = raw[at[0] : at[-1]]
        self.at = at - at[0]
        self.lower = lower
        word = ~separators[self.buf]
        size = len(self.buf)
        edge = np.zeros(size + 1, dtype=bool)
        edge[self.at] = True
        start = word.copy()
        start[1:] &= ~word[:-1] | edge[1:size]
        self.start = np.flatnonzero(start)
        end = word.copy()
        if size:
            end[:-1] &= ~word[1:] | edge[1:size]
        self.end = np.flatnonzero(end) + 1
        self.in_word = word
        self.w0 = np.searchsorted(self.start, self.at)
        self.n_words = np.diff(self.w0)
        if hashes:
            self.hash = self.runs(self.start, self.end)

    def runs(self, starts: np.ndarray, ends: np.ndarray, seed: int = 11) -> np.ndarray:
        return run_hashes(self.buf, starts, ends, _TABLES[seed][self.lower])

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def windows(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, text, hash) of each run of ``k`` words that lies in one text."""
        counts = np.maximum(self.n_words - (k - 1), 0)
        first = ranges(self.w0[:-1], counts)
        doc = np.repeat(np.arange(self.n), counts)
        return first, doc, run_hashes(self.hash if hashes is None else hashes, first, first + k)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of per-byte flags by text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[i] .. starts[i]+counts[i]-1``."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives back to the system what the process' allocators hold unused: workers live on between tasks, and several of them share a machine's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text each (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        bin_of = (np.cumsum(sizes) - 1) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(bin_of)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    release()


def group_starts(ordered: np.ndarray) -> np.ndarray:
    """Where the groups of equal neighbours begin."""
    if not len(ordered):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
