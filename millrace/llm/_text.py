"""Vectorised byte-level text helpers shared by the corpus operators.

Texts arrive in Arrow batches.  They are regrouped into blocks of half a MB of
UTF-8 bytes, so that memory per task is bounded by the block size plus one
document, whatever the batch size is.  A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: All but ASCII white space.
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, _MASK, n, dtype=np.uint64, endpoint=True) | np.uint64(1)


_LETTER = _random_words(256, 11)
_LETTER_LOWER = _LETTER[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of a polynomial base modulo 2**64, each the product of one of STEP low ones and one of the high ones: a longer text
    makes the table longer by one entry for STEP bytes."""

    STEP = 1 << 12

    def __init__(self, base: int) -> None:
        self.low = np.cumprod(np.r_[np.uint64(1), np.full(self.STEP - 1, base, np.uint64)])
        self._step = pow(base, self.STEP, 1 << 64)

    def _high(self, n: int) -> np.ndarray:
        return np.cumprod(np.r_[np.uint64(1), np.full(n // self.STEP, self._step, np.uint64)])

    def first(self, n: int) -> np.ndarray:
        """The powers 0 to n - 1."""
        return np.multiply.outer(self._high(n), self.low).ravel()[:n]

    def at(self, exponents: np.ndarray) -> np.ndarray:
        high = self._high(int(exponents.max(initial=0)))
        out = high[exponents >> 12]
        out *= self.low[exponents & (self.STEP - 1)]
        return out


UP, DOWN = Powers(_BASE), Powers(_INVERSE)


def release() -> None:
    """Give memory that has been freed back to the system.

    Workers live on from stage to stage; what their allocators hold would add to what the next stage needs.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


#: What operators keep in this process from task to task, by name, and how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def turn_to(name: str) -> None:
    """Let go of what other operators than the named one keep: a worker goes from one operator to the next."""
    for other, forget in KEPT.items():
        if other != name:
            forget()


def tidied(run: Callable, keeps: str = "") -> Callable:
    """run, a function of Arrow batches, with a release when it is done; keeps: its name in KEPT."""

    @functools.wraps(run)
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(keeps)
        try:
            yield from run(found)
        finally:
            release()

    return batches


@dataclass
class Block:
    """Consecutive documents: their bytes end to end and n + 1 offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of at most limit bytes (a longer document is a block of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """S with S[j] - S[i] = sum of letter(k) * base**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    letters = (_LETTER_LOWER if lower else _LETTER)[data]
    letters *= UP.first(len(data))
    np.cumsum(letters, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span: equal bytes give equal hashes, wherever they stand."""
    h = prefix[ends]
    h -= prefix[starts]
    h *= DOWN.at(starts)
    h += (ends - starts).astype(np.uint64)
    return mix(h)


def word_spans(block: Block, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes (inside; without it, all but white space) within documents, and n + 1 offsets
    of words by document."""
    if inside is None:
        inside = _NOT_SPACE[block.data]
    # A document's first byte can't continue a word of the document before it.
    edges = block.offsets[(block.offsets < len(inside))]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Document number of each item, from n + 1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First items of all windows of width items within a document, and each window's document."""
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    base = np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(len(doc)) + base, doc


def sort_by_document(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order that sorts by document, then by value; a block has far fewer than 2**32 documents."""
    order = np.argsort(values, kind="stable")
    small = doc[order].astype(np.uint16 if len(doc) == 0 or doc[-1] < 65536 else np.uint32)
    return order[np.argsort(small, kind="stable")]
