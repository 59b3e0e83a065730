"""Whole-batch text arithmetic on Arrow string buffers with numpy.

Words are maximal runs of characters other than the six ASCII spaces
(0x20, 0x09-0x0D).  Those are single bytes in UTF-8 and never part of another
character, so words are found on the bytes.  Nothing here loops over rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 2**64))
_SEGMENT = 1 << 19
_CACHE: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _CACHE.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _CACHE[name] = have = np.multiply.accumulate(have)
    return have


def reuse_memory() -> None:
    """Let the C library keep freed blocks of up to 256 MB, so that temporary arrays of a loop do not fault in new pages each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 28)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD


def release() -> None:
    """Give freed memory back to the system."""
    _CACHE.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker, that goes on to other tasks, gives freed memory back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n+1 offsets of the rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about max_bytes of text; a longer row stands alone."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield lo, min(hi, n)
        lo = min(hi, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word_offsets): byte spans of all words; row i has words word_offsets[i]:word_offsets[i+1]."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    first = np.empty_like(solid)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = True
    first &= solid
    last = np.empty_like(solid)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    last[inner - 1] = True
    last &= solid
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (spans in order); equal bytes give equal hashes everywhere."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SEGMENT, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        n = hi - lo
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data[lo:hi]] * _powers("up", _BASE, n)[:n], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * _powers("down", _BASE_INV, n + 1)[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, at) of np.unique: the distinct hashes ascending, where each stands first, and which of them stands at each place.

    Sorts the upper bits of the hashes with their places in the lower bits, as plain values sort much faster than places do.
    Where two hashes agree in the upper bits alone, np.unique has it.
    """
    bits = U64(max(1, len(h)).bit_length())
    packed = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    values, upper = h[order], packed >> bits
    new = np.ones(len(h), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    if (new[1:] != (upper[1:] != upper[:-1])).any():
        values, first, at = np.unique(h, return_index=True, return_inverse=True)
        return values, first, at.astype(np.int64)
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return values[new], order[new], at


def hash_word(word: bytes) -> int:
    """The hash that span_hashes gives this word."""
    data = np.frombuffer(word, dtype=np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h, len(h)-n+1 of them (rows are not told apart)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : k + m]
    return mix(out)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_numbers(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
