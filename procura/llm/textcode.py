"""Vectorised word and shingle hashes of many texts at once (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 20
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; short runs come from a kept table."""
    return _power_table(base)[:n] if n <= _SLICE else _powers(base, n)


@lru_cache(maxsize=4)
def _power_table(base: int) -> np.ndarray:
    return _powers(base, _SLICE)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts of about CHUNK_BYTES each, as (first, end, encoded texts)."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        code = b"" if text is None else text.encode("utf-8")
        held.append(code)
        total += len(code)
        if total >= CHUNK_BYTES:
            yield first, i + 1, held
            first, held, total = i + 1, [], 0
    if held:
        yield first, len(texts), held


def column_chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """The same of an Arrow column, encoding no more than one run at a time; nulls are empty."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    total, first = np.cumsum(sizes), 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + CHUNK_BYTES, side="right")))
        part = texts.slice(first, end - first).cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
        yield first, end, [code or b"" for code in part.to_pylist()]
        first = end


def word_hashes(encoded: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts in order, and where each text's words begin.

    The second array has one entry more than there are texts. With `lower`, A-Z count as a-z.
    """
    starts_at = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(code) + 1 for code in encoded], out=starts_at[1:])
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    blank = _BLANK[data]
    before = np.empty_like(blank)
    before[0] = True
    before[1:] = blank[:-1]
    start = np.flatnonzero(before & ~blank)
    end = np.flatnonzero(~before & blank)
    bounds = np.searchsorted(start, starts_at)
    out = np.empty(len(start), dtype=np.uint64)
    w = 0
    while w < len(start):
        stop = max(w + 1, int(np.searchsorted(end, start[w] + _SLICE, side="right")))
        at, size = start[w], int(end[stop - 1] - start[w])
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data[at : at + size]] * powers(_BASE, size), out=sums[1:])
        s, e = start[w:stop] - at, end[w:stop] - at
        h = (sums[e] - sums[s]) * powers(_BASE_INVERSE, size)[s]
        out[w:stop] = mix64(h + (e - s).astype(np.uint64))
        w = stop
    return out, bounds


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles of one text; a shorter text is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(_BASE) + words[k : k + n])
    return np.unique(h)
