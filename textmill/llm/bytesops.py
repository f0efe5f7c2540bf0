"""Vectorised byte, word and hash helpers shared by the text operators.

Arrow string buffers are viewed as one byte array with document offsets, so
hashing, word splitting and window minima run as numpy passes and never as
Python loops over words. ``chunks`` bounds the working set: whole documents are
grouped until ``limit`` bytes, and a longer document forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
CHUNK_BYTES = 500_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) over a whole array."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x += U64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(256, dtype=U64), 7)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 64), U64(base), dtype=U64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with len(data) + 1 entries; ``span_hash`` turns differences of H into hashes."""
    h = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=h[1:])
    return h


def prefix_hash_of(values: np.ndarray) -> np.ndarray:
    """As ``prefix_hash``, over 64-bit values instead of bytes."""
    h = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * _power(_BASE, len(values)), out=h[1:])
    return h


def inverse_powers(n: int) -> np.ndarray:
    """Factors that make differences of a prefix hash independent of where they begin."""
    return _power(_INVERSE, n)


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A position-independent 64-bit hash of each byte span [start, end)."""
    inverse = _power(_INVERSE, len(h))
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(U64))


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets) with about ``limit`` bytes each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: The bytes that separate words (space, and tab to carriage return).
SPACES = separators(b" \t\n\x0b\x0c\r")


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run without separator bytes; runs end with their document."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~table[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` entries (len(x) - w + 1 of them), by doubling."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true entries."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position in the row) for every cell of rows with these lengths."""
    lengths = np.asarray(lengths, dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each row, whether data[a : a + size] equals data[b : b + size]."""
    out = np.ones(len(a), dtype=bool)
    first = 0
    total = np.cumsum(size)
    while first < len(a):  # rows of about a million bytes at a time, one row at least
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + 1_000_000, side="right")))
        row, k = ragged(size[first:last])
        bad = data[a[first:last][row] + k] != data[b[first:last][row] + k]
        out[first:last] = np.bincount(row, weights=bad, minlength=last - first) == 0
        first = last
    return out
