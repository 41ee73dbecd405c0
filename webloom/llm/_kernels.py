"""Vectorised text kernels over Arrow string buffers, shared by the operators of this subpackage.

A batch of texts is held as one UTF-8 byte buffer with document offsets, as Arrow stores it; words, hashes and
windows are computed for the whole batch with numpy, never text by text.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one vectorised step holds; a single longer text is a step of its own. Arrays of a step have 8 bytes for each.
STEP_BYTES = 1 << 18

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * U64(2) + U64(1)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        inverse = pow(base, -1, 2**64)
        up, down = np.full(size, U64(base)), np.full(size, U64(inverse))
        up[0] = down[0] = U64(1)
        have = _POWERS[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES):
    """Ranges of documents of at most `limit` bytes each (or one longer document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and n + 1 offsets of the documents' words."""
    inside = ~SEPARATOR[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data), which)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[which][data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9FB21C651E98DF25))


def window_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `length` values, whatever document they are of."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(values), which)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n] + U64(length))


def window_fits(word_offsets: np.ndarray, length: int) -> np.ndarray:
    """For every run of `length` words of the batch: whether it lies in one document."""
    n = int(word_offsets[-1]) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    change = np.zeros(n + 1, np.int32)
    counts = np.diff(word_offsets)
    ok = counts >= length
    np.add.at(change, word_offsets[:-1][ok], 1)
    np.add.at(change, word_offsets[1:][ok] - length + 1, -1)
    return np.cumsum(change[:n]) > 0


def covered(marked: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a marked window of `length` words; marked is by window start."""
    change = np.zeros(n + 1, np.int32)
    starts = np.flatnonzero(marked)
    change[starts] += 1
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0


def occurrence_labels(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each value came before in its own document."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    key = mix(values + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    begin = np.flatnonzero(new)
    labels = np.empty(n, np.int64)
    labels[order] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    return labels


def batch_rows(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def release() -> None:
    """Gives memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run):
    """A function over batches that gives memory back to the system at its end: Python workers live on, idle, in later stages."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


# crc32 of a whole from the crc32 of its parts: crc(AB) = shift(crc(A), bytes of B) ^ crc(B) over GF(2).
_SHIFTS: list[np.ndarray] = []


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _shift_tables(bits: int) -> list[np.ndarray]:
    while len(_SHIFTS) < bits:
        if not _SHIFTS:
            one = np.array([0xEDB88320] + [1 << i for i in range(31)], dtype=np.uint32)
            for _ in range(3):  # one zero bit, two, four, then a byte
                one = _apply(one, one)
            _SHIFTS.append(one)
        else:
            _SHIFTS.append(_apply(_SHIFTS[-1], _SHIFTS[-1]))
    return _SHIFTS


@functools.cache
def _shift_bytes(bit: int) -> np.ndarray:
    """What each byte of a crc32 becomes after 2 ** bit more zero bytes: 4 tables of 256."""
    matrix = _shift_tables(bit + 1)[bit]
    return np.stack([_apply(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The crc32 values after `n_bytes` more zero bytes (no initial or final inversion)."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for bit in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> bit) & 1)
        if len(at):
            x, t = out[at], _shift_bytes(bit)
            out[at] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out
