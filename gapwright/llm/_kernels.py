"""NumPy kernels over Arrow string columns: tokens, hashes and bit votes for whole batches of texts at once.

Memory is bounded by CHUNK bytes of text (or one text, if that is longer) at a time, at some 60 bytes a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21

_U = np.uint64
P1, P2, P3, P4, P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def table_of(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


SPACES = table_of(b" \t\n\x0b\x0c\r")
NEWLINE = table_of(b"\n")
#: ASCII upper case to lower case; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs without separators inside rows, and each row's first run (len(offsets) pointers)."""
    word = ~separators[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    before[edge] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:], after[:-1] = False, word[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def single_spaced(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of each row joined by one blank: bytes, starts, ends and row pointers."""
    starts, ends, rows = spans(data, offsets, separators)
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    size = int(at[-1] + lengths[-1]) if len(at) else 0
    out = np.full(size + 40, 32, np.uint8)
    keep = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    out[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = data[keep]
    return out, at, at + lengths, rows


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans; data must go on for 8 bytes or more after the last."""
    with np.errstate(over="ignore"):
        n, data = len(starts), np.ascontiguousarray(data)
        wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        half = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
        seed_ = _U(seed)
        h, at = np.full(n, seed_ + P5, _U), starts.copy()
        if len(big := np.flatnonzero(lengths >= 32)):
            v = [np.full(len(big), x, _U) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            left, pos, live = lengths[big] // 32, starts[big].copy(), np.arange(len(big))
            while len(live):
                for k in range(4):
                    v[k][live] = _rot(v[k][live] + wide[pos[live] + 8 * k] * P2, 31) * P1
                pos[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            x = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for k in range(4):
                x = (x ^ (_rot(v[k] * P2, 31) * P1)) * P1 + P4
            h[big], at[big] = x, pos
        h += lengths.astype(_U)
        rest = lengths & 31
        for k in range(3):
            if not len(i := np.flatnonzero(rest >= 8 * (k + 1))):
                break
            h[i] = _rot(h[i] ^ (_rot(wide[at[i]] * P2, 31) * P1), 27) * P1 + P4
            at[i] += 8
        if len(i := np.flatnonzero(rest & 4)):
            h[i] = _rot(h[i] ^ (half[at[i]].astype(_U) * P1), 23) * P2 + P3
            at[i] += 4
        for k in range(3):
            if not len(i := np.flatnonzero((rest & 3) > k)):
                break
            h[i] = _rot(h[i] ^ (data[at[i]].astype(_U) * P5), 11) * P1
            at[i] += 1
        h = (h ^ (h >> _U(33))) * P2
        h = (h ^ (h >> _U(29))) * P3
        return h ^ (h >> _U(32))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def segment_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of values[rows[i]:rows[i + 1]]; 0 for empty ranges."""
    out = np.zeros(len(rows) - 1, values.dtype)
    full = np.flatnonzero(rows[1:] > rows[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, rows[:-1][full])
    return out


def majority_bits(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row: the bits set in over half of its hashes; 0 if it has none. Two 32-bit counters share a word."""
    total = (rows[1:] - rows[:-1]).astype(_U)
    out, low, pair = np.zeros(len(total), _U), _U(0xFFFFFFFF), _U(0x0000000100000001)
    for j in range(32):
        votes = segment_sums((hashes >> _U(j)) & pair, rows)
        out |= ((votes & low) * _U(2) > total).astype(_U) << _U(j)
        out |= ((votes >> _U(32)) * _U(2) > total).astype(_U) << _U(j + 32)
    return out


def shingle_ranges(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each row's k-word shingles, and row pointers; a row of fewer words has one shingle of all."""
    words = rows[1:] - rows[:-1]
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    ptr = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(rows[:-1] - ptr[:-1], count) + np.arange(ptr[-1])
    last = np.minimum(first + k, np.repeat(rows[1:], count)) - 1
    return first, last, ptr


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) modulo 2^64; those of usual chunks are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(max(n, CHUNK + 2) - 1, _U(base))]))
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of many byte spans from one running sum of byte values times powers; some 10 ns a byte."""
    with np.errstate(over="ignore"):
        up = _powers_of(_BASE, len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
        down = _powers_of(_INVERSE, len(data) + 1)
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))
