"""Vectorised word hashing over Arrow string columns.

A *word* is a maximal run of ASCII letters, digits, ``_`` and non-ASCII
characters of the lower-cased text; everything else separates.  Words are
hashed to 64 bits straight from the Arrow buffers with numpy, so no Python
string object exists per word or per document.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))

_WORD = np.zeros(256, dtype=np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum() or chr(_c) == "_":
        _WORD[_c] = _c

_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=np.uint64)
    return _pow[0][:n], _pow[1][:n]


def _buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of len+1, bytes) of a string array, nulls as empty texts."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words(col: pa.Array | pa.ChunkedArray, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, hashes uint64, offsets per row, word lengths in bytes) by chunks of whole rows.

    A chunk holds about ``chunk_bytes`` of text, or one row that is longer.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return
    off, data = _buffers(pc.utf8_lower(col))
    row = 0
    while row < len(col):
        end = int(np.searchsorted(off, off[row] + chunk_bytes, "right")) - 1
        end = min(max(end, row + 1), len(col))
        yield (row, *_hash(data[off[row] : off[end]], off[row : end + 1] - off[row]))
        row = end


def _hash(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64)
    code = _WORD[raw]
    is_word = code > 0
    begins = np.empty(n + 1, bool)
    begins[1:n] = is_word[1:] & ~is_word[:-1]
    begins[0] = is_word[0]
    begins[n] = False
    cut = off[(off > 0) & (off < n)]
    begins[cut] |= is_word[cut]
    ends = np.empty(n + 1, bool)  # position just past a word
    ends[0] = False
    ends[1:n] = is_word[:-1] & ~is_word[1:]
    ends[n] = is_word[n - 1]
    ends[cut] |= is_word[cut - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends)
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(code.astype(np.uint64) * up[:n], dtype=np.uint64, out=total[1:])
    h = mix64((total[e] - total[s]) * down[s])
    return h, np.searchsorted(s, off), e - s


def shingles(h: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the q-word shingles of each row, with their offsets per row.

    A row of 1 to q-1 words has one shingle of all its words; a row without words has none.
    """
    n = np.diff(off)
    full = np.maximum(n - q + 1, 0)
    m = max(len(h) - q + 1, 0)
    acc = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(q):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
        inside = np.zeros(len(h), bool)
        rows = np.repeat(np.arange(len(n)), n)
        pos = np.arange(len(h)) - np.repeat(off[:-1], n)
        inside[:] = pos < full[rows]
        short = np.flatnonzero((n > 0) & (n < q))
        vals = mix64(acc[inside[:m]]) if m else np.zeros(0, np.uint64)
        if not len(short):
            return vals, np.concatenate([[0], np.cumsum(full)])
        extra = np.array([_fold(h[off[r] : off[r + 1]]) for r in short], np.uint64)
        cnt = full.copy()
        cnt[short] = 1
        out_off = np.concatenate([[0], np.cumsum(cnt)])
        out = np.empty(int(out_off[-1]), np.uint64)
        place = np.ones(len(out), bool)
        place[out_off[short]] = False
        out[place] = vals
        out[out_off[short]] = extra
        return out, out_off


def _fold(h: np.ndarray) -> np.uint64:
    acc = 0
    for x in h:
        acc = (acc * 0xD6E8FEB86659FD93 + int(x)) & 0xFFFFFFFFFFFFFFFF
    return mix64(np.array([acc ^ len(h)], np.uint64))[0]


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over rows off[i]:off[i+1] along axis 0; 0 for empty ones."""
    out = np.zeros((len(off) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, off[full], axis=0)
    return out


_SPREAD = np.zeros(256, np.uint64)  # bit i of the index in byte lane i
for _i in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_i)) & np.uint64(1)) << np.uint64(8 * _i)


def bit_votes(h: np.ndarray, off: np.ndarray, n_bits: int, weight: np.ndarray | None = None, max_weight: int = 1) -> np.ndarray:
    """Per row and bit, the summed weight of set bits minus that of clear bits (int64, rows x n_bits).

    Eight bits are counted at a time in the byte lanes of one integer; rows are
    cut into runs short enough that no lane overflows.
    """
    n = np.diff(off)
    run = 255 // max_weight
    parts = -(-n // run)
    first = np.concatenate([[0], np.cumsum(parts)])
    cut = np.repeat(off[:-1], parts) + run * (np.arange(first[-1]) - np.repeat(first[:-1], parts))
    out = np.zeros((len(n), n_bits), np.int64)
    if not len(cut):
        return out
    for b in range(-(-n_bits // 8)):
        if b % 8 == 0:
            hashed = mix64(h + np.uint64(0x51ED270B * (b // 8 + 1))).view(np.uint8).reshape(-1, 8)
        lanes = _SPREAD[hashed[:, b % 8]]
        if weight is not None:
            lanes = lanes * weight
        sums = np.add.reduceat(lanes, cut).view(np.uint8).reshape(-1, 8)
        k = min(8, n_bits - 8 * b)
        out[:, 8 * b : 8 * b + k] = segment_sum(sums.astype(np.int64), first)[:, :k]
    total = segment_sum(weight.astype(np.int64), off) if weight is not None else n
    return 2 * out - total[:, None]
