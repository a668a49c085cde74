"""Word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


# XXH3 of up to 16 bytes, seed 0, as its specification says; the constants are xors of its default secret
_F3, _F8, _F16 = np.uint64(0x87275A9B), np.uint64(0xC73AB174C5ECD5A2), (np.uint64(0x6782737BEA4239B9), np.uint64(0xAF56BC3B0996523A))
_X3, _X8, _X16 = np.uint64(0x165667B19E3779F9), np.uint64(0x9FB21C651E98DF25), np.uint64(0x165667919E3779F9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

#: Words that are hashed together, so that what is between stays in the processor's cache.
STEP = 1 << 15


def _u(n: int) -> np.uint64:
    return np.uint64(n)


def _to_3(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of words of 1 to 3 bytes ``v``, the first one lowest, of which there are ``n``."""
    h = ((v & _u(255)) << _u(16)) | (((v >> ((n >> _u(1)) << _u(3))) & _u(255)) << _u(24)) | (v >> ((n - _u(1)) << _u(3))) | (n << _u(8))
    h ^= _F3
    h ^= h >> _u(33)
    h *= _u(0xC2B2AE3D27D4EB4F)
    h ^= h >> _u(29)
    h *= _X3
    h ^= h >> _u(32)
    return h


def _to_8(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As :func:`_to_3`, of 4 to 8 bytes."""
    h = (v >> ((n - _u(4)) << _u(3))) + (v << _u(32))
    h ^= _F8
    h ^= (h << _u(49) | h >> _u(15)) ^ (h << _u(24) | h >> _u(40))
    h *= _X8
    h ^= (h >> _u(35)) + n
    h *= _X8
    h ^= h >> _u(28)
    return h


def _to_16(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """As :func:`_to_3`, of 9 to 16 bytes: the first 8 and the last 8."""
    v, w = v ^ _F16[0], w ^ _F16[1]
    low = _u(0xFFFFFFFF)
    mid = (v >> _u(32)) * (w & low) + ((v & low) * (w & low) >> _u(32))
    high = (v >> _u(32)) * (w >> _u(32)) + (mid >> _u(32)) + ((v & low) * (w >> _u(32)) + (mid & low) >> _u(32))
    h = n + v.byteswap() + w + (v * w ^ high)
    h ^= h >> _u(37)
    h *= _X16
    h ^= h >> _u(32)
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (XXH3 of 64 bits) of all words of all texts in a row, and the number of words of each; A-Z are lower-cased.

    Words are runs of anything but ASCII white space. The texts must not be null.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, places, held = texts.buffers()
    bounds = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    data = np.zeros(size // 8 * 8 + 24, np.uint8)
    np.take(_LOWER, raw, out=data[:size], mode="clip")
    inside = (raw != 32) & (raw - np.uint8(9) > 4)
    edge = np.empty(size + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    seams = np.unique(bounds[(bounds > 0) & (bounds < size)])
    seams = seams[inside[seams] & inside[seams - 1]]  # where a word ends with its text and another begins
    at = np.insert(at, np.repeat(np.searchsorted(at, seams), 2), np.repeat(seams, 2))
    starts, ends = at[::2].copy(), at[1::2].copy()
    counts = np.diff(np.searchsorted(starts, bounds))
    cells, view = data.view("<u8"), memoryview(data)

    def read(at: np.ndarray) -> np.ndarray:
        cell, shift = at >> 3, (at.view(np.uint64) & _u(7)) << _u(3)
        return cells[cell] >> shift | np.where(shift > 0, cells[cell + 1] << (_u(64) - shift & _u(63)), _u(0))

    out = np.empty(len(starts), np.uint64)
    for x in range(0, len(starts), STEP):
        first, last, own = starts[x : x + STEP], ends[x : x + STEP], out[x : x + STEP]
        n = last - first
        long = n.view(np.uint64)
        v = read(first) & _BYTES[np.minimum(n, 8)]
        own[:] = _to_8(v, np.maximum(long, _u(4)))
        some = np.flatnonzero(n < 4)
        own[some] = _to_3(v[some], long[some])
        some = np.flatnonzero(n > 8)
        own[some] = _to_16(read(first[some]), read(last[some] - 8), long[some])
        for i in np.flatnonzero(n > 16).tolist():
            own[i] = xxhash.xxh3_64_intdigest(view[first[i] : last[i]])
    return out, counts


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; the words of one text."""
    out = np.full(max(0, len(hashes) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * _M
        out ^= out >> _S
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted; a text of fewer words is one shingle, one without words has none."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    all_ = combined(hashes, n)
    for end, count in zip(ends.tolist(), counts.tolist(), strict=True):
        own = all_[end - count : end - n + 1] if count >= n else combined(hashes[end - count : end], count) if count else all_[:0]
        own = np.sort(own)
        yield own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)
