"""Texts as UTF-8 bytes: numpy kernels that the operators of this subpackage share.

Arrow hands a batch of texts over as one byte buffer with offsets.  All kernels work on such a buffer at
once, so the cost is a few nanoseconds a byte and no Python object is made for a word.  `pieces` cuts a
batch into runs of whole texts of about `PIECE` bytes, which bounds the memory of a kernel by the longest
single text.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

_ODD = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def word_table() -> np.ndarray:
    """True for the bytes that separate words: space and \\x09 to \\x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def lower_table() -> np.ndarray:
    """Bytes with A-Z in lower case."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte, so that hashes do not depend on small integers."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and their n+1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(offs: np.ndarray, most: int = PIECE):
    """Ranges (a, b) of whole texts, of about `most` bytes together or one text."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def spans(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a byte of `sep`; per text, the index of its first run (n+1 values)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~sep[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    a, b = offs[:-1][full], offs[1:][full] - 1
    first[a], last[b] = inside[a], inside[b]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, PIECE + 4096)
        for name, r in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            p = np.full(m, r, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64; `hash_of` takes any substring's hash from them."""
    up, _ = _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[: len(buf)], out=out[1:])
    return out


def hash_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal bytes wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i+1]], zero for an empty run."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """The public XXH64 hash of buf[start:start+len] for many strings, one length at a time."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    w8 = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    w4 = np.ndarray(len(buf) + 1, "<u4", padded, strides=(1,))
    s0 = np.uint64(seed)
    order = np.argsort(lens.astype(np.uint16) if lens.max() < 65536 else lens, kind="stable")
    sizes, at = np.unique(lens[order], return_index=True)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes.tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
            idx = order[a:b]
            s, p = starts[idx], 0
            if size >= 32:
                v = [np.full(len(s), x, np.uint64) for x in (s0 + _P1 + _P2, s0 + _P2, s0, s0 - _P1)]
                while p + 32 <= size:
                    for k in range(4):
                        v[k] = _rot(v[k] + w8[s + (p + 8 * k)] * _P2, 31) * _P1
                    p += 32
                h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
                for x in v:
                    h = (h ^ (_rot(x * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(s), s0 + _P5, np.uint64)
            h = h + np.uint64(size)
            while p + 8 <= size:
                h = _rot(h ^ (_rot(w8[s + p] * _P2, 31) * _P1), 27) * _P1 + _P4
                p += 8
            if p + 4 <= size:
                h = _rot(h ^ (w4[s + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                p += 4
            while p < size:
                h = _rot(h ^ (buf[s + p].astype(np.uint64) * _P5), 11) * _P1
                p += 1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            out[idx] = h ^ (h >> np.uint64(32))
    return out
