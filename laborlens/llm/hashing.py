"""Words of whole Arrow columns as 64-bit hashes, by array operations on their bytes.

A word's hash is a polynomial of its bytes modulo 2**64 (prefix sums give it for all words at once), mixed; A-Z count as a-z where asked. Its
three lowest bits are a class of its last two bytes. Every text ends in END.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import SPACE

_BASE = 0x9E3779B97F4A7C15
#: bytes that are hashed at once
PIECE = 1 << 19
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_LOWERED = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower()) for b in range(256)], dtype=np.uint64)
_GAP = np.array([b in SPACE.encode() for b in range(256)])
_powers = np.ones((2, 0), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


END = np.uint64(mix(np.array([77], dtype=np.uint64))[0])


def _table(n: int) -> np.ndarray:
    """Powers of the base and of its inverse, n of each at least."""
    global _powers
    if _powers.shape[1] < n:
        rows = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(max(n, PIECE), base, dtype=np.uint64)
            row[0] = 1
            rows.append(np.multiply.accumulate(row))
        _powers = np.stack(rows)
    return _powers


def _words(data: np.ndarray, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in data; no word goes over a cut."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    full = ~_GAP[data]
    new = np.concatenate([[True], ~full[:-1]])
    new[cuts[cuts < n]] = True
    last = np.concatenate([~full[1:], [True]])
    inner = cuts[(cuts > 0) & (cuts < n)]
    last[inner - 1] = True
    starts, ends = np.flatnonzero(full & new), np.flatnonzero(full & last) + 1
    values, (up, down) = table[data], _table(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    ending = mix(values[ends - 1] + np.uint64(3) * values[np.maximum(ends - 2, starts)]) >> np.uint64(61)
    return starts, (hashes & ~np.uint64(7)) | ending


def _long(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_words of one text of any length: pieces that end at white space."""
    at, out, none = 0, [], np.zeros(0, dtype=np.int64)
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _GAP[data[end]]:
            ahead = np.flatnonzero(_GAP[data[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(end + PIECE, len(data))
        starts, hashes = _words(data[at:end], none, table)
        out.append((starts + at, hashes))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _words(data, none, table)


def hashed(texts: pa.Array, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, their rows counted from it) of neighbouring rows of a text column; null counts as empty. Memory is that of
    `PIECE` bytes or of the longest text."""
    col = pc.fill_null(texts.cast(pa.binary()), b"")
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PIECE, side="right")) - 1)
        own, cuts = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        table = _LOWERED if lower else _VALUE
        starts, words = _words(own, cuts, table) if len(own) <= PIECE else _long(own, table)
        rows = np.searchsorted(cuts[1:], starts, side="right")
        times = np.bincount(rows, minlength=high - low)
        out = np.full(len(words) + high - low, END, dtype=np.uint64)
        out[np.arange(len(words)) + rows] = words
        yield low, out, np.repeat(np.arange(high - low), times + 1)
        low = high


def before(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; END stands before a text."""
    one, two = np.full(len(hashes), END), np.full(len(hashes), END)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    two[np.flatnonzero(np.diff(rows, prepend=-1))] = END
    return one, two
