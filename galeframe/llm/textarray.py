"""Words of many texts at once, as numpy arrays over an Arrow string column's own bytes.

A word is a longest run of ASCII letters and digits and of bytes above 127 (so letters of other
scripts and unspaced punctuation outside ASCII count as word characters). ASCII and Latin-1 capitals are
folded; other letters are compared as they are. Null is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2**64, and those of its inverse."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        with np.errstate(over="ignore"):
            out = []
            for x in (_BASE, _INVERSE):
                a = np.full(size, x, dtype=np.uint64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        if len(_powers) > 3:
            _powers.clear()
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most limit bytes of text each, or a single row."""
    _, offsets = bytes_of(batch.column(batch.schema.get_field_index(text)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """hash, start and end (byte offsets in raw) of each word; doc i has words first[i]:first[i + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    offsets: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of k words within one text."""
        return grams(self.hash, self.first, k)


def fold(raw: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capitals made small."""
    out = _FOLD[raw]
    if len(raw) > 1:
        lead = raw[:-1] == 0xC3
        if lead.any():
            at = np.flatnonzero(lead) + 1
            b = raw[at]
            at = at[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
            out[at] = raw[at] + 32
    return out


def words(column: pa.Array) -> Words:
    """The words of each text of the column."""
    raw, offsets = bytes_of(column)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64), raw, offsets)
    inside = _IS_WORD[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[fold(raw)] * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
    return Words(h, start, end, np.searchsorted(start, offsets), raw, offsets)


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first item and hash of every run of k items that stays between two firsts."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * up[:n], out=total[1:])
        ok = np.ones(n - k + 1, dtype=bool)
        bounds = first[1:-1]
        if k > 1 and len(bounds):
            change = np.zeros(n + 2, dtype=np.int32)
            np.add.at(change, np.maximum(bounds - k + 1, 0), 1)
            np.add.at(change, np.minimum(bounds, n + 1), -1)
            ok = np.cumsum(change)[: n - k + 1] == 0
        at = np.flatnonzero(ok)
        return at, mix((total[at + k] - total[at]) * down[at])


def word_grams(text: str | None, k: int) -> np.ndarray:
    """Hashes of a single text's runs of k words, in order."""
    return words(pa.array([text], pa.string())).grams(k)[1]
