"""Vectorised text helpers for Arrow batches: words and their hashes for many documents at once.

Every function works on one flat byte buffer holding the UTF-8 of several texts, so that a
task spends its time in a few numpy passes, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
R = 0x9E3779B97F4A7C15 | 1
R_INV = pow(R, -1, 1 << 64)
#: Bytes of text that are worked on at once; a longer single document is worked on alone.
CHUNK_BYTES = 4 << 20

_pw = _ipw = np.ones(1, np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words [^\x20\x09-\x0D]+ (bytes of a non-ASCII character are all >= 0x80).
NOT_WHITE = ~WHITE
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i <= n."""
    global _pw, _ipw
    if len(_pw) <= n:
        n = max(n, 1 << 16)
        _pw, _ipw = np.full(n + 1, R, np.uint64), np.full(n + 1, R_INV, np.uint64)
        _pw[0] = _ipw[0] = 1
        np.cumprod(_pw, out=_pw)
        np.cumprod(_ipw, out=_ipw)
    return _pw, _ipw


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, by which all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (data[j]+1) * R**j over j < i."""
    pw, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], independent of where the span stands (not yet mixed)."""
    _, ipw = powers(len(prefix) - 1)
    return (prefix[end] - prefix[start]) * ipw[start]


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place, as one number; zeros after the end."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _first(size: np.ndarray) -> np.ndarray:
    """Masks of the first bytes of eight."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))


def short_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that are mostly short: eight bytes at a time, so that the work goes with the number of spans."""
    size, eight = end - start, eights(data)
    out = size.astype(np.uint64)
    at, own, rest = start, slice(None), size
    while len(at):
        out[own] = mix(out[own] * np.uint64(R) + (eight[at] & _first(rest)))
        more = np.flatnonzero(rest > 8)
        own = more if isinstance(own, slice) else own[more]
        at, rest = at[more] + 8, rest[more] - 8
    return out


def alike(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct span, and of every span which one it is: by its hash, verified byte by byte."""
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    size, eight, first = end - start, eights(data), at[inverse]
    other = (size != size[first]) | ((eight[start] ^ eight[start[first]]) & _first(size) != 0)
    long = np.flatnonzero(~other & (size > 8))
    n = size[long]
    step = np.cumsum(n) - n
    within = np.arange(n.sum()) - np.repeat(step, n)
    differs = np.flatnonzero(data[np.repeat(start[long], n) + within] != data[np.repeat(start[first[long]], n) + within])
    other[long[np.searchsorted(step, differs, "right") - 1]] = True
    apart = np.flatnonzero(other)  # collisions: spans of their own
    inverse[apart] = len(at) + np.arange(len(apart))
    return np.append(at, apart), inverse


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    column = column.cast(pa.large_string()).fill_null("")
    if column.offset:
        column = pa.concat_arrays([column, pa.array([], pa.large_string())])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text (or of one row)."""
    col = batch.column(batch.schema.get_field_index(name))
    if not len(col):
        return
    wide = np.dtype(np.int32 if pa.types.is_string(col.type) else np.int64)
    offsets = np.frombuffer(col.buffers()[1], wide, len(col) + 1, col.offset * wide.itemsize).astype(np.int64)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that the table marks, and the row of each; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = table[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    edge[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(edge), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n consecutive words of a row, and their rows, in order.

    A row of 1 to n-1 words has one shingle, of all its words; a row without words has none.
    """
    counts = np.bincount(row, minlength=n_rows)
    total = np.zeros(len(hashes), np.uint64)
    for k in range(min(n, len(hashes))):
        total[: len(hashes) - k] += hashes[k:] * np.uint64(pow(R, k + 1, 1 << 64))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    short = np.flatnonzero((counts > 0) & (counts < n))
    keep = np.zeros(len(hashes), bool)
    if len(hashes) >= n:
        keep[: len(hashes) - n + 1] = row[: len(hashes) - n + 1] == row[n - 1 :]
    for r in short:  # a handful of words each
        h = hashes[first[r] : first[r] + counts[r]]
        total[first[r]] = sum(int(x) * pow(R, k + 1, 1 << 64) for k, x in enumerate(h)) % (1 << 64) ^ int(counts[r])
        keep[first[r]] = True
    at = np.flatnonzero(keep)
    return mix(total[at]), row[at]


def word_shingles(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text and their rows; words are white-space separated, A-Z lower-cased."""
    data, offsets = flat(column)
    start, end, row = words(data, offsets, NOT_WHITE)
    h = mix(span_hashes(prefix_hashes(LOWER[data]), start, end) + (end - start).astype(np.uint64))
    return shingles(h, row, len(column), n)


def list_array(values: np.ndarray, row: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from values sorted by row."""
    ends = np.searchsorted(row, np.arange(n_rows + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
