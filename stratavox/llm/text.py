"""Vectorised word kernels over Arrow string arrays.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D. Texts are handled in UTF-8; slices of about a
megabyte (at least one whole text) bound the memory whatever the batch size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def string_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, int64 offsets) of a string array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def slices(arr: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole texts of about `limit` bytes."""
    raw, offs = string_buffers(arr)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of maximal runs of True within texts, and each text's first run (one more entry than texts)."""
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    at = edges[edges < len(inside)]
    first[at] = inside[at]
    at = edges[edges > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


#: Spans of more bytes are handled one by one.
LONG = 128


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one little-endian number, zeros after the end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))


def _head(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n (1 or more) of a word's eight bytes."""
    return word & (~np.uint64(0) >> (np.uint64(64) - np.minimum(n, 8).astype(np.uint64) * np.uint64(8)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans hash alike wherever they stand.

    Eight bytes at a time go through a full mixing step, so no algebra of the bytes carries over; long spans take
    BLAKE2.
    """
    word, n = loads(data), ends - starts
    h = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    at = np.flatnonzero((n > 0) & (n <= LONG))
    for done in range(0, LONG, 8):
        at = at[n[at] > done] if done else at
        if not len(at):
            break
        h[at] = mix(h[at] ^ _head(word[starts[at] + done], n[at] - done))
    return h


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes of a from a_starts on equal those of b from b_starts on."""
    out = np.ones(len(n), bool)
    for k in np.flatnonzero(n > LONG).tolist():
        out[k] = np.array_equal(a[a_starts[k] : a_starts[k] + n[k]], b[b_starts[k] : b_starts[k] + n[k]])
    at, x, y = np.flatnonzero((n > 0) & (n <= LONG)), loads(a), loads(b)
    for done in range(0, LONG, 8):
        at = at[n[at] > done] if done else at
        if not len(at):
            break
        differ = _head(x[a_starts[at] + done] ^ y[b_starts[at] + done], n[at] - done)
        out[at[differ != 0]] = False
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of the words and each text's first word."""
    return runs(~_SPACE[data], offs)


_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows at every position of h (fewer than len(h) by k - 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, p = h[:n].copy(), 1
    for j in range(1, k):
        p = (p * int(_Q)) & (2**64 - 1)
        out += h[j : n + j] * np.uint64(p)
    return mix(out + np.uint64(k))


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; with fewer words the whole sequence as one; none without words."""
    w = windows(h, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            s = np.sort(w[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(windows(h[a:b], b - a))
        else:
            out.append(h[:0])
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by their first `keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        change[0] = last is not None and first != last
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if not change[0] else [*np.flatnonzero(change).tolist(), batch.num_rows]
        if change[0] and held:
            yield pa.Table.from_batches(held)
            held = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(x, y - x))
            if y < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows (at least one key's) that hold all rows of their keys, from batches sorted likewise."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(keys)]
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
            other = np.flatnonzero(np.logical_or.reduce([c != v for c, v in zip(cols, last)]))
            if len(other):
                cut = int(other[0])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
