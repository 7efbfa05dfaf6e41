"""Vectorised word kernels over Arrow string columns.

A *normalised word* is a maximal run of [0-9a-z] and non-ASCII characters of the lower-cased text; a *raw word* is a
maximal run of characters other than ASCII white space. Words never cross a document's end. A null text has no words.
Everything here works on whole texts, chunk by chunk, without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_POW_N = 4096
_P = 0x9E3779B97F4A7C15


def _powers(n: int, p: int) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_POW_N, _P | 1)
_NORM = np.zeros(256, dtype=bool)
_NORM[48:58] = _NORM[97:123] = True
_NORM[128:] = True
_RAW = np.ones(256, dtype=bool)
_RAW[[9, 10, 11, 12, 13, 32]] = False


class Words(NamedTuple):
    """Words of consecutive documents: hash, byte span relative to the chunk, and off[i]:off[i + 1] for document i."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    data: np.ndarray
    byte_off: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def relieve() -> None:
    """Gives memory that is free but held back to the system: workers live on from task to task, two to an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def eased(batches) -> Iterator[pa.RecordBatch]:
    """batches, with memory given back after each."""
    for b in batches:
        yield b
        del b
        relieve()


def gathered(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together until they hold limit bytes."""
    parts, size = [], 0
    for b in eased(batches):
        parts.append(b)
        size += b.nbytes
        if size >= limit:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts, size = [], 0
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def flat(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return pc.fill_null(col, "")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about limit bytes (a longer text is a slice of its own), with the first row's index."""
    col = flat(col)
    _, off = buffers(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, col.slice(i, j - i)
        i = j


def words(col: pa.Array, norm: bool = True) -> Words:
    """Words of one chunk; norm chooses normalised or raw words."""
    if norm:
        col = pc.utf8_lower(col)
    data, boff = buffers(col)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(col) + 1, np.int64), data, boff)
    isw = (_NORM if norm else _RAW)[data]
    st, en = isw.copy(), isw.copy()
    st[1:] &= ~isw[:-1]
    en[:-1] &= ~isw[1:]
    cut = boff[(boff > 0) & (boff < n)]
    st[cut] = isw[cut]
    en[cut - 1] = isw[cut - 1]
    start, end = np.flatnonzero(st), np.flatnonzero(en) + 1
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, np.zeros(len(col) + 1, np.int64), data, boff)
    pos = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    base = np.where(st, pos, 0)
    np.maximum.accumulate(base, out=base)
    pos -= base
    pos &= _POW_N - 1
    val = data.astype(np.uint64)
    val += np.uint64(1)
    val *= _POW[pos]
    val *= isw
    h = np.add.reduceat(val, start)
    h = mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return Words(h, start, end, np.searchsorted(start, boff).astype(np.int64), data, boff)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (crossing documents too: the caller masks those)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= np.uint64(0xA0761D6478BD642F)
        out += h[k : k + m]
    return mix(out)


def inside(off: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each start in 0..total - n whose n words lie in one document."""
    m = total - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.zeros(total + 1, np.int32)
    lo, hi = off[:-1], np.maximum(off[:-1], off[1:] - n + 1)
    np.add.at(ok, lo, 1)
    np.add.at(ok, hi, -1)
    return np.cumsum(ok)[:m] > 0


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i]."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def by_bucket(bucket: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Rows packed as one binary per bucket: far fewer shuffle records than rows, and no per-row object."""
    order = np.argsort(bucket, kind="stable")
    bucket, cols = bucket[order], [c[order] for c in cols]
    at = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    blobs = [np.int64(j - i).tobytes() + b"".join(c[i:j].tobytes() for c in cols) for i, j in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]].astype(np.int64), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def from_buckets(batches, kinds: list[tuple], keyed: bool = False) -> Iterator:
    """The columns of each bucket of a partition (with the bucket before them, if keyed); kinds has (dtype, width) of
    each, width 1 for flat columns."""
    by: dict[int, list] = {}
    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            by.setdefault(k, []).append(blob.as_buffer())
    while by:
        key, blobs = by.popitem()
        parts = []
        for blob in blobs:
            n, at, row = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
            for kind, width in kinds:
                c = np.frombuffer(blob, kind, n * width, at)
                at += c.nbytes
                row.append(c.reshape(n, width) if width > 1 else c)
            parts.append(row)
        cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
        yield (key, *cols) if keyed else cols
    relieve()


def grouped(batches, key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups: rows that come sorted by the column of number key are held until their group ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(key).to_numpy(zero_copy_only=False)
        lo = int(np.searchsorted(g, g[-1]))
        if held and held[-1].column(key)[0].as_py() == g[-1]:
            held.append(b)
            continue
        done = held + [b.slice(0, lo)] * (lo > 0)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            relieve()
        held = [b.slice(lo)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
