"""Vectorised kernels over whole texts held as UTF-8 bytes in Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SEED = np.random.default_rng(0x5EED).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLD = np.arange(256)
FOLD[65:91] += 32
EXACT_VALUES = _SEED
FOLDED_VALUES = _SEED[FOLD]
_BASE = U(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(29)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(32)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((int(_BASE), pow(int(_BASE), -1, 2**64))):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0][:n], _powers[1][:n]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(off: np.ndarray, limit: int = 1 << 19):
    """Runs of whole documents of about ``limit`` bytes (one document at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACE):
    """Starts and ends of the maximal runs of other bytes than separators, and the index of each document's first."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~separator[buf]
    edge = np.empty(n + 1, bool)
    edge[0] = True
    edge[1:n] = ~word[:-1]
    edge[off] = True
    starts = np.flatnonzero(word & edge[:n])
    edge[n] = True
    edge[1:n] = ~word[1:]
    edge[off[off > 0]] = True
    ends = np.flatnonzero(word & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = EXACT_VALUES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, a function of those bytes alone."""
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * _BASE
    return mix(h)


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5):
    """Hashes of runs of ``size`` words within each document, and the bounds of each document's.

    A document with fewer words, but one at least, has one shingle of all its words.
    """
    n = len(words)
    count = np.diff(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    coefficient = [U(pow(0xD6E8FEB86659FD93, k + 1, 2**64)) for k in range(size)]
    padded = np.concatenate([words, np.zeros(size - 1, np.uint64)])
    h = words * coefficient[0]
    for k in range(1, size):
        h += padded[k : k + n] * coefficient[k]
    keep = np.arange(n) <= np.repeat(np.maximum(first[1:] - size, first[:-1]), count)
    short = np.flatnonzero((count > 0) & (count < size))
    for d in short:  # their one shingle must not read the next document
        h[first[d]] = U(sum(int(words[first[d] + k]) * int(coefficient[k]) for k in range(count[d])) + int(count[d]) & (2**64 - 1))
    bounds = np.concatenate([[0], np.cumsum(np.where(count >= size, count - size + 1, np.minimum(count, 1)))])
    return mix(h[keep]), bounds


def join_blobs(column, dtype) -> np.ndarray:
    """The values that a binary column's rows hold one after another."""
    buf, _ = column_bytes(column)
    return buf.view(dtype) if len(buf) and buf.ctypes.data % np.dtype(dtype).itemsize == 0 else np.frombuffer(buf.tobytes(), dtype)


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, those of one significance together, compressed after their number."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return planes.nbytes.to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def stretch(blob: bytes, dtype) -> np.ndarray:
    """The array that ``squeeze`` packed."""
    size, n = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    if not size:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(blob[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(n, size // n).T).view(dtype).ravel()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)


def gather(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the spans one after another; their positions, eight times as large, are at hand for a part only."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(ends[-1]), buf.dtype)
    for i, j in slices(ends, 1 << 18):
        out[ends[i] : ends[j]] = buf[ranges(starts[i:j], sizes[i:j])]
    return out


def blob_batch(bucket: np.ndarray, schema: pa.Schema, **columns: np.ndarray):
    """One row for each bucket that occurs, holding the bytes of its values of every column, in their order."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(sorted_bucket[1:] != sorted_bucket[:-1]) + 1, [len(bucket)]])
    out = [pa.array(sorted_bucket[cut[:-1]], schema.field(0).type)]
    for name in schema.names[1:]:
        data = columns[name][order]
        out.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * data.dtype.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())]))
    return pa.RecordBatch.from_arrays(out, schema=schema)
