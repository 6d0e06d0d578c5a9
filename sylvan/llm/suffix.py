"""Suffix-array deduplication of substrings: column-wise construction of a collection's Burrows-Wheeler transform.

Whole collections are far too long for one column per byte of the longest text, so the collection is first cut,
without loss, into short strings.  The minimiser of a 100-byte window is the least hash among its 32-byte
substrings; equal windows have equal minimisers, so a window whose minimiser occurs once in the corpus cannot
repeat.  Windows with a repeated minimiser are grouped into short strings (a run of windows with one
minimiser), sent to the bucket of that minimiser, and there the transform and common prefixes of all different
strings are built column by column: each round inserts one symbol per string by two sequential passes over
external files.  Suffixes whose common prefix reaches 100 bytes are equal windows.  A minimiser with more strings than one
construction takes is divided by longer substrings of its windows, so memory does not grow with it.

Hot passages: where a task holds more than ``COPIES`` equal strings, one stands for them before the shuffle, so
a passage in a third of all documents reaches its bucket once for each group of documents; minimisers that occur very often rank last when
a window chooses its minimiser, so only windows that lie wholly in a hot passage, which are equal and collapse,
still meet at one.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import buckets_for, free_names, prepare, stored, text_of
from .textkit import U, blob_batch, column_bytes, gather, join_blobs, mix, ranges, slices

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: A minimiser with more than this share of all strings ranks last; at most 1 / HOT_SHARE are broadcast.
HOT_SHARE = 1 / 2000
#: Equal strings at hand that go on to the construction; more of them are a hot group, of which one goes on.
COPIES = 4
#: Most strings in one construction, before those of more than SPAN windows are shortened to that.
BUILD = 2_000
#: A minimiser with more strings is divided by the least hash of its windows' substrings of so many bytes, again and again.
FINER = (64, 80, 96, LENGTH)
#: Most bytes of texts in a group on average.
GROUP = 8 << 20
#: Bytes of texts, or one text, that masks are made for at a time.
APPLY = 1 << 18
MAX_RUN = 255
#: Bytes of a symbol in a construction; LENGTH is a multiple.
WIDTH = 5
_GRAM_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_NO_ID = -(2**63)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of all 32-byte substrings, by doubling."""
    h, step, m = _GRAM_VALUES[buf], 1, 0x9E3779B97F4A7C15
    while step < GRAM and len(h) > step:
        h = h[:-step] * U(m) + h[step:]
        m, step = (m * m + 2) | 1 & (2**64 - 1), step * 2
        m &= 2**64 - 1
    return mix(h) if step >= GRAM else h[:0]


def window_minima(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    m, w = h, 1
    while w * 2 <= span and len(m) > w:
        m, w = np.minimum(m[:-w], m[w:]), w * 2
    return np.minimum(m[: len(m) - (span - w)], m[span - w :]) if len(m) > span - w else m[:0]


def group_key(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of a 63-bit hash and 31 more of its bits: hashes that differ rarely share one, which costs only work."""
    n = U(n_buckets)
    return (h % n) << U(31) | (h // n) & U(2**31 - 1)


def shorter_runs(length: np.ndarray, most: int):
    """Runs of at most so many windows: the run each is of, windows of that before it, windows."""
    parts = -(-length // most)
    run, at = np.repeat(np.arange(len(length)), parts), ranges(np.zeros(len(parts), np.int64), parts) * most
    return run, at, np.minimum(length[run] - at, most)


def minimiser_runs(buf: np.ndarray, off: np.ndarray, n_buckets: int = 1, hot: np.ndarray | None = None):
    """Runs of windows with one minimiser: document, start in it, windows, minimiser (top bit: hot), whether the
    minimiser stands twice in the run (as in periodic text, which may repeat itself).

    ``hot`` has the sorted group keys of minimisers that rank last.
    """
    h = gram_hashes(buf)
    h >>= U(1)
    if hot is not None and len(hot) and len(h):
        key = group_key(h, n_buckets)
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        h |= (hot[at] == key).astype(np.uint64) << U(63)
    m = window_minima(h)
    if not len(m):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    change = np.empty(len(m), bool)
    change[0] = True
    np.not_equal(m[1:], m[:-1], out=change[1:])
    inner = off[1:-1]
    last = np.maximum(off[1:] - LENGTH + 1, off[:-1])  # the first start in each document that has no whole window
    change[inner[inner < len(m)]] = True
    change[last[last < len(m)]] = True
    starts = np.flatnonzero(change)
    doc = np.searchsorted(off, starts, "right") - 1
    keep = starts < last[doc]
    ends = np.append(starts[1:], len(m))[keep]
    starts, doc = starts[keep], doc[keep]
    length, smallest = ends - starts, m[starts]
    twice = np.zeros(len(starts), bool)
    leaves = np.flatnonzero((h[: len(m) - 1] == m[:-1]) & (m[1:] == m[:-1]))
    if len(leaves) and len(starts):
        run = np.maximum(np.searchsorted(starts, leaves, "right") - 1, 0)
        twice[run[leaves < ends[run]]] = True
    if len(length) and length.max() > MAX_RUN:  # periodic text
        run, at, length = shorter_runs(length, MAX_RUN)
        starts, doc, smallest, twice = starts[run] + at, doc[run], smallest[run], twice[run]
    return doc, starts - off[doc], length, smallest, twice


_BLOCK = 1 << 20


def _write_over(file, values: np.ndarray) -> None:
    """Writes an array front to back over what the file holds."""
    file.seek(0)
    view = memoryview(values.view(np.uint8))
    for i in range(0, len(view), _BLOCK):
        file.write(view[i : i + _BLOCK])


def _read_over(file, n: int, dtype) -> np.ndarray:
    """The n values at the front of a file, read block by block."""
    out = np.empty(n, dtype)
    file.seek(0)
    view = memoryview(out.view(np.uint8))
    for i in range(0, len(view), _BLOCK):
        file.readinto(view[i : i + _BLOCK])
    return out


class ColumnBuilder:
    """Column-wise construction of the transform and common prefixes of a collection of strings.

    A symbol is four bytes, or five, so that a round moves as many on; each string stands in the collection in
    as many alignments, from its end, its end less one byte, and so on, and each of its suffixes of a symbol or
    more is thus in exactly one.  Equal suffixes are one row of the transform for as long as they are equal: a
    round groups the strings of each row by their next symbol, so copies cost little more than one string, and
    that they are copies is what the rounds find.  Two files, written over and read front to back in each round,
    hold the transform, as every symbol's places in order, and each row's common prefix in symbols with the one
    above it, up to ``limit``.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int = LENGTH // 4, folder: str | None = None, width: int = 4):
        n = len(data)
        if n + width * len(starts) >= 1 << 64 - 8 * width:
            raise ValueError("too many bytes for places beside symbols of this width")
        wide = np.concatenate([data, np.zeros(width - 1, np.uint8)]).astype(np.uint64)
        self.values = np.zeros(n, np.uint64)
        for k in range(width):
            self.values |= wide[k : n + k] << U(56 - 8 * k)
        self.width, self.place = width, U((1 << 64 - 8 * width) - 1)  # the bits of a link that hold its place
        self.count, self.limit, self.folder = len(starts), limit, folder
        shift = np.repeat(np.arange(width), self.count)
        self.whole = np.tile(lengths, width)
        self.tails = np.tile(starts + lengths, width) - shift
        self.lengths = np.maximum(self.whole - shift, 0) // width
        self.shift = shift

    def build(self):
        """For each suffix in order: string, byte position in it, and common prefix in symbols with the one above.

        First come the end markers of all alignments, with a position at or near the string's end.
        """
        with tempfile.TemporaryDirectory(prefix="bwt-", dir=self.folder) as folder, contextlib.ExitStack() as stack:
            return self._build(folder, stack)

    def _build(self, folder: str, stack):
        lengths, n_strings, place = self.lengths, len(self.lengths), self.place
        files = [[stack.enter_context(open(os.path.join(folder, f"{side}{what}"), "w+b", buffering=0)) for what in ("prefixes", "links")] for side in range(2)]
        prefixes, links = np.zeros(0, np.uint8), np.zeros(0, np.uint64)
        strings, row = np.arange(n_strings, dtype=np.int32), np.zeros(n_strings, np.int32)  # all strings end alike
        places, up = np.zeros(1, np.int64), np.zeros(1, np.uint8)
        below, down = places[:0], up[:0]
        trail = []
        for j in range(int(lengths.max(initial=0)) + 1):
            read, write = files[j & 1], files[~j & 1]
            if j:  # files only grow and are written over, so a round makes no new pages of them
                prefixes, links = (_read_over(f, len(x), x.dtype) for f, x in zip(read, (prefixes, links), strict=True))
            # This round's rows go to their places, with their common prefixes.
            trail.append((places, strings, row))
            total = len(prefixes) + len(places)
            old = np.ones(total, bool)
            old[places] = False
            out = np.empty(total, np.uint8)
            out[old] = prefixes
            out[below] = down
            out[places] = up
            _write_over(write[0], out)
            prefixes = out
            # The symbols before each row (none before a whole string) join the transform; older symbols move down.
            more = lengths[strings] > j
            strings = strings[more]
            new, row = np.unique(self.values[self.tails[strings] - self.width * (j + 1)] | places[row[more]].astype(np.uint64), return_inverse=True)
            row = row.astype(np.int32)
            if len(links):
                moved = np.flatnonzero(old).astype(np.uint32)
                spot = links & place
                links ^= spot
                links |= moved[spot.view(np.int64)]
            at = np.searchsorted(links, new) + np.arange(len(new))
            merged, kept = np.empty(len(links) + len(new), np.uint64), np.ones(len(links) + len(new), bool)
            kept[at] = False
            merged[kept], merged[at] = links, new
            links = merged
            _write_over(write[1], links)
            if not len(new):
                break
            # Rows that start with a symbol stand as the symbol's places do, after the empty row.  The next rows' common
            # prefixes are one more than the least between a symbol and its like before or after.
            places = at + 1
            before, after = links[np.maximum(at - 1, 0)], links[np.minimum(at + 1, len(links) - 1)]
            here, before_at, after_at = ((x & place).view(np.int64) for x in (new, before, after))
            table = self._table(prefixes)
            like = (at > 0) & ((before ^ new) <= place)
            up = np.zeros(len(new), np.uint8)
            up[like] = self._least(table, before_at[like] + 1, here[like] + 1)
            like = (at + 1 < len(links)) & ((after ^ new) <= place)
            below, down = places[like] + 1, self._least(table, here[like] + 1, after_at[like] + 1)
        return self._read_off(prefixes, trail)

    def _least(self, table, lo, hi):
        """min(limit, 1 + the least prefix in [lo, hi)) for each pair; hi > lo."""
        level = np.frexp(hi - lo)[1] - 1
        at = level * table.shape[1]
        flat = table.reshape(-1)
        return np.minimum(np.minimum(flat[at + lo], flat[at + hi - (1 << level)]) + np.uint8(1), np.uint8(self.limit))

    @staticmethod
    def _table(prefixes):
        """Minima of 1, 2, 4, ... prefixes from each row on."""
        n = len(prefixes)
        table = np.empty((n.bit_length(), n), np.uint8)
        table[0] = prefixes
        for k in range(1, len(table)):
            step, size = 1 << k - 1, n - (1 << k) + 1
            np.minimum(table[k - 1, :size], table[k - 1, step : step + size], out=table[k, :size])
        return table

    def _read_off(self, prefixes, trail):
        """Where each round's rows stand in the end, as later rounds push them down; a line for each string of a row."""
        free = np.arange(len(prefixes), dtype=np.int32)
        rows, strings, backs = [], [], []
        for j in range(len(trail) - 1, -1, -1):
            places, members, row = trail[j]
            rows.append(free[places][row])
            strings.append(members)
            backs.append(np.full(len(members), j, np.int32))
            if j:
                keep = np.ones(len(free), bool)
                keep[places] = False
                free = free[keep]
        rows, owner, back = (np.concatenate(x) for x in (rows, strings, backs))
        order = np.argsort(rows)
        rows, owner, back = rows[order], owner[order], back[order]
        byte = self.whole[owner] - self.shift[owner] - self.width * back
        first = np.append(True, rows[1:] != rows[:-1])
        return owner % max(1, self.count), byte, np.where(first, prefixes[rows], np.minimum(back, self.limit).astype(np.uint8))


_ASK = pa.schema([("bucket", pa.int64()), ("asked", pa.binary()), ("ask_id", pa.binary()), ("ask_start", pa.binary()), ("ask_run", pa.binary()), ("many", pa.binary()), ("many_n", pa.binary()), ("sure", pa.binary()), ("sure_id", pa.binary()), ("sure_start", pa.binary()), ("sure_run", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("id", pa.binary()), ("start", pa.binary()), ("run", pa.binary())])
_HOT = pa.schema([("hot", pa.int64()), ("n", pa.int64())])
_STRINGS = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("id", pa.binary()), ("at", pa.binary()), ("run", pa.binary()), ("bytes", pa.binary()), ("gone_id", pa.binary()), ("gone_at", pa.binary()), ("gone_n", pa.binary())])
_GONE = pa.schema([("bucket", pa.int64()), ("id", pa.binary()), ("at", pa.binary()), ("n", pa.binary())])
_ROW = 40  # a place is row << _ROW | start, row counting the rows of one id


def _partial(schema: pa.Schema, names: list[str], bucket: np.ndarray, **columns):
    """Rows of the schema with blobs in some columns and nulls in the others."""
    if not len(bucket):
        return None
    some = blob_batch(bucket, pa.schema([schema.field(0), *[schema.field(n) for n in names]]), **columns)
    return pa.RecordBatch.from_arrays([some.column(f.name) if f.name in some.schema.names else pa.nulls(some.num_rows, f.type) for f in schema], schema=schema)


def _spread(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64).copy()) % U(n)).astype(np.int64)


def _ids(column) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) if column.null_count else column.to_numpy(zero_copy_only=False).astype(np.int64)


def _ask(n_buckets: int, flush: int = 300_000):
    """Asks each minimiser's bucket whether it occurs again; those seen twice at hand go on at once, with one count."""

    def empty(held):
        ids, starts, runs, key, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        sure = (count[inverse] > 1) | twice
        one = ~sure
        bucket, low = (key >> U(31)).astype(np.int64), key.astype(np.uint32) & np.uint32(2**31 - 1)
        yield _partial(_ASK, ["asked", "ask_id", "ask_start", "ask_run"], bucket[one], asked=low[one], ask_id=ids[one], ask_start=starts[one], ask_run=runs[one])
        if sure.any():
            many, at = np.unique(key[sure], return_index=True)
            yield _partial(_ASK, ["many", "many_n"], (many >> U(31)).astype(np.int64), many=many.astype(np.uint32) & np.uint32(2**31 - 1), many_n=count[inverse[sure][at]].astype(np.int32))
            yield _partial(_ASK, ["sure", "sure_id", "sure_start", "sure_run"], _spread(ids[sure], n_buckets), sure=key[sure], sure_id=ids[sure], sure_start=starts[sure], sure_run=runs[sure])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = _ids(batch.column(0))
            buf, off = column_bytes(batch.column(1))
            for i, j in slices(off, 1 << 17):
                doc, start, length, m, twice = minimiser_runs(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                held.append((ids[i + doc], start.astype(np.int32), length.astype(np.uint8), group_key(m, n_buckets), twice))
                size += len(doc)
            if size >= flush:
                yield from (x for x in empty(held) if x is not None)
                held, size = [], 0
        if size:
            yield from (x for x in empty(held) if x is not None)

    return run


def _answer(n_groups: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column(0)[0].as_py()
        asked = join_blobs(table["asked"], np.uint32)
        many, many_n = join_blobs(table["many"], np.uint32), join_blobs(table["many_n"], np.int32)
        keys, inverse, n = np.unique(np.concatenate([asked, many]), return_inverse=True, return_counts=True)
        again = (n[inverse[: len(asked)]] > 1) if len(asked) else np.zeros(0, bool)
        ids = np.concatenate([join_blobs(table["ask_id"], np.int64)[again], join_blobs(table["sure_id"], np.int64)])
        starts = np.concatenate([join_blobs(table["ask_start"], np.int32)[again], join_blobs(table["sure_start"], np.int32)])
        runs = np.concatenate([join_blobs(table["ask_run"], np.uint8)[again], join_blobs(table["sure_run"], np.uint8)])
        key = np.concatenate([U(bucket) << U(31) | asked[again].astype(np.uint64), join_blobs(table["sure"], np.uint64)])
        total = np.bincount(inverse, weights=np.concatenate([np.ones(len(asked)), many_n])) if len(keys) else np.zeros(0)
        order = np.argsort(total, kind="stable")[::-1][: int(4 / HOT_SHARE)]  # more than can be hot in all
        order = order[total[order] > 16]
        out = blob_batch(_spread(ids, n_groups), _FOUND, key=key, id=ids, start=starts, run=runs)
        schema = pa.schema([*_FOUND, ("hot", pa.binary()), ("hot_n", pa.binary()), ("strings", pa.int64())])
        rows = [pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.binary()), pa.nulls(out.num_rows, pa.binary()), pa.nulls(out.num_rows, pa.int64())], schema=schema)] if out is not None else []
        hot = (U(bucket) << U(31) | keys[order].astype(np.uint64)).tobytes()
        rows.append(pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *[pa.nulls(1, pa.binary())] * 4, pa.array([hot], pa.binary()), pa.array([total[order].astype(np.int64).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], schema=schema))
        return pa.Table.from_batches(rows)

    return run


def _order_rows(docs: pa.Table, doc_id: str, text: str):
    """Rows in the order of id and text, and each one's number among the rows of its id."""
    ids = _ids(docs[doc_id].combine_chunks())
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        texts = [x or "" for x in docs[text].to_pylist()]
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
    docs, ids = docs.take(pa.array(order)), ids[order]
    row = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return docs, ids, row


def _at_rows(ids: np.ndarray, wanted: np.ndarray):
    """For each wanted id all rows that have it: index into wanted, row index."""
    lo, hi = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, "right")
    return np.repeat(np.arange(len(wanted)), hi - lo), ranges(lo, hi - lo)


def _same_strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray):
    """A number for each string, equal for equal strings (by a 128-bit hash) under one key."""
    a = np.empty(len(starts), np.uint64)
    b = np.empty(len(starts), np.uint64)
    bounds = np.append(starts, starts[-1] + lengths[-1])
    from .textkit import EXACT_VALUES, span_hashes

    for i, j in slices(bounds, 1 << 17):
        part = data[bounds[i] : bounds[j]]
        lo, hi = starts[i:j] - bounds[i], starts[i:j] - bounds[i] + lengths[i:j]
        a[i:j] = span_hashes(part, lo, hi)
        b[i:j] = span_hashes(part, lo, hi, EXACT_VALUES[::-1])
    a ^= mix(key.copy())
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = np.empty(len(a), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _collapse(data, starts, runs, key, ids, at, most: int | None = None):
    """Of more than ``most`` equal strings the first stays and the others' bytes are gone: indices of both."""
    same = _same_strings(data, starts, runs + LENGTH - 1, key)
    order = np.lexsort((at, ids, same))
    stay = np.ones(len(order), bool)
    stay[1:] = same[order][1:] != same[order][:-1]
    stay |= np.bincount(same)[same[order]] <= (COPIES if most is None else most)
    return np.sort(order[stay]), order[~stay]


def _cut(n_buckets: int, n_groups: int, hot: np.ndarray, doc_id: str, text: str):
    """Cuts the strings that may repeat out of the documents of a group."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and found.num_rows:
            docs, ids, row = _order_rows(docs, doc_id, text)
            buf, off = column_bytes(docs[text])
            key, start, length = join_blobs(found["key"], np.uint64), join_blobs(found["start"], np.int32).astype(np.int64), join_blobs(found["run"], np.uint8).astype(np.int64)
            which, at_row = _at_rows(ids, join_blobs(found["id"], np.int64))
            fits = start[which] + length[which] + LENGTH - 1 <= off[at_row + 1] - off[at_row]
            which, at_row = which[fits], at_row[fits]
            if len(which) and (ids[1:] == ids[:-1]).any():  # rows of one id were found once for each
                _, once = np.unique(at_row << _ROW | start[which], return_index=True)
                which, at_row = which[once], at_row[once]
            key, start, length = key[which], start[which], length[which]
            if len(hot) and len(key):
                is_hot = np.isin(key, hot)
                if is_hot.any():
                    size = length[is_hot] + LENGTH - 1
                    part, ends = gather(buf, off[at_row[is_hot]] + start[is_hot], size), np.concatenate([[0], np.cumsum(size)])
                    held = []
                    for i, j in slices(ends, 1 << 17):
                        n, s, r, m, _ = minimiser_runs(part[ends[i] : ends[j]], ends[i : j + 1] - ends[i], n_buckets, hot)
                        held.append((n + i, s, r, group_key(m & U(2**63 - 1), n_buckets) | (m >> U(63)) << U(63)))
                    n, s, r, k = (np.concatenate(x) for x in zip(*held, strict=True))
                    at_row, start = np.concatenate([at_row[~is_hot], at_row[is_hot][n]]), np.concatenate([start[~is_hot], start[is_hot][n] + s])
                    key, length = np.concatenate([key[~is_hot], k]), np.concatenate([length[~is_hot], r])
            if len(key):
                size = length + LENGTH - 1
                data, place = gather(buf, off[at_row] + start, size), row[at_row] << _ROW | start
                begins = np.cumsum(size) - size
                stay, gone = _collapse(data, begins, length, key, ids[at_row], place)
                bucket = ((key & U(2**62 - 1)) >> U(31)).astype(np.int64)
                # The bytes of a bucket's strings stand one after another in its row.
                order = stay[np.argsort(bucket[stay], kind="stable")]
                some = _partial(_STRINGS, ["key", "id", "at", "run"], bucket[order], key=key[order], id=ids[at_row[order]], at=place[order], run=length[order].astype(np.uint8))
                blob = gather(data, begins[order], size[order])
                per_row = np.concatenate([[0], np.cumsum(size[order])])
                cut = np.concatenate([[0], np.cumsum(np.unique(bucket[order], return_counts=True)[1])])
                bytes_column = pa.Array.from_buffers(pa.binary(), some.num_rows, [None, pa.py_buffer(per_row[cut].astype(np.int32)), pa.py_buffer(blob.tobytes())])
                rows.append(some.set_column(5, _STRINGS.field(5), bytes_column))
                if len(gone):
                    rows.append(_partial(_STRINGS, ["gone_id", "gone_at", "gone_n"], _spread(ids[at_row[gone]], n_buckets), gone_id=ids[at_row[gone]], gone_at=place[gone], gone_n=size[gone].astype(np.int32)))
        return pa.Table.from_batches([x for x in rows if x is not None], _STRINGS)

    return run


def _may_repeat(data: np.ndarray, starts: np.ndarray, runs: np.ndarray):
    """Cuts strings down to runs of windows whose first and last 64 bytes also occur elsewhere: string, offset, windows."""
    size = runs + LENGTH - 1
    bounds = np.concatenate([starts, [starts[-1] + size[-1]]])
    grams = []
    for i, j in slices(bounds, 1 << 17):
        end = min(int(bounds[j]) + GRAM, len(data))
        h = gram_hashes(data[bounds[i] : end])
        n = int(bounds[j] - bounds[i])
        h = np.concatenate([h, np.zeros(max(0, n + GRAM - len(h)), np.uint64)])
        grams.append(mix(h[:n] * U(0x9E3779B97F4A7C15) + h[GRAM : n + GRAM]))
    gram = np.concatenate(grams)
    index = ranges(starts - bounds[0], runs)
    inside = ranges(starts - bounds[0], runs + LENGTH - 2 * GRAM)  # starts of 64 bytes within a string
    slot = (gram[inside] >> U(42)).astype(np.int64)  # those that share a slot by chance go on, too
    again = np.zeros(len(gram), bool)
    again[inside] = np.bincount(slot, minlength=1 << 22)[slot] > 1
    ok = again[index] & again[index + LENGTH - 2 * GRAM]
    owner = np.repeat(np.arange(len(starts)), runs)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (owner[1:] != owner[:-1])
    end = np.flatnonzero(last) + 1
    return owner[begin], index[begin] - (starts - bounds[0])[owner[begin]], end - begin


def _finer_runs(data: np.ndarray, starts: np.ndarray, runs: np.ndarray, size: int):
    """Runs of windows with one least hash of their substrings of ``size`` bytes: string, offset, windows, hash."""
    bounds = np.append(starts, starts[-1] + runs[-1] + LENGTH - 1)
    held = []
    for i, j in slices(bounds, 1 << 17):
        h = gram_hashes(data[bounds[i] : bounds[j]])
        n = len(h) - (size - GRAM)
        wide = h[:n].copy()
        for at in (*range(GRAM, size - GRAM, GRAM), size - GRAM):
            wide *= U(0x9E3779B97F4A7C15)
            wide += h[at : at + n]
        first = starts[i:j] - bounds[i]
        index, owner = ranges(first, runs[i:j]), np.repeat(np.arange(j - i), runs[i:j])
        least = window_minima(mix(wide), LENGTH - size + 1)[index]
        new = np.ones(len(index), bool)
        if size < LENGTH:  # whole windows stay single
            new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
        begin = np.flatnonzero(new)
        held.append((owner[begin] + i, index[begin] - first[owner[begin]], np.diff(np.append(begin, len(index))), least[begin]))
    return (np.concatenate(x) for x in zip(*held, strict=True))


def _groups(key: np.ndarray):
    """Bounds of parts of at most BUILD of the sorted keys, or of a key that has more; equal keys stay together."""
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    i = 0
    while i < len(key):
        j = int(ends[max(np.searchsorted(ends, i + BUILD, "right") - 1, np.searchsorted(ends, i, "right"))])
        yield i, j
        i = j


def bounded_parts(data: np.ndarray, starts: np.ndarray, runs: np.ndarray, finer: tuple = FINER):
    """Parts of the strings' windows, of at most BUILD strings: string, offset, windows.  Of equal windows each but the
    first is in a part with the first.

    The strings, one after another in ``data``, are in the order of their places.
    """
    if len(starts) <= BUILD:
        yield np.arange(len(starts)), np.zeros(len(starts), np.int64), runs
    elif finer:
        string, offset, run, least = _finer_runs(data, starts, runs, finer[0])
        order = np.argsort(least, kind="stable")
        for i, j in _groups(least[order]):
            s, o, r = (x[order[i:j]] for x in (string, offset, run))
            if j - i <= BUILD:
                yield s, o, r
                continue
            length = r + LENGTH - 1
            for t, p, r in bounded_parts(gather(data, starts[s] + o, length), np.cumsum(length) - length, r, finer[1:]):  # noqa: B020
                yield s[t], o[t] + p, r
    else:  # single windows with one hash: nearly always all equal
        windows, left = data.reshape(-1, LENGTH), np.arange(len(starts))
        while len(left):
            same = (windows[left] == windows[left[0]]).all(axis=1)
            equal, left = left[same], left[~same]
            for i in range(1, len(equal), BUILD - 1):
                part = np.append(equal[0], equal[i : i + BUILD - 1])
                yield part, np.zeros(len(part), np.int64), runs[part]


def repeated_windows(data, starts, runs, rank):
    """Windows that an earlier equal window makes superfluous, from the transform of the strings: string, offset.

    ``rank`` orders the strings' places: of equal windows the one with the least (rank of its string, offset) stays.
    """
    builder = ColumnBuilder(data, starts, runs + LENGTH - 1, LENGTH // WIDTH, width=WIDTH)
    string, position, prefix = builder.build()
    window = position < runs[string]
    window[: WIDTH * len(starts)] = False
    # Suffixes of one window stand together; between them may stand none that isn't one (it would be shorter).
    new_class = prefix < builder.limit
    cls = np.cumsum(new_class)
    string, position, cls = string[window], position[window], cls[window]
    if not len(cls):
        return string, position
    place = rank[string].astype(np.int64) << 9 | position  # a position is below MAX_RUN
    begin = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    later = place != np.repeat(np.minimum.reduceat(place, begin), np.diff(np.append(begin, len(cls))))
    return string[later], position[later]


def _find(n_groups: int):
    def run(table: pa.Table) -> pa.Table:
        gone = [(join_blobs(table["gone_id"], np.int64), join_blobs(table["gone_at"], np.int64), join_blobs(table["gone_n"], np.int32))]
        key, ids, at = join_blobs(table["key"], np.uint64), join_blobs(table["id"], np.int64), join_blobs(table["at"], np.int64)
        if len(key):
            runs, (data, _) = join_blobs(table["run"], np.uint8).astype(np.int64), column_bytes(table["bytes"])
            size = runs + LENGTH - 1
            begins = np.cumsum(size) - size
            stay, drop = _collapse(data, begins, runs, key, ids, at)
            gone.append((ids[drop], at[drop], size[drop].astype(np.int32)))
            stay = stay[np.lexsort((at[stay], ids[stay], key[stay]))]
            # A construction takes whole minimisers, or a part of one that has too many strings.
            for i, j in _groups(key[stay]):
                gone.extend(removed(stay[i:j], data, begins, runs, ids, at))
        ids, at, n = (np.concatenate(x) for x in zip(*gone, strict=True))
        out = blob_batch(_spread(ids, n_groups), _GONE, id=ids, at=at, n=n)
        return pa.Table.from_batches([] if out is None else [out], _GONE)

    def removed(part, data, begins, runs, ids, at):
        size = runs[part] + LENGTH - 1
        whole, first = gather(data, begins[part], size), np.cumsum(size) - size
        for owner, begin, run in bounded_parts(whole, first, runs[part]):
            size = run + LENGTH - 1
            content, place, at_start = gather(whole, first[owner] + begin, size), at[part[owner]] + begin, np.cumsum(size) - size
            string, offset, run = _may_repeat(content, at_start, run)
            if not len(string):
                continue
            piece, more, run = shorter_runs(run, SPAN)
            string, offset = string[piece], offset[piece] + more
            length = run + LENGTH - 1
            content = gather(content, at_start[string] + offset, length)
            whose, place = ids[part[owner[string]]], place[string] + offset
            rank = np.argsort(np.lexsort((place, whose)), kind="stable")
            s, p = repeated_windows(content, np.cumsum(length) - length, run, rank)
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1)
            begin = np.flatnonzero(new)
            count = np.diff(np.append(begin, len(s)))
            s, p = s[begin], p[begin]
            yield whose[s], place[s] + p, (count + LENGTH - 1).astype(np.int32)

    return run


def _by_row(ids: np.ndarray, gone: pa.Table, buf: np.ndarray, off: np.ndarray):
    """Row, start in it and length of each removed run."""
    at, n = join_blobs(gone["at"], np.int64), join_blobs(gone["n"], np.int32)
    return np.searchsorted(ids, join_blobs(gone["id"], np.int64)) + (at >> _ROW), at & (2**_ROW - 1), n


def _apply(doc_id: str, text: str, names: list[str], schema: pa.Schema, whole_characters: bool, locate=_by_row):
    """Joins the removed runs of a group's documents and applies them."""

    def run(docs: pa.Table, gone: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs, ids, row = _order_rows(docs, doc_id, text)
        buf, off = column_bytes(docs[text])
        which = begin = n = np.zeros(0, np.int64)
        if gone.num_rows:
            which, begin, n = locate(ids, gone, buf, off)
            order = np.argsort(which, kind="stable")
            which, begin, n = which[order], begin[order], n[order]
        parts = []
        for i, j in slices(off, APPLY):  # the masks take many times the bytes of the texts
            a, b = np.searchsorted(which, [i, j])
            parts.append(part(docs.slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i], which[a:b] - i, begin[a:b], n[a:b]))
        return pa.concat_tables(parts)

    def part(docs: pa.Table, buf, off, which, begin, n) -> pa.Table:
        step = np.zeros(len(buf) + 1, np.int32)
        begin = off[which] + begin
        np.add.at(step, begin, 1)
        np.add.at(step, begin + n, -1)
        removed = np.cumsum(step[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        edge = removed.copy()
        edge[1:] &= ~removed[:-1]
        edge[off[:-1][off[:-1] < len(buf)]] |= removed[off[:-1][off[:-1] < len(buf)]]
        spans = np.concatenate([[0], np.cumsum(edge)])
        take = removed
        if whole_characters:  # a character goes only if all its bytes do
            lead = (buf & 0xC0) != 0x80
            char = np.cumsum(lead) - 1
            kept = np.bincount(char, weights=~removed) > 0 if len(buf) else np.zeros(0, bool)
            take = ~kept[char] if len(buf) else removed
        left = buf[~take]
        bounds = np.concatenate([[0], np.cumsum(~take)])[off]
        columns = {c: docs[c] for c in docs.column_names}
        if whole_characters:  # the rows' own columns, whatever their names
            columns[text] = pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(left.tobytes())])
            return pa.table([columns[n] for n in names], names=names).cast(schema)
        if "kept_sha256" in names:
            view = memoryview(np.ascontiguousarray(left))
            columns["kept_sha256"] = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        if "spans" in names:
            first, last = np.flatnonzero(edge), np.flatnonzero(removed & ~np.append(removed[1:] & ~edge[1:], False))
            doc = np.searchsorted(off, first, "right") - 1
            pair = pa.StructArray.from_arrays([pa.array(first - off[doc]), pa.array(last + 1 - off[doc])], names=["start", "end"])
            columns["spans"] = pa.ListArray.from_arrays(pa.array(spans[off].astype(np.int32)), pair)
        columns |= {"n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(total[off])), "n_spans": pa.array(np.diff(spans[off]))}
        return pa.table([columns[n] for n in names], names=names).cast(schema)

    return run


def _removals(docs: DataFrame, doc_id: str, text: str):
    """The bytes to remove, packed by group of documents, and the number of groups."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(F.col(text)).alias("text"))
    n_groups = buckets_for(rows, "text", GROUP, 4)  # a group's texts are at hand at once
    n_buckets = n_groups // 2
    asked = rows.where(F.octet_length("text") >= LENGTH).mapInArrow(_ask(n_buckets), "bucket long, asked binary, ask_id binary, ask_start binary, ask_run binary, many binary, many_n binary, sure binary, sure_id binary, sure_start binary, sure_run binary")
    answered = asked.groupBy("bucket").applyInArrow(_answer(n_groups), "bucket long, key binary, id binary, start binary, run binary, hot binary, hot_n binary, strings long")
    answered = stored(answered, "minimisers")
    total = answered.agg(F.sum("strings")).first()[0] or 0
    least = max(64, int(total * HOT_SHARE))

    def hottest(batches):
        for batch in batches:
            key, n = join_blobs(batch.column(0), np.uint64), join_blobs(batch.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= least].astype(np.int64)), pa.array(n[n >= least])], schema=_HOT)

    hot = answered.where("hot IS NOT NULL").select("hot", "hot_n").mapInArrow(hottest, "hot long, n long").collect()  # at most 1 / HOT_SHARE rows
    hot = np.sort(np.array([r[0] for r in hot], np.int64).astype(np.uint64))
    found = answered.where("bucket IS NOT NULL").select("bucket", "key", "id", "start", "run")
    grouped = rows.mapInArrow(_grouped(n_groups), "bucket long, id long, text string")
    strings = grouped.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_cut(n_buckets, n_groups, hot, "id", "text"), "bucket long, key binary, id binary, at binary, run binary, bytes binary, gone_id binary, gone_at binary, gone_n binary")
    gone = strings.groupBy("bucket").applyInArrow(_find(n_groups), "bucket long, id binary, at binary, n binary")
    return stored(gone, "removed"), n_groups


def _grouped(n_groups: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_spread(_ids(batch.column(0)), n_groups)), batch.column(0), batch.column(1)], names=["bucket", "id", "text"])

    return run


def _with_group(docs: DataFrame, doc_id: str, n_groups: int, name: str) -> DataFrame:
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            group = pa.array(_spread(_ids(batch.column(batch.schema.get_field_index(doc_id)).cast(pa.int64())), n_groups))
            yield pa.RecordBatch.from_arrays([*batch.columns, group], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _finish(docs: DataFrame, gone: DataFrame, n_groups: int, doc_id: str, text: str, names: list[str], schema, whole_characters: bool, locate=_by_row) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    (group,) = free_names(docs.columns, "group")
    left = _with_group(docs, doc_id, n_groups, group).groupBy(F.col(f"`{group}`"))
    run = _apply(doc_id, text, names, to_arrow_schema(schema), whole_characters, locate)
    return left.cogroup(gone.groupBy("bucket")).applyInArrow(run, schema)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of docs.

    A byte is removed if a 100-byte string that covers it also starts earlier: in a document of smaller id, or
    earlier in its own.  Null texts are empty.  Rows that share an id count as one after another, in the order
    of their texts, so a repeated row repeats the first; null ids come first.  An empty table gives an empty
    table; other columns are not read.
    """
    from pyspark.sql import types as T

    gone, n_groups = _removals(docs, doc_id, text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    return _finish(rows, gone, n_groups, "doc_id", "text", schema.names, schema, False).withColumnRenamed("doc_id", doc_id)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with their repeated bytes removed from the text.

    The rule is that of ``repeated_bytes``, but a character goes only if all its bytes do.  All rows and columns
    stay, with their values, whatever the columns' names; null texts become empty ones, null ids come first, and
    an empty table gives an empty table.
    """
    gone, n_groups = _removals(docs, doc_id, text)
    rows = docs.withColumn(text, text_of(F.col(text)))
    return _finish(rows, gone, n_groups, doc_id, text, docs.columns, rows.schema, True)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
