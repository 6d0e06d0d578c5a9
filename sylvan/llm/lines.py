"""Substring deduplication by hashing lines and sentences.

A unit is a line, or a sentence of at least ``LEAST_WORDS`` words within a line.  Units are compared by their
words alone, in lower case, so spacing and letter case of ASCII letters don't count; a unit without words is
never removed.  Of the units with equal words, be they lines or sentences, the earliest, by document id and
offset, stays.

Each part of the input keeps one unit of a digest and drops the others at once, so a line that stands in a
third of all documents meets in its bucket once for each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import buckets, prepare, stored, text_of
from .suffix import _finish, _ids, _partial, _spread
from .textkit import EXACT_VALUES, FOLDED_VALUES, U, _power_tables, blob_batch, column_bytes, join_blobs, mix, ranges, slices, span_hashes, word_spans

LEAST_WORDS = 8
_FLUSH_UNITS = 400_000
_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def units(buf: np.ndarray, off: np.ndarray, least_words: int = LEAST_WORDS):
    """Lines and sentences: document, start, end (bytes in it, from the first word to the last), digest halves."""
    starts, ends, first = word_spans(buf, off)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    words = span_hashes(buf, starts, ends, FOLDED_VALUES)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(_LINE_END[buf])])[starts]
    new_line = np.append(True, (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1]))
    new_sentence = new_line.copy()
    new_sentence[1:] |= _STOP[buf[ends[:-1] - 1]]
    up, down = _power_tables(len(words) + 1)
    sums = [np.concatenate([[U(0)], np.cumsum(x * up[:-1])]) for x in (words, mix(words + U(77)))]
    out = []
    for kind, new in ((1, new_line), (2, new_sentence)):
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(words))
        if kind == 2:
            keep = (b - a >= least_words) & ~(new_line[a] & np.append(new_line[b[:-1]], True))  # a whole line is a unit already
            a, b = a[keep], b[keep]
        lo, hi = (mix((s[b] - s[a]) * down[a] + U(1)) for s in sums)
        out.append((doc[a], starts[a] - off[doc[a]], ends[b - 1] - off[doc[a]], lo, hi))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _text_hashes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each whole text, which tells rows of one id apart."""
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j in slices(off):
        out[i:j] = span_hashes(buf[off[i] : off[j]], off[i:j] - off[i], off[i + 1 : j + 1] - off[i], EXACT_VALUES)
    return out


_NAMES = ["lo", "hi", "id", "text", "start", "end"]
_UNITS = pa.schema([("bucket", pa.int64()), *[(n, pa.binary()) for n in _NAMES], *[(n, pa.binary()) for n in ("gone_id", "gone_text", "gone_start", "gone_end")]])
_GONE = pa.schema([("bucket", pa.int64()), *[(n, pa.binary()) for n in ("id", "text", "start", "end")]])


def _split(lo, hi, ids, text, start):
    """Indices of the first unit of each digest and of the others; units of repeated rows share a place and all stay."""
    order = np.lexsort((start, text, ids, hi, lo))
    same = (lo[order][1:] == lo[order][:-1]) & (hi[order][1:] == hi[order][:-1])
    new = np.append(True, ~same)
    head = order[new][np.cumsum(new) - 1]
    tie = (ids[order] == ids[head]) & (text[order] == text[head]) & (start[order] == start[head])
    return order[new], order[~tie]


def _find(n_buckets: int, least_words: int):
    def flush(held):
        lo, hi, ids, text, start, end = (np.concatenate(x) for x in zip(*held, strict=True))
        stay, gone = _split(lo, hi, ids, text, start)
        yield _partial(_UNITS, _NAMES, (lo[stay] % U(n_buckets)).astype(np.int64), lo=lo[stay], hi=hi[stay], id=ids[stay], text=text[stay], start=start[stay], end=end[stay])
        if len(gone):
            yield _partial(_UNITS, _UNITS.names[7:], _spread(ids[gone], n_buckets), gone_id=ids[gone], gone_text=text[gone], gone_start=start[gone], gone_end=end[gone])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = _ids(batch.column(0))
            buf, off = column_bytes(batch.column(1))
            texts = _text_hashes(buf, off)
            for i, j in slices(off):
                doc, start, end, lo, hi = units(buf[off[i] : off[j]], off[i : j + 1] - off[i], least_words)
                held.append((lo, hi, ids[i + doc], texts[i + doc], start.astype(np.int32), end.astype(np.int32)))
                size += len(doc)
            if size >= _FLUSH_UNITS:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _earliest(n_groups: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.uint64, np.int64, np.uint64, np.int32, np.int32)
        lo, hi, ids, text, start, end = (join_blobs(table[n], t) for n, t in zip(_NAMES, kinds, strict=True))
        gone = _split(lo, hi, ids, text, start)[1] if len(lo) else np.zeros(0, np.int64)
        own = [join_blobs(table[n], t) for n, t in zip(_UNITS.names[7:], kinds[2:], strict=True)]
        ids, text, start, end = (np.concatenate([a[gone], b]) for a, b in zip((ids, text, start, end), own, strict=True))
        out = blob_batch(_spread(ids, n_groups), _GONE, id=ids, text=text, start=start, end=end)
        return pa.Table.from_batches([] if out is None else [out], _GONE)

    return run


def _locate(ids: np.ndarray, gone: pa.Table, buf: np.ndarray, off: np.ndarray):
    wanted, text = join_blobs(gone["id"], np.int64), join_blobs(gone["text"], np.uint64)
    start, end = join_blobs(gone["start"], np.int32).astype(np.int64), join_blobs(gone["end"], np.int32)
    lo, hi = np.searchsorted(ids, wanted), np.searchsorted(ids, wanted, "right")
    which, row = np.repeat(np.arange(len(wanted)), hi - lo), ranges(lo, hi - lo)
    mine = _text_hashes(buf, off)[row] == text[which]
    which, row = which[mine], row[mine]
    return row, start[which], (end[which] - start[which]).astype(np.int32)


def _removals(docs: DataFrame, doc_id: str, text: str, least_words: int):
    spark = docs.sparkSession
    prepare(spark)
    n = buckets(spark, 2)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(F.col(text)).alias("text"))
    binary = lambda schema: ", ".join(f"`{f.name}` {'long' if f.name == 'bucket' else 'binary'}" for f in schema)
    found = rows.mapInArrow(_find(n, least_words), binary(_UNITS))
    return stored(found.groupBy("bucket").applyInArrow(_earliest(n), binary(_GONE)), "units"), n


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256``: removed units as byte offsets in the original text.

    Null texts are empty; null ids come first.  Rows that share an id rank by a hash of their texts; rows equal
    in both are one document.  An empty table gives an empty table; other columns are not read.
    """
    from pyspark.sql import types as T

    gone, n = _removals(docs, doc_id, text, least_words)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([long("doc_id"), long("n_bytes"), long("n_removed"), long("n_spans"), T.StructField("spans", T.ArrayType(T.StructType([long("start"), long("end")]))), T.StructField("kept_sha256", T.StringType())])
    return _finish(rows, gone, n, "doc_id", "text", schema.names, schema, False, _locate).withColumnRenamed("doc_id", doc_id)


def remove_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs without their repeated units.

    All rows and columns stay, with their values, whatever the columns' names.  Null texts become empty ones;
    null ids come first, ties and repeated rows are treated as in ``repeated_units``, and an empty table gives
    an empty table.
    """
    gone, n = _removals(docs, doc_id, text, least_words)
    rows = docs.withColumn(text, text_of(F.col(text)))
    return _finish(rows, gone, n, doc_id, text, docs.columns, rows.schema, True, _locate)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
