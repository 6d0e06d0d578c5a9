"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with equal sets of word shingles form one class, and only one representative of each goes on.
Candidates share all MinHash values of one of ``BANDS`` bands.  Within a band's bucket the signatures of a pair
are compared a few values at a time; after each step the pair is dropped if the posterior probability that its
similarity reaches the threshold is below ``TOLERANCE`` (uniform prior).  The pairs left are verified exactly.

A pair is counted in the first bucket that both share.  Pairs never leave a task: a bucket gives each member's
number of links and the least member of its part.  Buckets with more than ``BLOCK`` members are dealt to a task
for each pair of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .frames import buckets, free_names, prepare, stored, text_of
from .textkit import U, column_bytes, mix, ranges, shingle_hashes, slices, span_hashes, word_spans

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 20, 3, 12
TOLERANCE = 1e-6
BLOCK = 1024
_NO_ID = -(2**63)
_draw = np.random.default_rng(20)
_A = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
_B = _draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of n matching values at which P(similarity >= threshold) is not below the tolerance.

    With a uniform prior the posterior tail after m matches is P(Binomial(n + 1, threshold) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS):
    """Each document's different shingle hashes in ascending order, and their bounds."""
    starts, ends, first = word_spans(buf, off)
    h, bounds = shingle_hashes(span_hashes(buf, starts, ends), first, words)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


def signatures(h: np.ndarray, bounds: np.ndarray):
    """MinHash values, band keys (band number in the low 5 bits) and a 128-bit digest of each set; empty sets: zeros."""
    n = len(bounds) - 1
    some = np.flatnonzero(np.diff(bounds))
    sig, lo, hi = np.zeros((n, len(_A)), np.uint32), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(some):
        at = bounds[some]
        for k in range(len(_A)):
            sig[some, k] = np.minimum.reduceat(((h * _A[k] + _B[k]) >> U(32)).astype(np.uint32), at)
        lo[some] = np.add.reduceat(mix(h + _A[0]), at)
        hi[some] = np.add.reduceat(mix(h * _A[1] + _B[0]), at)
    keys = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        x = np.zeros(n, np.uint64)
        for r in range(ROWS):
            x = mix(x * U(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r] + U(1))
        keys[:, b] = x & ~U(31) | U(b)
    return sig, keys.view(np.int64), lo.view(np.int64), hi.view(np.int64)


def _describe(batches):
    for batch in batches:
        buf, off = column_bytes(batch.column(1))
        parts = [signatures(*shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off)]
        if not parts:
            continue
        _, keys, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        some = (lo != 0) | (hi != 0)
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(keys[some].ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lo), pa.array(hi), bands], names=["id", "lo", "hi", "bands"])


_MEMBER = "key long, bi int, bj int, block int, id long, bands binary, signature binary, shingles binary"


def _members(batches):
    """A row for each bucket, or pair of blocks of a large bucket, that a representative is in."""
    for batch in batches:
        buf, off = column_bytes(batch.column(4))
        ids, lo, hi = (batch.column(k).to_numpy() for k in (0, 1, 2))
        pairs = batch.column(3).to_pylist()
        for i, j in slices(off):
            h, bounds = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            sig, _, a, b = signatures(h, bounds)
            out = []
            for d in range(j - i):
                if a[d] != lo[i + d] or b[d] != hi[i + d]:  # another text under the same id
                    continue
                own = np.zeros(BANDS, np.int64)
                for p in pairs[i + d]:
                    own[p["key"] & 31] = p["key"]
                rest = (int(ids[i + d]), own.tobytes(), sig[d].tobytes(), h[bounds[d] : bounds[d + 1]].tobytes())
                for p in pairs[i + d]:
                    blocks = -(-p["n"] // BLOCK)
                    block = int(mix(np.array([ids[i + d]], np.int64).view(np.uint64).copy())[0] % U(blocks))
                    out += [(p["key"], min(block, x), max(block, x), block, *rest) for x in range(blocks)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["key", "bi", "bj", "block", "id", "bands", "signature", "shingles"])


def _links_of(band: int, left: np.ndarray, right: np.ndarray | None, bands, sig, sizes, sets, bounds, threshold: float):
    """Linked pairs of one bucket: indices of both, i < j within one block, or i left and j right."""
    table = {n: least_matches(n, threshold) for n in range(STEP, len(_A) + 1, STEP)}
    found = []
    lines = max(1, (1 << 19) // max(1, len(left if right is None else right)))
    for k in range(0, len(left), lines):
        i = left[k : k + lines]
        other = left[k + 1 :] if right is None else right
        ii, jj = np.repeat(i, len(other)), np.tile(other, len(i))
        if right is None:
            up = jj > ii
            ii, jj = ii[up], jj[up]
        keep = np.minimum(sizes[ii], sizes[jj]) >= threshold * np.maximum(sizes[ii], sizes[jj])
        for b in range(band):
            keep &= (bands[ii, b] != bands[jj, b]) | (bands[ii, b] == 0)
        ii, jj = ii[keep], jj[keep]
        matches = np.zeros(len(ii), np.int64)
        for n in range(STEP, len(_A) + 1, STEP):
            matches += np.count_nonzero(sig[ii, n - STEP : n] == sig[jj, n - STEP : n], axis=1)
            keep = matches >= table[n]
            ii, jj, matches = ii[keep], jj[keep], matches[keep]
        if not len(ii):
            continue
        order = np.argsort(ii, kind="stable")
        ii, jj = ii[order], jj[order]
        used = np.unique(np.concatenate([ii, jj]))
        place = np.zeros(len(sizes), np.int64)
        place[used] = np.cumsum(sizes[used]) - sizes[used]
        _, number = np.unique(sets[ranges(bounds[used], sizes[used])], return_inverse=True)
        seen = np.zeros(int(number.max()) + 1, bool)
        cut = np.concatenate([[0], np.flatnonzero(ii[1:] != ii[:-1]) + 1, [len(ii)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i, js = ii[a], jj[a:b]
            mine = number[place[i] : place[i] + sizes[i]]
            seen[mine] = True
            both = np.add.reduceat(seen[number[ranges(place[js], sizes[js])]].astype(np.int64), np.cumsum(sizes[js]) - sizes[js])
            seen[mine] = False
            ok = both >= threshold * (sizes[i] + sizes[js] - both) - 1e-9
            found.append((np.full(int(ok.sum()), i), js[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _verify(threshold: float):
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, key, bi, bj, block = (table[c].to_numpy() for c in ("id", "key", "bi", "bj", "block"))
        order = np.lexsort((ids, block, bj, bi, key))
        same = lambda *cs: np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in cs])
        order = order[np.append(True, ~same(key, bi, bj, ids))]  # repeated rows
        cut = np.concatenate([[0], np.flatnonzero(~same(key, bi, bj)) + 1, [len(order)]]) if len(order) else [0]
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < 2:
                continue
            part = table.take(pa.array(order[a:b]))
            n = b - a
            bands = np.frombuffer(b"".join(part["bands"].to_pylist()), np.int64).reshape(n, BANDS)
            sig = np.frombuffer(b"".join(part["signature"].to_pylist()), np.uint32).reshape(n, len(_A))
            data, off = column_bytes(part["shingles"])
            sets, bounds = np.frombuffer(data.tobytes(), np.uint64), off // 8
            own, name = part["block"].to_numpy(), part["id"].to_numpy()
            x, y = int(part["bi"][0].as_py()), int(part["bj"][0].as_py())
            left = np.flatnonzero(own == x)
            ii, jj = _links_of(int(part["key"][0].as_py()) & 31, left, None if x == y else np.flatnonzero(own == y), bands, sig, np.diff(bounds), sets, bounds, threshold)
            if not len(ii):
                continue
            label = np.arange(n)
            while True:  # ids ascend within a block only, so roots are by id
                least = label.copy()
                np.minimum.at(least, ii, label[jj])
                np.minimum.at(least, jj, label[ii])
                least = least[least]
                if (least == label).all():
                    break
                label = least
            root = np.full(n, 2**63 - 1)
            np.minimum.at(root, label, name)
            links = np.bincount(ii, minlength=n) + np.bincount(jj, minlength=n)
            some = links > 0
            out.append((name[some], links[some], root[label][some]))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], schema=schema)

    return run


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, copy_of, n_copies, n_links`` for each row of docs.

    Rows with equal shingle sets are copies: ``copy_of`` is the least id among them, ``n_copies`` their number.
    ``n_links`` counts the other shingle sets whose Jaccard similarity to the row's is at least the threshold,
    ``class_id`` is the least id that links lead to.  Words are runs of other characters than white space; a
    text of fewer than five words, but one at least, has one shingle; null texts are empty, and texts without
    words are copies of one another.  Null ids count as the least id and stay null.  Repeated rows are copies.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), text_of(F.col(text)).alias("text"))
    described = stored(rows.mapInArrow(_describe, "id long, lo long, hi long, bands array<long>"), "shingle-sets")
    classes = stored(described.groupBy("lo", "hi").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")), "classes")
    member = classes.select("rep", "lo", "hi", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("a"), F.bit_xor(F.xxhash64(F.lit(7), "rep")).alias("b")).where("n > 1")
    shared = shared.groupBy("n", "a", "b").agg(F.min(F.struct(F.expr("key & 31").alias("band"), "key")).alias("least")).select(F.col("least.key").alias("key"), "n")  # buckets of the same members
    wanted = member.join(shared, "key").groupBy("rep", "lo", "hi").agg(F.collect_list(F.struct("key", "n")).alias("pairs"))  # at most BANDS each
    texts = rows.join(wanted, F.col("id") == F.col("rep")).select("rep", "lo", "hi", "pairs", "text")
    members = texts.mapInArrow(_members, _MEMBER)
    groups = buckets(spark, 4)
    checked = members.withColumn("g", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(groups))).groupBy("g").applyInArrow(_verify(threshold), "id long, links long, root long")
    checked = stored(checked, "links")
    parts = components(checked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = checked.groupBy("id").agg(F.sum("links").alias("n_links"))
    told = classes.select("lo", "hi", "rep", "n_copies").join(links, F.col("rep") == F.col("id"), "left").drop("id").join(parts, F.col("rep") == F.col("node"), "left")
    back = lambda c: F.when(c != _NO_ID, c)
    told = told.select("lo", "hi", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "rep").alias("class"))
    out = described.select("id", "lo", "hi").join(told, ["lo", "hi"])
    return out.select(back(F.col("id")).alias(doc_id), back(F.col("class")).alias("class_id"), back(F.col("rep")).alias("copy_of"), "n_copies", "n_links")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose id is the least of their class; rows that share such an id all stay.

    All columns stay, whatever their names.  Nulls, empty texts, ties and repeated rows are treated as in
    ``similar_classes``; an empty table gives an empty table.
    """
    (own,) = free_names(docs.columns, "id")
    stay = similar_classes(docs, doc_id, text, threshold).where(F.col(doc_id).eqNullSafe(F.col("class_id"))).select(F.col(doc_id).alias(own)).distinct()
    return docs.join(stay, F.col(doc_id).eqNullSafe(F.col(own)), "left_semi")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
