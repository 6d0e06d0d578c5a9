"""Class-based n-gram language model with exchange clustering.

P(w | h) = MIX * P(class(w) | s) * P(w | class(w)) + (1 - MIX) * P_base(w), where s is the class of the word
before w (or the document's start, or any class if that word is unknown) and P_base the add-one unigram.  A word unknown to the
training part has a class of its own, whose probability after s is the share of words seen once after s
(Good-Turing); it sums to one over the known words and one unknown word.

Classes come from the exchange algorithm: a word moves to the class that raises the likelihood of the class
bigrams most.  Words with a share of at least ``CORE`` of all tokens, at most 1 / CORE whatever the input, are
exchanged one after another on the driver.  Every other word, in any number, is placed by its placed neighbours
and from then on exchanged like all others by the bigrams of adjacent words, in the buckets of their hashes: a
turn moves a share of all words at once, the likelihood is counted anew, and a turn that lowers it is taken back.
The turns end when the likelihood settles; the bigrams then are the model.

Counts travel as packed arrays by bucket of the word's hash, summed at hand before they are shuffled.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import buckets_for, prepare, stored, text_of
from .textkit import FOLDED_VALUES, U, blob_batch, column_bytes, join_blobs, slices, span_hashes, squeeze, stretch, word_spans

CORE = 1 / 1000
CLASSES, ROUNDS, MIX = 40, 10, 0.95
#: Gain of a turn, in nats a token, below which the classes of all words have settled.
SETTLED = 1e-3
#: Tokens of a word from which the exact criterion is used.
EXACT = 200
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 48_000_000
END = U(0x454E44)
_FLUSH_TOKENS = 2_000_000
_PART_TOKENS = 1_500_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(buf: np.ndarray, off: np.ndarray):
    """Token hashes with an end after each document, and the bounds of each document's."""
    starts, ends, first = word_spans(buf, off)
    n = len(off) - 1
    h = np.empty(len(starts) + n, np.uint64)
    last = first[1:] + np.arange(n)
    word = np.ones(len(h), bool)
    word[last] = False
    h[last] = END
    h[word] = span_hashes(buf, starts, ends, FOLDED_VALUES)
    return h, first + np.arange(n + 1)


def _number(frequent: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each token among the frequent words, or -1."""
    if not len(frequent):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return np.where(frequent[at] == h, at, -1)


def _each(batches, text: int):
    """Token hashes and bounds of parts of the batches."""
    for batch in batches:
        buf, off = column_bytes(batch.column(text))
        for i, j in slices(off):
            yield tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])


_COUNTS = pa.schema([("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def _unique_sum(key: np.ndarray, n: np.ndarray):
    unique, inverse = np.unique(key, return_inverse=True)
    return unique, np.bincount(inverse, weights=n, minlength=len(unique)).astype(np.int64)


def _count(n_buckets: int):
    def run(batches):
        held, size = [], 0
        for h, _ in _each(batches, 0):
            held.append(h)
            size += len(h)
            if size >= _FLUSH_TOKENS:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    def flush(held):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return blob_batch((words % U(n_buckets)).astype(np.int64), _COUNTS, words=words, counts=n.astype(np.int32))

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    words, n = _unique_sum(join_blobs(table["words"], np.uint64), join_blobs(table["counts"], np.int32))
    return pa.table({"bucket": table["bucket"].slice(0, 1), "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "total": pa.array([int(n.sum())], pa.int64()), "kinds": pa.array([len(words)], pa.int64())})


def _core_pairs(core: np.ndarray):
    """Counts of adjacent tokens that are core words (or a document's start and its first), packed by first word."""
    start = len(core)
    schema = pa.schema([("first", pa.int64()), ("second", pa.binary()), ("n", pa.binary())])

    def flush(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return blob_batch(key // (start + 1), schema, second=(key % (start + 1)).astype(np.int32), n=n.astype(np.int64))

    def run(batches):
        held, size = [], 0
        for h, bounds in _each(batches, 0):
            number = _number(core, h)
            before = np.concatenate([[start], number[:-1]])
            before[bounds[:-1]] = start
            both = (before >= 0) & (number >= 0)
            held.append(before[both] * (start + 1) + number[both])
            size += len(held[-1])
            if size >= _FLUSH_TOKENS:
                out, held, size = flush(held), [], 0
                if out is not None:
                    yield out
        if size:
            yield flush(held)

    return run


def _sum_pairs(table: pa.Table) -> pa.Table:
    second, n = _unique_sum(join_blobs(table["second"], np.int32).astype(np.int64), join_blobs(table["n"], np.int64))
    return pa.table({"first": table["first"].slice(0, 1), "second": pa.array([second.astype(np.int32).tobytes()], pa.binary()), "n": pa.array([n.tobytes()], pa.binary())})


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, table: np.ndarray, twice: np.ndarray | None = None) -> np.ndarray:
    """The class each word should be in by the exchange criterion, all other words staying.

    left, right: counts beside each class (the start is the last column of left); own: present classes; table:
    class bigrams, with a row for the start; twice: counts of a word beside itself.
    """
    k, n = table.shape[1], len(own)
    left, right = left.astype(float), right.astype(float)  # counts of no pairs are whole numbers
    out = own.copy()
    twice = np.zeros(n) if twice is None else twice
    for i in range(0, n, 256):
        a, l_all, r = own[i : i + 256], left[i : i + 256], right[i : i + 256]
        me, self_n = np.arange(len(a)), twice[i : i + 256]
        l_other, r_other = l_all.copy(), r.copy()
        l_other[me, a] -= self_n
        r_other[me, a] -= self_n
        base = np.broadcast_to(table, (len(a), *table.shape)).copy()
        base[me, :, a] -= l_other
        base[me, a, :] -= r_other
        base[me, a, a] -= self_n
        col, row = base.sum(axis=1) + r_other, base.sum(axis=2)[:, :k] + l_other[:, :k]  # the word's other neighbours stay
        gain = (_x_log_x(base + l_other[:, :, None]) - _x_log_x(base)).sum(axis=1)  # column b takes the left counts
        gain += (_x_log_x(base[:, :k] + r_other[:, None, :]) - _x_log_x(base[:, :k])).sum(axis=2)
        d = np.arange(k)
        cell = base[:, d, d]
        gain += _x_log_x(cell + l_other[:, :k] + r_other + self_n[:, None]) - _x_log_x(cell + l_other[:, :k]) - _x_log_x(cell + r_other) + _x_log_x(cell)
        gain -= _x_log_x(col + l_all.sum(axis=1)[:, None]) - _x_log_x(col)
        gain -= _x_log_x(row + r.sum(axis=1)[:, None]) - _x_log_x(row)
        out[i : i + 256] = np.argmax(gain + 1e-9 * (d == a[:, None]), axis=1)
    return out


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the classes given the class before, and of the words given their class, less a constant."""
    return float(_x_log_x(table).sum() - _x_log_x(table.sum(axis=0)).sum() - _x_log_x(table.sum(axis=1)).sum())


def exchange(pairs: np.ndarray, weight: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Classes of the core words, moved one after another; each move raises the likelihood.

    pairs: counts of (word before, word), the start in the last row; weight: counts of the words.
    """
    f = len(weight)
    order = np.argsort(-weight, kind="stable")
    cls = np.empty(f + 1, np.int64)
    cls[order], cls[f] = np.arange(f) % k, k
    table = np.zeros((k + 1, k))
    np.add.at(table, (cls[:, None].repeat(f, 1), cls[:f][None, :].repeat(f + 1, 0)), pairs)
    for _ in range(rounds):
        moved = False
        for w in order:
            a, twice = cls[w], pairs[w, w]
            left, right = np.bincount(cls, weights=pairs[:, w], minlength=k + 1), np.bincount(cls[:f], weights=pairs[w], minlength=k)
            b = best_classes(left[None], right[None], cls[w : w + 1], table, np.array([twice]))[0]
            if b != a:
                left[a] -= twice
                right[a] -= twice
                for c, sign in ((a, -1), (b, 1)):
                    table[:, c] += sign * left
                    table[c] += sign * right
                    table[c, c] += sign * twice
                cls[w], moved = b, True
        if not moved:
            break
    return cls[:f]


_KNOWN = "bucket long, words binary, counts binary, classes binary"
_UNPLACED = 254


def _with_core(core: np.ndarray, cls: np.ndarray):
    """Buckets of counts with the classes of core words; all others are unplaced."""

    def run(batches):
        for batch in batches:
            classes = []
            for blob in batch.column(1).to_pylist():
                number = _number(core, np.frombuffer(blob, np.uint64))
                own = np.full(len(number), _UNPLACED, np.uint8)
                own[number >= 0] = cls[number[number >= 0]]
                classes.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(classes, pa.binary())], names=["bucket", "words", "counts", "classes"])

    return run


# A part is some documents of one task: a row of token numbers, and a row of its different words for each bucket.
# Its words are numbered by bucket and hash, so answers in the order of the buckets are in the order of numbers.
_PARTS = pa.schema([("bucket", pa.int64()), ("tag", pa.int64()), ("words", pa.binary()), ("index", pa.binary()), ("bounds", pa.binary()), ("own", pa.binary())])
_OWN = np.dtype([("id", np.int64), ("null", np.int8), ("held", np.int8)])


def _parts(n_buckets: int):
    def run(batches):
        partition, part, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, off = column_bytes(batch.column(1))
            ids, own = batch.column(0), np.zeros(batch.num_rows, _OWN)
            own["null"], own["id"], own["held"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in slices(off):
                held.append((*tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i]), own[i:j]))
                size += len(held[-1][0])
                if size >= _PART_TOKENS:
                    yield from flush(held, partition << 32 | part)
                    part, held, size = part + 1, [], 0
        if held:
            yield from flush(held, partition << 32 | part)

    def flush(held, tag):
        sizes = np.concatenate([np.diff(b) for _, b, _ in held])
        words, index = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
        bucket = (words % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        asked = blob_batch(bucket[order], pa.schema([_PARTS.field("bucket"), _PARTS.field("words")]), words=words[order])
        none = [pa.nulls(asked.num_rows, pa.binary())] * 3
        yield pa.RecordBatch.from_arrays([asked.column(0), pa.array([tag] * asked.num_rows, pa.int64()), asked.column(1), *none], schema=_PARTS)
        blob = lambda x: pa.array([squeeze(x)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([tag], pa.int64()), pa.nulls(1, pa.binary()), blob(place[index].astype(np.int32)), blob(np.concatenate([[0], np.cumsum(sizes)])), pa.array([np.concatenate([o for _, _, o in held]).tobytes()], pa.binary())], schema=_PARTS)

    return run


def _parted(docs: DataFrame, n_buckets: int) -> DataFrame:
    return stored(docs.mapInArrow(_parts(n_buckets), "bucket long, tag long, words binary, index binary, bounds binary, own binary"), "word-parts")


def _route(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Places of the words that each part asks for in their bucket, as steps."""
    words = join_blobs(known["words"], np.uint64)
    steps = [squeeze(np.diff(np.searchsorted(words, np.frombuffer(b, np.uint64)), prepend=0).astype(np.int32)) for b in asked["words"].to_pylist()]
    return pa.table({"bucket": asked["bucket"], "tag": asked["tag"], "steps": pa.array(steps, pa.binary())})


def _classes_at(routes: pa.Table, known: pa.Table) -> pa.Table:
    cls = join_blobs(known["classes"], np.uint8)
    found = [squeeze(cls[np.cumsum(stretch(b, np.int32))]) for b in routes["steps"].to_pylist()]
    return pa.table({"tag": routes["tag"], "bucket": routes["bucket"], "steps": routes["steps"], "classes": pa.array(found, pa.binary())})


_BESIDE = pa.schema([("bucket", pa.int64()), ("place", pa.binary()), ("beside", pa.binary()), ("n", pa.binary())])


def _weigh(k: int):
    """A part's class bigrams (bucket -1), and by bucket the counts of its words after each class (k: start), before
    each (k + 1 + class) and after themselves (2 k + 1)."""
    width = 2 * k + 2

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["bucket"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        cls = np.concatenate([stretch(b, np.uint8) for b in table["classes"].to_pylist()[1:]]).astype(np.int64)
        place = [np.cumsum(stretch(b, np.int32)) for b in table["steps"].to_pylist()[1:]]
        bucket = np.repeat(table["bucket"].to_numpy()[1:], [len(p) for p in place])
        place = np.concatenate(place)
        index, bounds = stretch(table["index"][0].as_py(), np.int32).astype(np.int64), stretch(table["bounds"][0].as_py(), np.int64)
        before, own = np.empty(len(index), np.int64), cls[index]
        before[1:], before[bounds[:-1]] = own[:-1], k
        after = np.full(len(index), _UNPLACED)
        inner = np.ones(len(index), bool)
        inner[bounds[:-1]] = False
        second = np.flatnonzero(inner)
        after[second - 1] = own[second]
        same = second[index[second] == index[second - 1]]
        left, right = before != _UNPLACED, after != _UNPLACED
        key = np.concatenate([index[left] * width + before[left], index[right] * width + k + 1 + after[right], index[same] * width + 2 * k + 1])
        if len(cls) * width < 2**32:  # sorts in half the time
            key = key.astype(np.uint32)
        key, n = np.unique(key, return_counts=True)
        both = left & (own != _UNPLACED)
        cells = np.bincount(before[both] * k + own[both], minlength=(k + 1) * k).astype(np.float64)
        word, code = key // width, (key % width).astype(np.uint8)
        cut = np.append(np.flatnonzero(np.diff(bucket[word], prepend=-1)), len(word)) if len(word) else np.zeros(1, np.int64)
        rows = [(int(bucket[word[a]]), squeeze(np.diff(place[word[a:b]], prepend=0).astype(np.int32)), squeeze(code[a:b]), squeeze(n[a:b].astype(np.int32))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip((-1, cells.tobytes(), None, None), *rows, strict=True), _BESIDE, strict=True)], schema=_BESIDE)

    return run


def _both(beside: pa.Table, size: int, width: int):
    """Counts of a bucket's words by neighbour code, a slice of words at a time."""
    rows = [(np.cumsum(stretch(p, np.int32)), stretch(c, np.uint8), stretch(n, np.int32)) for p, c, n in zip(*(beside[name].to_pylist() for name in ("place", "beside", "n")), strict=True)]
    for i in range(0, size, 20_000):
        j = min(i + 20_000, size)
        cuts = [np.searchsorted(at, [i, j]) for at, _, _ in rows]  # each row's places ascend
        key = np.concatenate([np.zeros(0, np.int64), *[(at[a:b] - i) * width + code[a:b] for (at, code, _), (a, b) in zip(rows, cuts, strict=True)]])
        out = np.bincount(key, weights=np.concatenate([np.zeros(0), *[n[a:b] for (_, _, n), (a, b) in zip(rows, cuts, strict=True)]]), minlength=(j - i) * width)
        yield i, j, out.reshape(j - i, width)


def _once(k: int):
    """Words seen once, by the class before."""

    def run(known: pa.Table, beside: pa.Table) -> pa.Table:
        single, once = join_blobs(known["counts"], np.int64) == 1, np.zeros(k + 1)
        for i, j, both in _both(beside, len(single), 2 * k + 2):
            once += both[single[i:j], : k + 1].sum(axis=0)
        return pa.table({"once": pa.array([once.tobytes()], pa.binary())})

    return run


def _move(table: np.ndarray, k: int, share: int, turn: int):
    """A bucket's words, with new classes for those whose turn it is and for unplaced ones.

    Words of at least ``EXACT`` tokens go by the exact change of the likelihood, others by its first order, which
    is near it for counts that are small beside those of classes.  An unplaced word without placed neighbours
    takes the class of its hash.
    """
    log = np.log(table + 0.5)
    after, size, lead = log[:k].T, np.log(table.sum(axis=0) + 0.5), np.log(table.sum(axis=1)[:k] + 0.5)

    def run(known: pa.Table, beside: pa.Table) -> pa.Table:
        words, counts, cls = join_blobs(known["words"], np.uint64), join_blobs(known["counts"], np.int64), join_blobs(known["classes"], np.uint8).copy()
        for i, j, both in _both(beside, len(words), 2 * k + 2):
            own, now = words[i:j], cls[i:j].astype(np.int64)
            left, right = both[:, : k + 1], both[:, k + 1 : 2 * k + 1]
            gain = left @ log + right @ after - left.sum(axis=1)[:, None] * size - right.sum(axis=1)[:, None] * lead
            best, new = np.argmax(gain, axis=1), now == _UNPLACED
            alone = new & (left.sum(axis=1) + right.sum(axis=1) == 0)
            best[alone] = (own[alone] >> U(17)) % U(k)
            me = (own >> U(40)) % U(share) == U(turn % share)
            rows = np.arange(len(own))
            move = new | (me & ~new & (gain[rows, best] > gain[rows, np.where(new, 0, now)] + 1e-9))
            exact = np.flatnonzero(me & ~new & (counts[i:j] >= EXACT))
            move[exact] = True
            best[exact] = best_classes(left[exact], right[exact], now[exact], table, both[exact, 2 * k + 1])
            cls[i:j][move] = best[move]
        return pa.table({"bucket": known["bucket"].slice(0, 1), "words": known["words"].slice(0, 1), "counts": known["counts"].slice(0, 1), "classes": pa.array([cls.tobytes()], pa.binary())})

    return run


def _drop(*tables: DataFrame) -> None:
    """Deletes stored tables that are not read again, and lets Spark drop the shuffles behind them."""
    spark = tables[0].sparkSession
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del tables
    gc.collect()
    spark._jvm.System.gc()


def settle(parts: DataFrame, known: DataFrame, k: int, total: int, rounds: int):
    """Places and exchanges all words by the bigrams of adjacent words until the likelihood settles.

    A turn moves one share of the words, at first a half; the likelihood is then counted anew, and a turn that
    lowers it is taken back and followed by turns of half its share.  It ends when two turns in a row gain less
    than ``SETTLED`` a token, or after ``rounds`` turns.
    """
    none = F.lit(None).cast("binary")
    asked = parts.where("bucket >= 0").select("bucket", "tag", "words")
    routes = stored(asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_route, "bucket long, tag long, steps binary"), "routes")
    numbers = parts.where("bucket < 0").select("tag", "bucket", none.alias("steps"), none.alias("classes"), "index", "bounds")

    def weigh(known):
        told = routes.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_classes_at, "tag long, bucket long, steps binary, classes binary")
        told = told.select("tag", "bucket", "steps", "classes", none.alias("index"), none.alias("bounds"))
        found = stored(told.unionByName(numbers).groupBy("tag").applyInArrow(_weigh(k), "bucket long, place binary, beside binary, n binary"), "beside")
        return found, _summed(found.where("bucket < 0"), "place", (k + 1) * k).reshape(k + 1, k)

    def moved(known, found, table, share, turn):
        pair = known.groupBy("bucket").cogroup(found.where("bucket >= 0").groupBy("bucket"))
        return stored(pair.applyInArrow(_move(table, k, share, turn), _KNOWN), "known-words")

    found, table = weigh(known)
    placed = moved(known, found, table, 1, 0)
    _drop(known, found)
    known, (found, table) = placed, weigh(placed)
    history, share, quiet = [likelihood(table)], 2, 0
    for turn in range(rounds if total else 0):
        tried = moved(known, found, table, share, turn)
        tried_found, tried_table = weigh(tried)
        gain = likelihood(tried_table) - history[-1]
        quiet = quiet + 1 if gain < SETTLED * total else 0
        if gain > 0:
            _drop(known, found)
            known, found, table = tried, tried_found, tried_table
            history.append(likelihood(table))
        else:
            _drop(tried, tried_found)
            share *= 2
        if quiet == 2:
            break
    pair = known.groupBy("bucket").cogroup(found.where("bucket >= 0").groupBy("bucket"))
    once = _summed(pair.applyInArrow(_once(k), "once binary"), "once", k + 1)
    _drop(found, routes, parts)
    return known, table, once, history


def _cells(batches):
    for batch in batches:
        total = 0
        for r in range(batch.num_rows):
            total = total + np.frombuffer(batch.column(0)[r].as_py(), np.float64)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])


def _summed(rows: DataFrame, name: str, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` numbers, by cell; the size is that of the classes' table."""
    out = np.zeros(size)
    for r in rows.select(name).mapInArrow(_cells, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


class Model:
    """The broadcast part of a trained model: its size doesn't grow with the corpus."""

    counts, cls = (), ()  # all words are in the table of known ones

    def __init__(self, table, once, total, kinds, k, mix):
        self.total, self.kinds, self.k, self.mix = total, kinds, k, mix
        self.class_size = np.maximum(table.sum(axis=0), 1.0)
        used = table.sum(axis=0) > 0  # a class without words takes no probability
        table, once = np.vstack([table, table.sum(axis=0)]), np.append(once, once.sum())  # after an unknown word: as after any
        seen = table.sum(axis=1)
        self.unknown = np.clip((once + 0.5) / (seen + 1.0), 1e-9, 0.9)
        self.follow = (table + 0.5 * used) / np.maximum(seen + 0.5 * used.sum(), 0.5)[:, None] * (1 - self.unknown)[:, None]

    def base(self, n):
        return (n + 1.0) / (self.total + self.kinds + 1.0)

    def known_word(self, before, n, cls):
        """log10 probability of words with counts n and classes after the classes before."""
        return np.log10(self.mix * self.follow[before, cls] * n / self.class_size[cls] + (1 - self.mix) * self.base(n))

    def unknown_word(self, before):
        return np.log10(self.mix * self.unknown[before] + (1 - self.mix) * self.base(0.0))


def _tell(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Counts and classes of the words asked for; words that aren't known have the count 0."""
    words, n, cls = join_blobs(known["words"], np.uint64), join_blobs(known["counts"], np.int64), join_blobs(known["classes"], np.uint8)
    counts, classes = [], []
    for blob in asked["words"].to_pylist():
        found = _number(words, np.frombuffer(blob, np.uint64))
        ok = found >= 0
        c, k = np.zeros(len(found), np.int64), np.zeros(len(found), np.uint8)
        c[ok], k[ok] = n[found[ok]], cls[found[ok]]
        counts.append(squeeze(c))
        classes.append(squeeze(k))
    return pa.table({"tag": asked["tag"], "bucket": asked["bucket"], "counts": pa.array(counts, pa.binary()), "classes": pa.array(classes, pa.binary())})


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _score(model: Model):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table["bucket"].to_numpy(), kind="stable")))
        counts, cls = (np.concatenate([stretch(b, t) for b in table[c].to_pylist()[1:]]) for c, t in (("counts", np.int64), ("classes", np.uint8)))
        index, bounds = stretch(table["index"][0].as_py(), np.int32), stretch(table["bounds"][0].as_py(), np.int64)
        own = np.frombuffer(table["own"][0].as_py(), _OWN)
        before = np.empty(len(index), np.int64)
        before[1:] = np.where(counts > 0, cls, model.k + 1)[index[:-1]]  # unknown: k + 1
        before[bounds[:-1]] = model.k
        doc, n = np.repeat(np.arange(len(own)), np.diff(bounds)), counts[index]
        score = np.where(n > 0, model.known_word(before, np.maximum(n, 1), cls[index]), model.unknown_word(before))
        size, known, base, score = (np.bincount(doc, weights=x, minlength=len(own)) for x in (np.ones(len(n)), n > 0, np.log10(model.base(n)), score))
        columns = [pa.array(own["id"], mask=own["null"] == 1), pa.array(own["held"] == 1), pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(own), model.total, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / size))]
        return pa.table(columns, names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def train(docs: DataFrame, text: str = "text", k: int = CLASSES, rounds: int = ROUNDS, mix: float = MIX) -> tuple[Model, DataFrame, int]:
    """The model of all of docs, the table of its words by bucket, and the number of buckets.

    Null texts are empty and count their end; repeated rows count as often as they occur; without documents
    every word is unknown.  Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(text_of(F.col(text)).alias("text"))
    n_buckets = buckets_for(rows, "text", BUCKET_BYTES)
    binary = lambda *names: ", ".join(f"{n} binary" for n in names)
    counts = rows.mapInArrow(_count(n_buckets), f"bucket long, {binary('words', 'counts')}").groupBy("bucket").applyInArrow(_sum_counts, f"bucket long, {binary('words', 'counts')}, total long, kinds long")
    counts = stored(counts, "word-counts")
    size = counts.agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds = size[0] or 0, size[1] or 0
    least = max(2.0, CORE * total)

    def often(batches):
        for batch in batches:
            words, n = join_blobs(batch.column(0), np.uint64), join_blobs(batch.column(1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words[n >= least].view(np.int64)), pa.array(n[n >= least])], names=["word", "n"])

    top = counts.select("words", "counts").mapInArrow(often, "word long, n long").toArrow()  # at most 1 / CORE rows
    core, weight = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(core)
    core, weight = core[order], weight[order]
    rest = rows.mapInArrow(_core_pairs(core), f"first long, {binary('second', 'n')}").groupBy("first").applyInArrow(_sum_pairs, f"first long, {binary('second', 'n')}")
    pairs = np.zeros((len(core) + 1, len(core)))
    for r in rest.collect():  # core words squared at most
        pairs[r["first"], np.frombuffer(r["second"], np.int32)] = np.frombuffer(r["n"], np.int64)
    cls = exchange(pairs, weight, k, rounds)
    known = stored(counts.select("bucket", "words", "counts").mapInArrow(_with_core(core, cls), _KNOWN), "known-words")
    _drop(counts)
    parts = _parted(rows.select(F.lit(None).cast("long").alias("id"), "text", F.lit(False).alias("held")), n_buckets)
    known, table, once, history = settle(parts, known, k, total, rounds)
    model = Model(table, once, total, kinds, k, mix)
    model.history = history
    return model, known, n_buckets


def perplexities(docs: DataFrame, trained, doc_id: str = "doc_id", text: str = "text", held: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row of docs.

    Null texts are empty and score their end token; null ids stay null; each of repeated rows is scored; an empty
    table gives an empty table; other columns are not read, whatever their names.
    """
    model, known, n_buckets = trained
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(F.col(text)).alias("text"), (F.lit(False) if held is None else held).alias("held"))
    parts, none = _parted(rows, n_buckets), F.lit(None).cast("binary")
    told = parts.where("bucket >= 0").select("bucket", "tag", "words").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_tell, "tag long, bucket long, counts binary, classes binary")
    numbers = parts.where("bucket < 0").select("tag", "bucket", none.alias("counts"), none.alias("classes"), "index", "bounds", "own")
    told = told.select("tag", "bucket", "counts", "classes", *[none.alias(n) for n in ("index", "bounds", "own")])
    return told.unionByName(numbers).groupBy("tag").applyInArrow(_score(model), _SCORED).withColumnRenamed("doc_id", doc_id)


def op6_brown_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"))
    return perplexities(docs, train(docs.where(~held)), held=held).drop("perplexity")
