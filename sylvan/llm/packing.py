"""Lexical retrieval packing.

Documents are dealt to shards, and each shard has a BM25 inverted index of its words, whose document counts and
mean length are those of all documents.  The unused neighbours that the index returns for a window's seed
document fill the window, best first; the document that crosses the window's end is cut and its rest is the
seed of the next window, also across shards, so that only the last window of a task can be short.  That one is
split at powers of two, which need no padding.

Documents that share rare words are dealt to the same shard wherever they stand: a document's key is the one of
its words that wins a race by hashes and inverse document frequencies (weighted MinHash), so two documents meet
with the weighted Jaccard similarity of their words as probability.  Words in more documents than a quarter of a
task's are no keys, so no key is hot; a document without a key is dealt by its id.  A seed does not see the
documents of other shards: the dealing, not the file order, decides what it can retrieve.

Document counts are kept in ``SLOTS`` slots of word hashes, a table whose size does not grow.  Words that share
a slot add up: with D different words a document on average the expected excess is D / SLOTS of all documents.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import buckets, prepare, text_of
from .textkit import EXACT_VALUES, FOLD, U, blob_batch, column_bytes, mix, ranges, slices, span_hashes, squeeze, stretch, word_spans

WINDOW, END_ID = 4096, 2
SHARD_DOCS, SHARD_BYTES = 1024, 3_000_000
SLOTS = 1 << 21
_SLOT_BUCKETS = 8
#: Bytes of text for each task that packs.
TASK_BYTES = 64_000_000
K1, B = 1.2, 0.75
_CACHED_WORDS = 1_000_000
_JOINED = 1000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The normaliser and splitter with which a text's ids are its words' ids, and ASCII words lower-cased are plain.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordIds:
    """Token ids of words between white space, each tokenised once while it is kept.

    A tokenizer with the parts ``_BY_WORDS`` drops white space and never joins across it, so a text's ids are its
    words' ids, and plain words skip its normaliser and splitter; the test suite compares both ways.  For any
    other tokenizer ``by_words`` is false and whole texts are to be tokenised.
    """

    _held: dict[str, WordIds] = {}

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel units
        from tokenizers import Tokenizer, pre_tokenizers

        self.full, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        parts = json.loads(self.full.to_str())
        self.by_words = all(parts.get(k) == v for k, v in _BY_WORDS.items())
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = parts["model"].get("end_of_word_suffix") or ""
        self.ends_word = np.zeros(self.full.get_vocab_size() + 1, bool)
        self.ends_word[[i for piece, i in self.full.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        special = [t["content"] for t in parts["added_tokens"] if t["special"]]
        self.by_words &= bool(suffix) and bool(special)
        self.mark = special[0] if special else None
        self.forget()

    def forget(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of the words that are these spans of bytes, and how many each has.

        Many words are encoded as one text: plain ones, lower-cased, between spaces, where each is one run of
        tokens up to the one that ends a word; others between marks.
        """
        after = np.append(False, buf[:-1] == 0xC3) & (buf >= 0x80) & (buf <= 0xBF) & (buf != 0x97) & (buf != 0xB7)
        letter = _LETTER[buf] | after | np.append(after[1:], False)
        lower = FOLD.astype(np.uint8)[buf]
        lower[after & (buf <= 0x9E)] += 0x20  # À to Þ
        other = np.concatenate([[0], np.cumsum(~letter)])
        tail = (ends - starts > 1) & ((buf[ends - 1] == 0x2C) | (buf[ends - 1] == 0x2E))
        stop = ends - tail
        plain = np.flatnonzero(other[stop] == other[starts])
        size = stop[plain] - starts[plain] + 1
        text = np.full(int(size.sum()), 0x20, np.uint8)
        text[ranges(np.cumsum(size) - size, size - 1)] = lower[ranges(starts[plain], size - 1)]
        cut = np.concatenate([[0], np.cumsum(size)])[np.append(np.arange(0, len(plain), _JOINED), len(plain))]
        flat = lambda coder, texts: np.array([i for e in coder.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        ids = flat(self.plain, [text[a:b].tobytes().decode() for a, b in zip(cut[:-1], cut[1:], strict=True)])
        last = np.flatnonzero(self.ends_word[ids])
        count = np.diff(last, prepend=-1)
        marks = {m: np.array(self.full.encode(chr(m), add_special_tokens=False).ids, np.int32) for m in (0x2C, 0x2E)}
        for m, own in marks.items():
            own_tail = tail[plain] & (buf[ends[plain] - 1] == m)
            at = (np.cumsum(count) - 1)[own_tail] + 1
            ids = np.insert(ids, np.repeat(at, len(own)), np.tile(own, len(at)))
            count = count + own_tail * len(own)
        rest = np.setdiff1d(np.arange(len(starts)), plain)
        words = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(starts[rest], ends[rest], strict=True)]
        marked = [w for w in words if "<|" not in w]
        got = flat(self.full, [self.mark.join(marked[i : i + _JOINED]) + self.mark for i in range(0, len(marked), _JOINED)])
        at = np.flatnonzero(got == self.full.token_to_id(self.mark))
        found = iter([got[a:b] for a, b in zip(np.append(0, at + 1)[:-1], at, strict=True)])
        others = [next(found) if "<|" not in w else np.array(self.full.encode(w, add_special_tokens=False).ids, np.int32) for w in words]  # "<|" may begin a special token
        sizes = np.empty(len(starts), np.int64)
        sizes[plain], sizes[rest] = count, [len(x) for x in others]
        begin = np.empty(len(starts), np.int64)
        begin[np.concatenate([plain, rest])] = np.cumsum(np.append(0, sizes[np.concatenate([plain, rest])]))[:-1]
        return np.concatenate([ids, *others])[ranges(begin, sizes)], sizes

    def look_up(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of each of the ascending hashes into bounds; the spans are the words."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > _CACHED_WORDS and len(self.hashes):
                self.forget()
                return self.look_up(hashes, buf, starts, ends)
            ids, sizes = self._encode(buf, starts[new], ends[new])
            place = len(self.bounds) - 1 + np.arange(len(new))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
            where = at[new]
            self.hashes, self.place = np.insert(self.hashes, where, hashes[new]), np.insert(self.place, where, place)
            at = np.searchsorted(self.hashes, hashes)
        return self.place[at]


def word_hashes(buf: np.ndarray, off: np.ndarray):
    """Hashes, starts and ends of each document's words, and the bounds of each document's."""
    starts, ends, first = word_spans(buf, off, _SPACE)
    h = np.empty(len(starts), np.uint64)
    for a, b in slices(off):
        x, y = first[a], first[b]
        h[x:y] = span_hashes(buf[off[a] : off[b]], starts[x:y] - off[a], ends[x:y] - off[a], EXACT_VALUES)
    return h, starts, ends, first


def tokenise(words: WordIds, buf: np.ndarray, off: np.ndarray):
    """Ids of each document, its end last; bounds of each document's; word hashes and bounds for the index."""
    flat, sizes, terms, term_bounds = [], [], [], [np.zeros(1, np.int64)]
    done = 0
    for i, j in slices(off, 1 << 21):
        part, inner = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        h, starts, ends, first = word_hashes(part, inner)
        if words.by_words:
            order = np.argsort(h)
            new = np.append(True, h[order[1:]] != h[order[:-1]]) if len(h) else np.zeros(0, bool)
            at, inverse = order[new], np.empty(len(h), np.int64)
            unique, inverse[order] = h[at], np.cumsum(new) - 1
            place = words.look_up(unique, part, starts[at], ends[at])[inverse]
            n = words.bounds[place + 1] - words.bounds[place]
            own, total = words.flat[ranges(words.bounds[place], n)], np.concatenate([[0], np.cumsum(n)])[first]
        else:
            texts = [part[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(inner[:-1], inner[1:], strict=True)]
            found = [e.ids for e in words.full.encode_batch_fast(texts, add_special_tokens=False)]
            own, total = np.array([x for ids in found for x in ids], np.int32), np.cumsum([0, *map(len, found)])
        flat.append(np.insert(own, total[1:], END_ID))
        sizes.append(np.diff(total) + 1)
        terms.append(h)
        term_bounds.append(first[1:] + done)
        done += len(h)
    sizes = np.concatenate([np.zeros(1, np.int64), *sizes])
    return np.concatenate([np.zeros(0, np.int32), *flat]), np.cumsum(sizes), np.concatenate([np.zeros(0, np.uint64), *terms]), np.concatenate(term_bounds)


def _distinct(h: np.ndarray, first: np.ndarray):
    """Each document's different slots: document and slot, ascending."""
    key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * SLOTS + (h & U(SLOTS - 1)).astype(np.int64)
    key = np.sort(key.astype(np.uint32) if (len(first) - 1) * SLOTS < 2**32 else key)
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key // SLOTS).astype(np.int64), (key % SLOTS).astype(np.int64)


class Statistics:
    """Of all documents: number, mean words, and how many have a word of each slot."""

    def __init__(self, n: int, mean: float, df: np.ndarray, size: int = 0):
        self.n, self.mean, self.df, self.size = n, mean, df, size
        self._races = {}

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def races(self, most: int):
        """A name for each slot, and its time in the race: infinite unless 2 to ``most`` documents have it."""
        if most not in self._races:
            name = mix(np.arange(SLOTS).astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(1))
            time = -np.log((name >> U(11)).astype(np.float64) / 2**53 + 2.0**-54)
            fit = (self.df > 1) & (self.df <= most)
            time[fit] /= self.idf(self.df[fit]) ** 2
            time[~fit] = np.inf
            self._races[most] = name, time
        return self._races[most]


_SEEN = pa.schema([("bucket", pa.int64()), ("slots", pa.binary()), ("n", pa.binary()), ("docs", pa.int64()), ("words", pa.int64()), ("size", pa.int64())])


def _seen(batches):
    df, docs, words, size, held, waiting = np.zeros(SLOTS, np.int64), 0, 0, 0, [], 0
    for batch in batches:
        buf, off = column_bytes(batch.column(0))
        for i, j in slices(off, 1 << 20):
            h, _, _, first = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            held.append(_distinct(h, first)[1])
            docs, words, size, waiting = docs + j - i, words + len(h), size + int(off[j] - off[i]), waiting + len(held[-1])
            if waiting > 2 * SLOTS:
                df += np.bincount(np.concatenate(held), minlength=SLOTS)
                held, waiting = [], 0
    df += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=SLOTS)
    for k in range(_SLOT_BUCKETS):
        part = df[k * SLOTS // _SLOT_BUCKETS : (k + 1) * SLOTS // _SLOT_BUCKETS]
        at = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([squeeze(np.diff(at, prepend=0).astype(np.int32))]), pa.array([squeeze(part[at])]), *[pa.array([x if not k else 0]) for x in (docs, words, size)]], schema=_SEEN)


def _sum_seen(table: pa.Table) -> pa.Table:
    total = np.zeros(SLOTS // _SLOT_BUCKETS, np.int64)
    for slots, n in zip(table["slots"], table["n"], strict=True):
        total[np.cumsum(stretch(slots.as_py(), np.int32))] += stretch(n.as_py(), np.int64)
    return pa.table({"bucket": table["bucket"].slice(0, 1), "df": pa.array([squeeze(total)]), **{c: pa.array([sum(table[c].to_pylist())]) for c in ("docs", "words", "size")}})


def statistics(rows: DataFrame) -> Statistics:
    """Counts over all rows; the table of SLOTS numbers comes to the driver."""
    kinds = "bucket long, slots binary, n binary, docs long, words long, size long"
    parts = {r["bucket"]: r for r in rows.select("text").mapInArrow(_seen, kinds).groupBy("bucket").applyInArrow(_sum_seen, "bucket long, df binary, docs long, words long, size long").collect()}
    if not parts:
        return Statistics(0, 1.0, np.zeros(SLOTS, np.int64))
    docs = parts[0]["docs"]
    return Statistics(docs, parts[0]["words"] / max(1, docs), np.concatenate([stretch(parts[k]["df"], np.int64) for k in range(_SLOT_BUCKETS)]), parts[0]["size"])


def shard_keys(known: Statistics, most: int, ids: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each document's key: of its words that 2 to ``most`` documents have, the winner of the weighted race."""
    keys = mix(ids.astype(np.int64).view(np.uint64) ^ U(0xA5A5A5A5A5A5A5A5))
    name, time = known.races(most)
    for i, j in slices(off, 1 << 20):
        h, _, _, first = word_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        doc, slot = _distinct(h, first)
        own = time[slot]
        begin = np.flatnonzero(np.diff(doc, prepend=-1))
        least = np.minimum.reduceat(own, begin) if len(own) else own
        won = np.flatnonzero((own == np.repeat(least, np.diff(np.append(begin, len(own))))) & np.isfinite(own))
        keys[i + doc[won]] = name[slot[won]]
    return keys.view(np.int64)


def _deal(shared, most: int):
    def run(batches):
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(shard_keys(shared.value, most, ids, buf, off)), *batch.columns], names=["key", "doc_id", "text"])

    return run


class Index:
    """BM25 inverted index of a shard: for each term, the documents that have it and their weights."""

    def __init__(self, terms: np.ndarray, bounds: np.ndarray, known: Statistics):
        self.n = len(bounds) - 1
        names, term = np.unique(terms, return_inverse=True)
        doc = np.repeat(np.arange(self.n), np.diff(bounds))
        pair, tf = np.unique(term * np.int64(self.n) + doc, return_counts=True)
        self.docs = pair % max(1, self.n)
        term = pair // max(1, self.n)
        self.bounds = np.searchsorted(term, np.arange(len(names) + 1))
        df = np.diff(self.bounds)
        idf = known.idf(known.df[(names & U(SLOTS - 1)).astype(np.int64)])
        norm = K1 * (1 - B + B * np.diff(bounds) / max(known.mean, 1e-9))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.docs])
        # Each document's query: all its terms that others have too.
        shared = np.flatnonzero(df[term] > 1)
        order = shared[np.argsort(self.docs[shared], kind="stable")]
        self.query = term[order]
        self.query_bounds = np.searchsorted(self.docs[order], np.arange(self.n + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, by BM25 over all its terms, best first (ties: the first)."""
        terms = self.query[self.query_bounds[seed] : self.query_bounds[seed + 1]]
        at = ranges(self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms])
        score = np.bincount(self.docs[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill_order(index: Index, sizes: np.ndarray, room: int) -> np.ndarray:
    """The order in which a shard's documents fill windows; ``room`` is left in the first window."""
    unused, out, nxt = np.ones(len(sizes), bool), [], 0
    seed = None
    while len(out) < len(sizes):
        if seed is None:
            while not unused[nxt]:
                nxt += 1
            seed = nxt
            unused[seed] = False
            out.append(seed)
            room -= sizes[seed]
        near = iter(index.neighbours(seed, unused)) if room > 0 else iter(())
        last = seed
        while room > 0:
            d = next(near, None)
            if d is None:
                break
            unused[d] = False
            out.append(int(d))
            room -= sizes[d]
            last = int(d)
        if room > 0:
            seed = None  # no neighbour left: the window goes on with the next document
        else:
            room = WINDOW - (-room) % WINDOW  # the rest of the last document is the next seed
            seed = last if room < WINDOW else None
    return np.array(out, np.int64)


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Packer:
    """Lays documents one after another into windows of a task."""

    def __init__(self, task: int):
        self.first, self.sequence, self.used, self.open = task << 32, 0, 0, []

    def room(self) -> int:
        return WINDOW - self.used

    def add(self, doc_id, ids: np.ndarray):
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.room())
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            self.used, at = self.used + n, at + n
            if self.used == WINDOW:
                yield from self._close()

    def _close(self):
        offset = 0
        for doc_id, start, ids, total in self.open:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.first | self.sequence, offset
            offset += len(ids)
        self.open, self.used, self.sequence = [], 0, self.sequence + 1

    def finish(self):
        """The last window as sequences of powers of two, longest first."""
        left, total = self.open, self.used
        for size in (1 << k for k in range(WINDOW.bit_length() - 1, -1, -1)):
            if total & size:
                self.open, room = [], size
                while room:
                    doc_id, start, ids, whole = left.pop(0)
                    self.open.append((doc_id, start, ids[:room], whole))
                    if len(ids) > room:
                        left.insert(0, (doc_id, start + room, ids[room:], whole))
                    room -= min(room, len(ids))
                yield from self._close()
        self.open, self.used = [], 0


def _pack(tokenizer: str, shared):
    def table(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(_PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    def shard(words, packer, held):
        names = [x for batch in held for x in batch.column(1).to_pylist()]
        buf, off = column_bytes(pa.chunked_array([batch.column(2) for batch in held]))
        ids, bounds, terms, term_bounds = tokenise(words, buf, off)
        order = fill_order(Index(terms, term_bounds, shared.value), np.diff(bounds), packer.room())
        return [row for d in order for row in packer.add(names[d], ids[bounds[d] : bounds[d + 1]])]

    def run(batches):
        words, packer = WordIds.of(tokenizer), Packer(TaskContext.get().partitionId())
        held, docs, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs, size = docs + batch.num_rows, size + batch.column(2).nbytes
            if docs >= SHARD_DOCS or size >= SHARD_BYTES:
                yield table(shard(words, packer, held))
                held, docs, size = [], 0, 0
        if held:
            yield table(shard(words, packer, held))
        yield table(list(packer.finish()))

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Null texts are empty, and an empty text is the end token alone; null ids stay null and repeated rows are
    packed as often as they occur.  Texts of any length are cut at windows; a shard is closed once it has
    SHARD_DOCS rows or SHARD_BYTES.  An empty table has no pieces; other columns are not read, whatever their
    names.  Ties in a neighbour's score go by key and id.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    known = statistics(rows)
    tasks = max(buckets(spark, 1), -(-known.size // TASK_BYTES))
    shared = spark.sparkContext.broadcast(known)  # SLOTS numbers, whatever the input
    dealt = rows.mapInArrow(_deal(shared, max(16, known.n // tasks // 4)), "key long, doc_id long, text string").repartition(tasks, "key").sortWithinPartitions("key", "doc_id", "text")
    kinds = ", ".join(f"`{f.name}` long" for f in _PIECES)
    return dealt.mapInArrow(_pack(tokenizer or default_tokenizer(), shared), kinds).withColumnRenamed("doc_id", doc_id)


def op9_retrieval_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
