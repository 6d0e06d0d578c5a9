"""SentencePiece encoding and decoding with N-best segmentation.

A text's piece lattice has an edge for every piece of the model that spells a part of it, the space and its runs
with their very low scores too; a character without a
piece of its own has one edge of byte pieces.  Forward Viterbi gives each place's best score from the start,
which is the exact cost left to a search that comes from the end: backward A-star therefore leaves the lattice
with whole segmentations in order of their scores.

A segmentation's score is the sum of its pieces' scores in the model file, as the library adds them for the
models that it searches.  The default model is one of merges: its scores are negative merge ranks, not
log-probabilities, so the best segmentation has the least sum of ranks and need not be the one that the library
gets by merging (of the different words of a sample it is the same for about half).  A model of log-probabilities
can be given as ``model``; the search is the same.

Two bytes that stand side by side in no piece, as a letter before a space do, cut the lattice: no edge crosses
them, so the lattice of a text is a chain of lattices of short words.  Each different word is searched once while
it is kept; the N best segmentations of a text are then found by the same search over the losses of its words'
alternatives.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import prepare, text_of
from .textkit import column_bytes, ranges, slices, span_hashes

BEST = 4
SPACE = "▁"
#: Score of a byte piece below the least of all pieces, as the reference implementation takes for unknown ones.
BYTE_PENALTY = 10.0
_CACHED_WORDS = 1_200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Pieces and scores of a model, and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes, self.spell = {}, [0] * 256, []
        for i in range(model.vocab_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.spell.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.spell.append(b"")
            else:
                self.spell.append(piece.replace(SPACE, " ").encode())
                self.pieces[piece.replace(SPACE, " ")] = (score, i)
        self.low = min(s for s, _ in self.pieces.values()) - BYTE_PENALTY
        # Pieces, and their beginnings without a piece as False: a miss ends the search for longer ones.
        self.table = {p[:k]: False for p in self.pieces for k in range(1, len(p))} | {p: (s, (i,)) for p, (s, i) in self.pieces.items()}
        # Whether two bytes stand side by side in a piece; all bytes of longer characters are one kind.
        self.inside = np.zeros((129, 129), bool)
        self.inside[128, 128] = True
        for p in self.pieces:
            b = np.minimum(np.frombuffer(p.encode(), np.uint8), 128)
            self.inside[b[:-1], b[1:]] = True

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place, the edges that end there: start, score, ids."""
        n, look = len(text), self.table.get
        out: list[list] = [[] for _ in range(n + 1)]
        for start in range(n):
            end = start + 1
            found = look(text[start:end])
            if not found:  # no piece of its own
                data = text[start:end].encode("utf-8", "surrogatepass")
                out[end].append((start, self.low * len(data), tuple(self.bytes[b] for b in data)))
            while found is not None:
                if found:
                    out[end].append((start, *found))
                end += 1
                if end > n:
                    break
                found = look(text[start:end])
        return out

    def n_best(self, text: str, n: int = BEST) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first; equal scores in the order of the search."""
        edges = self.edges(text)
        best = [0.0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            best[end] = max(best[start] + score for start, score, _ in edges[end])
        out, tie = [], 0
        queue = [(-best[-1], 0, len(text), 0.0, None)]
        while queue and len(out) < n:
            _, _, place, score, path = heapq.heappop(queue)
            if not place:
                ids = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((score, tuple(ids)))
                continue
            for start, gain, ids in edges[place]:
                tie -= 1
                heapq.heappush(queue, (-(score + gain + best[start]), tie, start, score + gain, (ids, path)))
        return out


def chain_n_best(losses: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least sums of one loss a row, the first of each row being 0: sum, and (row, column) of what isn't first.

    A row whose least loss is not among the n - 1 least of all takes no part.  The rest is searched as a
    chain, in ascending order of the sums; the bound that is left is 0, which is exact.
    """
    if n == 1 or not len(losses):
        return [(0.0, ())]
    least = losses[:, 1]
    rows = np.argsort(least, kind="stable")[: n - 1]
    rows = rows[np.isfinite(least[rows])]
    out, queue, tie = [], [(0.0, 0, 0, ())], 0
    while queue and len(out) < n:
        total, _, k, taken = heapq.heappop(queue)
        out.append((total, taken))
        for m in range(k, len(rows)):  # take an alternative in one more, later row
            for c in range(1, losses.shape[1]):
                if np.isfinite(losses[rows[m], c]):
                    tie += 1
                    heapq.heappush(queue, (total + float(losses[rows[m], c]), tie, m + 1, (*taken, (int(rows[m]), c))))
    return out


class Words:
    """Segmentations of words, each searched once while it is kept."""

    _held: dict[tuple[str, int], Words] = {}

    @classmethod
    def of(cls, path: str, n: int) -> Words:
        if (path, n) not in cls._held:
            cls._held[path, n] = cls(path, n)
        return cls._held[path, n]

    def __init__(self, path: str, n: int):
        self.lattice, self.n = Lattice(path), n
        self.spell_bounds = np.cumsum([0, *map(len, self.lattice.spell)])
        self.spell = np.frombuffer(b"".join(self.lattice.spell), np.uint8)
        self.forget()

    def forget(self):
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.score, self.losses = np.zeros(0), np.zeros((0, self.n))
        self.bounds, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def look_up(self, hashes: np.ndarray, text) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.hashes) + len(new) > _CACHED_WORDS and len(self.hashes):
                self.forget()
                return self.look_up(hashes, text)
            found = [self.lattice.n_best(text(k), self.n) for k in new]
            # Segmentation c of word w has bounds w * n + c.
            self.losses = np.concatenate([self.losses, [[f[0][0] - f[c][0] if c < len(f) else np.inf for c in range(self.n)] for f in found]])
            self.score = np.concatenate([self.score, [f[0][0] for f in found]])
            ids = [f[c][1] if c < len(f) else () for f in found for c in range(self.n)]
            place = len(self.place) + np.arange(len(new))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int32)])
            self.hashes, self.place = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.place, at[new], place)
            at = np.searchsorted(self.hashes, hashes)
        return self.place[at]

    def ids(self, word: np.ndarray, column=0):
        """Ids of each word's segmentation, concatenated, and their bounds."""
        k = word * self.n + column
        n = self.bounds[k + 1] - self.bounds[k]
        return self.flat[ranges(self.bounds[k], n)], np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.spell_bounds[ids + 1] - self.spell_bounds[ids]
        return self.spell[ranges(self.spell_bounds[ids], n)]


def split_words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray):
    """Words, which no piece crosses: starts and ends, and each text's first."""
    kind = np.minimum(buf, 128)
    new = np.ones(len(buf), bool)
    new[1:] = ~inside[kind[:-1], kind[1:]]
    new[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, off)


_ENCODED = "doc_id long, n_pieces long, score double, ids_crc32 long, n_best int, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"


def _encode(path: str, n: int, with_ids: bool):
    def run(batches):
        words = Words.of(path, n)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            whole, whole_off = column_bytes(batch.column(1))
            for i, j in slices(whole_off, 1 << 20):
                size = np.diff(whole_off[i : j + 1])
                first = (whole_off[i : j] - whole_off[i])[size > 0]
                buf = np.insert(whole[whole_off[i] : whole_off[j]], first, 0x20)  # the space that the model puts first
                off = np.concatenate([[0], np.cumsum(size + (size > 0))])
                starts, ends, bounds = split_words(buf, off, words.lattice.inside)
                h = np.empty(len(starts), np.uint64)
                for a, b in slices(off):
                    x, y = bounds[a], bounds[b]
                    h[x:y] = span_hashes(buf[off[a] : off[b]], starts[x:y] - off[a], ends[x:y] - off[a])
                unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
                word = words.look_up(unique, lambda k: buf[starts[where[k]] : ends[where[k]]].tobytes().decode("utf-8", "replace"))[inverse]  # noqa: B023
                ids, per_word = words.ids(word)
                decoded = words.decode(ids)
                spelled = np.concatenate([[0], np.cumsum(words.spell_bounds[ids + 1] - words.spell_bounds[ids])])
                rows = []
                for d in range(j - i):
                    a, b = bounds[d], bounds[d + 1]
                    own = ids[per_word[a] : per_word[b]]
                    score = float(words.score[word[a:b]].sum())
                    alternatives = chain_n_best(words.losses[word[a:b]], n)
                    crcs = []
                    for _, taken in alternatives:
                        crc, last = 0, a
                        for row, column in sorted(taken):
                            crc = zlib.crc32(ids[per_word[last] : per_word[a + row]].astype("<u4").tobytes(), crc)
                            crc = zlib.crc32(words.ids(word[a + row : a + row + 1], column)[0].astype("<u4").tobytes(), crc)
                            last = a + row + 1
                        crcs.append(zlib.crc32(ids[per_word[last] : per_word[b]].astype("<u4").tobytes(), crc))
                    same = np.array_equal(decoded[spelled[per_word[a]] : spelled[per_word[b]]], buf[off[d] : off[d + 1]])
                    rows.append((names[at], len(own), score, crcs[0], len(alternatives), [score - x for x, _ in alternatives], crcs, same, *([own.tolist()] if with_ids else [])))
                    at += 1
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), *([pa.list_(pa.int32())] if with_ids else [])]
                labels = [x.split()[0] for x in _ENCODED.split(", ")] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=labels)

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, n: int = BEST, with_ids: bool = False) -> DataFrame:
    """The n best segmentations of each row's text: scores and checksums of the ids, best first; ``ids`` if asked.

    A space is put before a text that isn't empty and goes again in decoding; ``round_trip`` says that the best
    ids spell the text.  Null texts are empty: no pieces, one segmentation of score 0.  Null ids stay null,
    repeated rows are encoded as often as they occur, an empty table gives an empty table, and texts of any
    length are encoded whole.  Other columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    return rows.mapInArrow(_encode(model or default_model(), n, with_ids), _ENCODED + ", ids array<int>" * with_ids).withColumnRenamed("doc_id", doc_id)


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """rows with ``decoded``, the text that the ids spell, without the space put first; malformed bytes are replaced.

    Null ids give null.  All other columns stay; a column that is called ``decoded`` already is replaced.
    """
    path = model or default_model()
    schema = rows.withColumn("decoded", F.lit("")).schema
    at = rows.columns.index(ids)

    def run(batches):
        words = Words.of(path, BEST)
        for batch in batches:
            texts = [None if x is None else words.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace").removeprefix(" ") for x in batch.column(at).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, schema)


def op10_nbest_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
