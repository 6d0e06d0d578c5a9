"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its words' weights; a document is
toxic unless all its sentences are not: p = 1 - prod(1 - p_sentence), the noisy-or.  Weights are trained from
document labels alone, so that the model also finds the sentences that make a document toxic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import prepare, stored, text_of
from .textkit import FOLDED_VALUES, U, blob_batch, column_bytes, join_blobs, mix, slices, span_hashes, squeeze, stretch, word_spans

#: Most labelled documents of each label that the model is fitted on, chosen by a hash of their ids.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 5000
#: A document with at least this score is toxic.
REJECT = 0.7
#: Fewest training documents that a feature with a weight stands in, and by how many standard errors its share
#: of toxic documents must differ from its share of clean ones.
LEAST_DOCS, LEAST_Z = 4, 4.0
#: Beginnings of words, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)
_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n\r"]] = True


@dataclass
class Model:
    words: np.ndarray  # ascending hashes
    weights: np.ndarray
    bias: float


def sentence_words(buf: np.ndarray, off: np.ndarray):
    """Each word's features (its hash and those of its beginnings, 0 where it has none), its sentence, and each document's first word and first sentence (n + 1 each).

    Sentences end at ``. ! ?`` and line ends; only those with words count.
    """
    starts, ends, first = word_spans(buf, off, _BETWEEN)
    words = [span_hashes(buf, starts, ends, FOLDED_VALUES)]
    for n in PREFIXES:
        long = ends - starts > n
        h = np.zeros(len(starts), np.uint64)
        h[long] = mix(span_hashes(buf, starts[long], starts[long] + n, FOLDED_VALUES) + U(n))
        words.append(h)
    words = np.stack(words, axis=1)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])[starts]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    new = np.ones(len(words), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    count = np.concatenate([[0], np.cumsum(new)])
    return words, sentence, first, count[first], starts, ends


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sentence_logits(model: Model, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0)
    if not len(model.words):
        return np.full(n, model.bias)
    at = np.minimum(np.searchsorted(model.words, words), len(model.words) - 1)
    weight = np.where(model.words[at] == words, model.weights[at], 0.0).sum(axis=1)
    return model.bias + np.bincount(sentence, weights=weight, minlength=n)


def score_texts(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The noisy-or of each document's sentences; 0 without words."""
    out = np.zeros(len(off) - 1)
    for i, j in slices(off):
        words, sentence, _, first, _, _ = sentence_words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        clean = np.concatenate([[0], np.cumsum(_softplus(sentence_logits(model, words, sentence, int(first[-1]))))])
        out[i:j] = -np.expm1(-(clean[first[1:]] - clean[first[:-1]]))
    return np.clip(out, 0.0, 1.0)


def fit(feature: np.ndarray, sentence: np.ndarray, doc_of_sentence: np.ndarray, label: np.ndarray, n: int, rounds: int = 200, rate: float = 0.15, decay: float = 1e-2):
    """Weights of n features and a bias, by Adam on the mean log loss of the noisy-or, with L2 decay.

    feature, sentence: one entry for each time a feature stands in a sentence.
    """
    n_docs, n_sentences = len(label), len(doc_of_sentence)
    weight, bias = np.zeros(n), -4.0
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    balance = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum()))
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights=weight[feature], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        none = np.exp(-np.bincount(doc_of_sentence, weights=_softplus(z), minlength=n_docs))
        pull = np.where(label == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * balance
        g = pull[doc_of_sentence] * p
        gw, gb = np.bincount(feature, weights=g[sentence], minlength=n) + decay / n_docs * weight, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weight -= step * m / (np.sqrt(v) + 1e-9)
        bias -= step * mb / (np.sqrt(vb) + 1e-9)
    return weight, float(bias)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


_COUNTS = pa.schema([("bucket", pa.int64()), ("feature", pa.binary()), ("toxic", pa.binary())])
_BUCKETS = 16


def _document_features(batches):
    """Each document's different features with its label, packed by bucket."""
    for batch in batches:
        label, (buf, off) = batch.column(1).to_numpy(), column_bytes(batch.column(0))
        found, toxic = [], []
        for i, j in slices(off):
            words, _, first, _, _, _ = sentence_words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            for d in range(j - i):
                own = np.unique(words[first[d] : first[d + 1]])
                found.append(own[own != 0])
                toxic.append(np.full(len(found[-1]), label[i + d], np.uint8))
        feature = np.concatenate([np.zeros(0, np.uint64), *found])
        out = blob_batch((feature % U(_BUCKETS)).astype(np.int64), _COUNTS, feature=feature, toxic=np.concatenate([np.zeros(0, np.uint8), *toxic]))
        if out is not None:
            yield out


def _select(n_toxic: int, n_clean: int):
    """Features whose share of toxic documents differs from that of clean ones beyond chance."""

    def run(table: pa.Table) -> pa.Table:
        feature, inverse = np.unique(join_blobs(table["feature"], np.uint64), return_inverse=True)
        toxic = join_blobs(table["toxic"], np.uint8)
        a, b = (np.bincount(inverse, weights=w, minlength=len(feature)) for w in (toxic, 1 - toxic))
        share = (a + b + 1) / (n_toxic + n_clean + 2)
        z = np.abs(a / n_toxic - b / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
        keep = (a + b >= LEAST_DOCS) & (z >= LEAST_Z)
        return pa.table({"feature": pa.array(feature[keep].view(np.int64))})

    return run


def _bags(vocabulary: np.ndarray):
    """Each document's label, number of sentences, and its selected features with their sentences."""

    def run(batches):
        for batch in batches:
            rows, (buf, off) = [], column_bytes(batch.column(0))
            for label, i in zip(batch.column(1).to_pylist(), range(len(off) - 1), strict=True):
                words, sentence, _, of, _, _ = sentence_words(buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])
                at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
                hit = vocabulary[at] == words
                rows.append((label, int(of[-1]), squeeze(at[hit].astype(np.int32)), squeeze(np.broadcast_to(sentence[:, None], hit.shape)[hit].astype(np.int32))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["toxic", "sentences", "feature", "sentence"])

    return run


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", most=(TRAIN_TOXIC, TRAIN_CLEAN)) -> Model:
    """Fits a model on at most ``most`` labelled toxic and clean documents that aren't held out.

    Null labels don't count; a document labelled twice is toxic if one label says so, and of rows that share an
    id one is taken, by a hash of its text.  Null and empty texts have no features.  Without both labels, or
    features that tell them apart, as with empty tables, every text scores near 0.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    part = lambda label, n: known.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = part(1, most[0]).unionByName(part(0, most[1]))
    texts = docs.select(F.col(doc_id).alias("id"), text_of(F.col(text)).alias("text")).join(F.broadcast(sample), "id")
    rows = stored(texts.groupBy("id").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("one")).select("one.text", "one.toxic"), "labelled")  # one of the rows of an id
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    chosen = rows.mapInArrow(_document_features, "bucket long, feature binary, toxic binary").groupBy("bucket").applyInArrow(_select(sizes[1], sizes[0]), "feature long").toArrow()
    vocabulary = np.sort(chosen["feature"].to_numpy().view(np.uint64))
    if not len(vocabulary):
        return nothing
    bags = rows.mapInArrow(_bags(vocabulary), "toxic int, sentences int, feature binary, sentence binary").toArrow()
    count = bags["sentences"].to_numpy().astype(np.int64)
    first = np.cumsum(count) - count
    features, owns = ([stretch(b, np.int32) for b in bags[c].to_pylist()] for c in ("feature", "sentence"))
    feature, sentence = np.concatenate(features), np.concatenate(owns) + np.repeat(first, [len(x) for x in features])
    weights, bias = fit(feature, sentence, np.repeat(np.arange(len(count)), count), bags["toxic"].to_numpy().astype(np.int64), len(vocabulary))
    return Model(vocabulary, weights, bias)


def scores(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for each row, repeated ones too; null ids stay null; null texts are empty and score 0.

    An empty table gives an empty table; other columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(model, *column_bytes(batch.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").withColumnRenamed("doc_id", doc_id)


def offending_sentences(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """``doc_id, start, end, score``: byte offsets, from its first word to its last, of each sentence that scores ``least``.

    Null ids stay null and repeated rows give their sentences again; texts without words, null ones included,
    and an empty table give none.  Other columns are not read, whatever their names.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            words, sentence, _, of, starts, ends = sentence_words(buf, off)
            p = 1 / (1 + np.exp(-np.clip(sentence_logits(model, words, sentence, int(of[-1])), -60, 60)))
            hit = np.flatnonzero(p >= least)
            a, b = np.searchsorted(sentence, hit), np.searchsorted(sentence, hit, "right") - 1
            doc = np.searchsorted(of, hit, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(starts[a] - off[doc]), pa.array(ends[b] - off[doc]), pa.array(p[hit])], names=["doc_id", "start", "end", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, end long, score double").withColumnRenamed("doc_id", doc_id)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs that score below ``reject``, with all columns, whatever their names.

    Null texts score 0 and stay null; null ids, ties and repeated rows are treated like any other row.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            score = score_texts(model, *column_bytes(batch.column(at)))
            yield batch.filter(pa.array(score < reject))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = scores(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
