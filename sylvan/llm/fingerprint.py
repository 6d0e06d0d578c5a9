"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the ``SIZE`` least hashes of a document's different word shingles.  Sketches of parts merge into
the sketch of their union; from two sketches follow estimates of resemblance, containment and the number of
different shingles, exact while a set has at most ``SIZE``.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import buckets, prepare, text_of
from .jaccard import shingle_sets
from .textkit import column_bytes, slices

SIZE = 128
_NO_ID = -(2**63)


def sketches(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The bottom-k sketch of each text, ascending."""
    buf, off = column_bytes(pa.array(texts, pa.large_string()))
    out = []
    for i, j in slices(off):
        h, bounds = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        out += [h[a : min(a + size, b)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    both = np.sort(np.concatenate([a, b]))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return both[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of different shingles."""
    return float(len(a)) if len(a) < size else (size - 1) * 2.0**64 / float(a[size - 1])


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity; 1 for two empty sets."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    new = np.append(True, both[1:] != both[:-1])
    union = int(new.sum())
    if union <= size:
        return (len(both) - union) / union
    edge = np.flatnonzero(new)[size]  # the first hash beyond the union's sketch
    return (edge - size) / size


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of the first set that is in the second; 1 for an empty first set."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, size)
    return min(1.0, j * (distinct(a, size) + distinct(b, size)) / (1 + j) / distinct(a, size))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` for each row; null texts are empty, their fingerprint is ''."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = sketches(batch.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(x) for x in found], pa.string()), pa.array([distinct(x, size) for x in found], pa.float64())], names=["doc_id", "fingerprint", "n_shingles"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged_fingerprints(prints: DataFrame, key: str, size: int = SIZE, salt: int = 64) -> DataFrame:
    """``key, fingerprint`` of each key's union.  Merging in two steps keeps a key with very many rows out of one task."""

    def run(names):
        def merge_group(table: pa.Table) -> pa.Table:
            held = np.zeros(0, np.uint64)
            for value in table["fingerprint"]:
                held = merge(held, decode(value.as_py() or ""), size)
            return pa.table([*[table[n].slice(0, 1) for n in names], pa.array([encode(held)])], names=[*names, "fingerprint"])

        return merge_group

    kind = prints.schema[key].dataType.simpleString()
    rows = prints.select(F.col(key).alias("key"), "fingerprint", F.pmod(F.xxhash64("fingerprint"), F.lit(salt)).alias("salt"))
    once = rows.groupBy("key", "salt").applyInArrow(run(["key", "salt"]), f"key {kind}, salt long, fingerprint string")
    return once.groupBy("key").applyInArrow(run(["key"]), f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def _neighbour_ranges(rows: DataFrame, n: int) -> DataFrame:
    """rows in ranges of ids, ``part``; each range also gets, with ``halo``, the rows that follow its last in descending order."""
    cuts = sorted(set(rows.approxQuantile("order", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.lit(0)
    if cuts:
        part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("order")))
    rows = rows.withColumn("part", part)
    tops = rows.groupBy("part").agg(F.max("id").alias("id")).orderBy("part").collect()  # one row a range
    if not tops:
        return rows.withColumn("halo", F.lit(False)).drop("order")
    spark = rows.sparkSession
    following = spark.createDataFrame([(top.id, tops[(k + 1) % len(tops)].part) for k, top in enumerate(tops)], "id long, other int")
    both = rows.join(F.broadcast(following), "id", "left")
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("halo")), F.struct(F.col("other").alias("part"), F.lit(True).alias("halo")))
    return both.select("id", "text", F.explode(F.filter(places, lambda p: p["part"].isNotNull())).alias("p")).select("id", "text", "p.part", "p.halo")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, contained_in_edited double"


def _compare(table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["halo"].to_pylist(), table["id"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[1], r[2]), reverse=True)
    own = [r for r in rows if not r[0]]
    halo = next((r for r in rows if r[0]), None)
    names = [x.split()[0] for x in _EDITED.split(", ")]
    if not own:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 4)], names=names)
    texts = [r[2] for r in own] + [halo[2] if halo else own[0][2]]
    edited = []
    for text, following in zip(texts[:-1], texts[1:], strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + following[:half])
    plain, changed = sketches(texts), sketches(edited)
    columns = [
        pa.array([r[1] if r[1] != _NO_ID else None for r in own], pa.int64()),
        pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([encode(x) for x in plain[:-1]], pa.string()),
        pa.array([encode(x) for x in changed], pa.string()),
        pa.array([resemblance(a, b) for a, b in zip(plain[:-1], changed, strict=True)], pa.float64()),
        pa.array([resemblance(a, b) for a, b in zip(plain[:-1], plain[1:], strict=True)], pa.float64()),
        pa.array([distinct(a) for a in plain[:-1]], pa.float64()),
        pa.array([containment(a, b) for a, b in zip(plain[:-1], changed, strict=True)], pa.float64()),
    ]
    return pa.table(columns, names=names)


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside those of its edited text and of the next document, by descending id.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next
    document; after the last comes the first, and a lone document follows itself.  Null texts are empty, null
    ids come last, and rows that share an id follow in descending order of their texts.  Texts move once, to
    ranges of ids; a range also receives the one document that follows it.  An empty table gives an empty
    table; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), text_of(F.col(text)).alias("text")).withColumn("order", F.col("id").cast("double"))
    return _neighbour_ranges(rows, buckets(spark)).groupBy("part").applyInArrow(_compare, _EDITED).withColumnRenamed("doc_id", doc_id)


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
