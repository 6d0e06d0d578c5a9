import collections

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sylvan.llm import exact, jaccard, suffix

from .test_operators import brute_marks


def test_stages_keep_clean_documents_and_their_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == names and 0 < out.count() <= before, name
        docs, before = out, out.count()
    assert exact.duplicate_groups(docs).where("NOT kept").count() == 0
    assert jaccard.similar_classes(docs).where("doc_id <> class_id").count() == 0
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_the_whole_pipeline_and_its_suffix_stage(spark, tmp_path):
    lead = "one and the same passage of plain words that stands in several of these documents word by word, and is long enough to go. "
    rows = [(i, f"{lead if i % 3 == 0 else ''}document {i} speaks of {i * 7919 % 97} other things, é and {'x' * (i % 5)} more {i * 31}", "en", "web", 0) for i in range(20)]
    rows += [(20, rows[3][1], "en", "web", 0), (21, None, "en", "web", 0)]
    rows = [(i, t, lang, source, len(t or "")) for i, t, lang, source, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id <> 20")
    out = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()}
    gone = brute_marks([(i, t) for i, t, *_ in rows if i != 20])
    for i, t, *_ in rows:
        if i != 20:
            text, at = "", 0
            for c in t or "":
                n = len(c.encode())
                text += "" if all(gone[i][at : at + n]) else c
                at += n
            assert out[i].text == text and out[i].n_chars == len(text) and out[i].lang == "en"
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = collections.Counter()
    for r in packed:
        whole[r.doc_id] += r.length
    assert set(whole) == set(range(22)) - {20} and all(whole[r.doc_id] == r.doc_tokens for r in packed)


def test_the_suffix_stage_holds_masks_of_few_bytes(monkeypatch):
    sizes, plain = [], np.cumsum
    texts = ["é" * 40 + chr(97 + i % 26) * 120 for i in range(500)]
    docs = pa.table({"doc_id": np.arange(500), "text": texts})
    gone = {"bucket": [0], "id": [np.arange(500).tobytes()], "at": [np.full(500, 81, np.int64).tobytes()], "n": [np.full(500, 100, np.int32).tobytes()]}
    monkeypatch.setattr(suffix, "APPLY", 2000)
    monkeypatch.setattr(np, "cumsum", lambda x, *a, **k: sizes.append(len(x)) or plain(x, *a, **k))
    out = suffix._apply("doc_id", "text", docs.column_names, docs.schema, True)(docs, pa.table(gone, schema=suffix._GONE))
    assert out["text"].to_pylist() == [t[:41] + t[141:] for t in texts] and max(sizes) <= 2000


def test_the_suffix_stage_with_groups_of_few_bytes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(100)
    want = sorted(map(tuple, corpus_pipeline.unrepeated(spark, docs, sf).collect()))
    groups, plain = [], suffix._cut
    monkeypatch.setattr(suffix, "GROUP", 5000)
    monkeypatch.setattr(suffix, "_cut", lambda n_buckets, n_groups, *a: groups.append(n_groups) or plain(n_buckets, n_groups, *a))
    assert sorted(map(tuple, corpus_pipeline.unrepeated(spark, docs, sf).collect())) == want
    assert groups[0] >= sum(len(r[1].encode()) for r in docs.select("doc_id", "text").collect()) / 5000


def test_registered_queries_match_their_sql(spark, sf):
    from sylvan.llm import entries

    from ..duck import connect, rows_of, rows_of_sql

    for name, sql in entries.oracle_sql().items():
        columns, want = rows_of_sql(connect(sf), sql)
        assert rows_of(entries.queries()[name](spark, sf)) == (columns, want), name
