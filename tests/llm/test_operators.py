"""Every operator against brute force, and on nulls, empty texts, repeated rows, empty tables and odd columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.llm import brown, exact, fingerprint, jaccard, lines, packing, pieces, suffix, textkit, toxicity, warc

SPACE = r"[\x20\x09-\x0d]+"
WORD = r"[^\x20\x09-\x0d]+"
_random = random.Random(5)
_base = "".join(_random.choice("abc d") for _ in range(400))
TEXTS = [_base[_random.randint(0, 100) : _random.randint(150, 400)] + "".join(_random.choice("ab ") for _ in range(_random.randint(0, 50))) for _ in range(24)] + ["x" * 3000, "xy" * 400, "x" * 150 + "é" * 300, "", "one two three four five six seven eight.", "one  two three four five six seven\teight."]
ROWS = list(enumerate(TEXTS))


def table(spark, rows, extra=True):
    """Documents with columns whose names operators might use themselves."""
    df = spark.createDataFrame([(i, t, "l", 1, "b") for i, t in rows], "doc_id long, text string, bucket string, __n int, id string")
    return df if extra else df.select("doc_id", "text")


def odd_rows():
    return [*ROWS[:5], ROWS[0], (None, None), (None, "z" * 150), (90, None), (91, ""), (92, " \n\t ")]


#: Names of columns that operators make themselves, or once did.
CLASHES = "n_bytes n_removed n_spans spans kept_sha256 group __group digest __digest place winner __n __size __first id __id __toxic toxic key bucket links root block rep lo hi decoded score row".split()


def clashing(spark, rows):
    """Documents with a column of each clashing name, which holds a text of its own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *[f"concat('{c} ', coalesce(doc_id, -1)) AS `{c}`" for c in CLASHES])


@pytest.mark.parametrize("name", ["repeats", "units", "duplicates", "similar", "clean"])
def test_other_columns_keep_their_values(spark, name):
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -12.0)
    apply = {"repeats": suffix.remove_repeats, "units": lines.remove_units, "duplicates": exact.drop_duplicates, "similar": jaccard.drop_similar, "clean": lambda d: toxicity.keep_clean(d, model)}[name]
    docs = clashing(spark, odd_rows())
    out = apply(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in got for c in CLASHES)
    assert apply(docs.limit(0)).collect() == []


def test_reading_operators_do_not_mind_other_columns(spark):
    docs, labels = clashing(spark, odd_rows()), clashing(spark, [(1, "")]).withColumn("toxic", F.lit(1))
    plain = docs.select("doc_id", "text")
    for read in (suffix.repeated_bytes, lines.repeated_units, exact.duplicate_groups, jaccard.similar_classes, fingerprint.compare_neighbours, pieces.encode):
        assert sorted(map(repr, read(docs).collect())) == sorted(map(repr, read(plain).collect())), read
    assert len(toxicity.scores(docs, toxicity.train(docs, labels)).collect()) == len(odd_rows())
    assert pieces.decode(pieces.encode(docs, with_ids=True).withColumn("decoded", F.lit(7))).columns.count("decoded") == 1


def shingles(text):
    w = re.findall(WORD, text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_column_builder_sorts_suffixes_and_measures_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(20):
        k, limit = int(rng.integers(1, 9)), int(rng.integers(2, 12))
        size = rng.integers(0, 60, k)
        data, starts = rng.integers(0, 2, size.sum()).astype(np.uint8) * 244, np.cumsum(size) - size
        if trial % 3 == 0:
            data[:] = 7
        string, place, prefix = suffix.ColumnBuilder(data, starts, size, limit).build()
        string, place, prefix = string[4 * k :], place[4 * k :], prefix[4 * k :]
        assert sorted(zip(string, place, strict=True)) == [(i, q) for i in range(k) for q in range(size[i] - 3)]
        keys = [[data[starts[i] + q + 4 * t : starts[i] + q + 4 * t + 4].tobytes() for t in range((size[i] - q) // 4)] for i, q in zip(string, place, strict=True)]
        assert keys == sorted(keys)
        for a in range(1, len(keys)):
            same = sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(keys[a - 1], keys[a], strict=False)))
            assert min(same, limit) == prefix[a]


@pytest.mark.parametrize("width", [4, 5])
def test_wider_symbols_find_the_same_windows(width, monkeypatch):
    monkeypatch.setattr(suffix, "WIDTH", width)
    texts = [t.encode() for t in TEXTS if 100 <= len(t) <= 354]
    size = np.array([len(t) for t in texts])
    string, place = suffix.repeated_windows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size - 99, np.arange(len(texts)))
    seen, later = set(), set()
    for i, t in enumerate(texts):
        for q in range(len(t) - 99):
            (later if t[q : q + 100] in seen else seen).add((i, q) if t[q : q + 100] in seen else t[q : q + 100])
    assert set(zip(string.tolist(), place.tolist(), strict=True)) == later


def brute_marks(rows, n=100):
    """A byte of 1 for each byte of a text that is to go."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        out[i] = gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            gram = b[p : p + n]
            if gram in seen:
                gone[p : p + n] = b"\1" * n
            seen.add(gram)
    return out


def brute_repeats(rows, n=100):
    out = {}
    for (i, t), gone in zip(rows, brute_marks(rows, n).values(), strict=True):
        kept = bytes(x for x, g in zip((t or "").encode(), gone, strict=True) if not g)
        out[i] = (len(gone), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark):
    got = {r[0]: tuple(r)[1:5] for r in suffix.repeated_bytes(table(spark, ROWS)).collect()}
    assert got == brute_repeats(ROWS)


def test_suffix_dedup_on_odd_rows(spark):
    rows = table(spark, odd_rows())
    assert suffix.repeated_bytes(rows).count() == rows.count()
    out = suffix.remove_repeats(rows)
    assert out.columns == rows.columns and out.count() == rows.count()
    again = [r.text for r in out.where("doc_id = 0").collect()]
    assert sorted(map(len, again))[0] < sorted(map(len, again))[-1]  # the repeated row loses what the first keeps
    assert suffix.repeated_bytes(rows.limit(0)).count() == 0


def test_hot_minimisers_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_SHARE", 1.0 / 3)
    line = "".join(_random.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(_random.choice("ijklm ") for _ in range(80)) + line + "".join(_random.choice("nopq ") for _ in range(80))) for i in range(120)]
    assert {r[0]: tuple(r)[1:5] for r in suffix.repeated_bytes(table(spark, rows)).collect()} == brute_repeats(rows)


def repeating_strings():
    """Texts of 100 to 354 bytes that share passages with each other and within themselves."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(500))
    texts = [base[i : i + rng.randint(100, 300)] for i in (rng.randrange(200) for _ in range(60))]
    texts += [t[:150] + "x" + t[150:] for t in texts[:20]] + [base[100:240] + "".join(rng.choice("efg") for _ in range(60)) for _ in range(20)]
    return [t for t in texts if len(t) >= 100] + ["a" * 300, "b" + "a" * 150, "ab" * 100, "ab" * 60 + "b" * 120]


def test_a_minimiser_with_many_strings_is_divided_without_loss(monkeypatch):
    monkeypatch.setattr(suffix, "BUILD", 7)
    sizes, plain = [], suffix.ColumnBuilder.__init__
    monkeypatch.setattr(suffix.ColumnBuilder, "__init__", lambda self, data, starts, lengths, *a, **k: sizes.append((len(starts), lengths.max())) or plain(self, data, starts, lengths, *a, **k))
    rows = list(enumerate(repeating_strings()))
    ids, runs = np.arange(len(rows)), np.array([len(t) - 99 for _, t in rows], np.uint8)
    binary = {"key": np.full(len(rows), 9, np.uint64), "id": ids, "at": np.zeros(len(rows), np.int64), "run": runs}
    row = {"bucket": [0], **{k: [v.tobytes()] for k, v in binary.items()}, "bytes": ["".join(t for _, t in rows).encode()], "gone_id": [None], "gone_at": [None], "gone_n": [None]}
    found = suffix._find(1)(pa.table(row, schema=suffix._STRINGS))
    got = {i: bytearray(len(t)) for i, t in rows}
    for i, at, n in zip(*(textkit.join_blobs(found[c], d).tolist() for c, d in (("id", np.int64), ("at", np.int64), ("n", np.int32))), strict=True):
        got[i][at : at + n] = b"\1" * n
    assert got == brute_marks(rows)
    assert max(n for n, _ in sizes) <= 4 * 7 and max(size for _, size in sizes) <= suffix.SPAN + 99


def test_suffix_groups_follow_the_bytes_of_the_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 1000)
    rows = [(i, t * (1 + i % 3)) for i, t in enumerate(repeating_strings())]
    gone, n_groups = suffix._removals(table(spark, rows), "doc_id", "text")
    assert n_groups >= sum(len(t) for _, t in rows) / 1000
    assert {r[0]: tuple(r)[1:5] for r in suffix.repeated_bytes(table(spark, rows)).collect()} == brute_repeats(rows)


def test_jaccard_join(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = []
    for t in texts:
        w = t.split()
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = "new"
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows), texts[0].replace(" ", "  ")), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "a b")]
    got = {r.doc_id: r for r in jaccard.similar_classes(table(spark, rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = list(first.values())
    linked = {i: {j for j in reps if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in reps}
    for i in sets:
        rep, seen, todo = first[sets[i]], set(), [first[sets[i]]]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += linked[x]
        assert (got[i].copy_of, got[i].class_id, got[i].n_links) == (rep, min(seen), len(linked[rep]))


def test_large_buckets_are_joined_by_pairs_of_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(30):
        w = list(base)
        w[rng.randrange(3, 97)] = f"x{i}"
        rows.append((i, " ".join(w)))
    whole = sorted(jaccard.similar_classes(table(spark, rows)).collect())
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert sorted(jaccard.similar_classes(table(spark, rows)).collect()) == whole
    sets = [shingles(t) for _, t in rows]
    assert {r.doc_id: r.n_links for r in whole} == {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}


def test_jaccard_join_on_odd_rows(spark):
    rows = table(spark, odd_rows())
    assert jaccard.similar_classes(rows).count() == rows.count()
    assert jaccard.similar_classes(rows.limit(0)).count() == 0
    kept = jaccard.drop_similar(rows)
    assert kept.columns == rows.columns and 0 < kept.count() < rows.count()


def test_posterior_bound():
    # With a uniform prior the tail after m of n matches is P(Binomial(n + 1, 0.8) <= m).
    for n in (12, 60):
        m = jaccard.least_matches(n)
        tail = lambda k: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= jaccard.TOLERANCE > (tail(m - 1) if m else 0)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN", 3)
    pages = spark.createDataFrame([(i, f"http://www.a{i % 3}.org/x{i % 5}?q={i % 2}", ("h" * (i % 7 * 40) + "é") if i % 4 else None, 1) for i in range(40)] + [(None, None, "z" * 200, 1), (70, "b ad\n", "z" * 200, 1), (71, "http://[x", "", 1), (71, "http://[x", "", 1)], "page_id long, url string, html string, first int").repartition(11)
    folder = warc.new_folder(spark, "test-warc")
    got = warc.read_archives(spark, warc.write_archives(pages, folder), folder).collect()
    assert len(got) == 44
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    for r in got:
        payload = want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        firsts = [p for p, b in want.items() if b == payload and p is not None]
        revisit = len(payload) >= 100 and bool(firsts) and min(firsts) != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", min(firsts)) if revisit else ("response", None))
    in_order = [(r.url_key.encode(), r.captured) for r in sorted(got, key=lambda r: r.capture)]
    assert in_order == sorted(in_order)
    empty = warc.new_folder(spark, "test-warc")
    assert warc.read_archives(spark, warc.write_archives(pages.limit(0), empty), empty).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_exact_dedup(spark):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)] + [(100, None), (101, ""), (102, "a\t b"), (103, "a b"), (3, "text 3"), (3, "text 3"), (None, "text 3"), (None, "only")]
    got = exact.duplicate_groups(table(spark, rows)).collect()
    norm = lambda t: re.sub(SPACE, " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(ids))
    assert sum(r.kept for r in got) == len(groups)
    kept = exact.drop_duplicates(table(spark, rows))
    assert kept.count() == len(groups) and len(kept.columns) == 5
    assert exact.duplicate_groups(table(spark, rows).limit(0)).count() == 0


def test_fingerprints(spark):
    rows = [*ROWS, (50, "a b c d e f g " * 90), (51, "a b c d e f g " * 90 + "more words at the end of it")]
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(table(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(ordered):
        n = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, n)):
            a, b = shingles(t), shingles(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[0].fingerprint == fingerprint.encode(fingerprint.sketches([TEXTS[0]])[0])
    odd = table(spark, odd_rows())
    assert fingerprint.compare_neighbours(odd).count() == odd.count()
    assert fingerprint.compare_neighbours(odd.limit(0)).count() == 0


def test_sketches_merge(spark):
    a, b = (" ".join(f"w{i}" for i in range(x, x + 300)) for x in (0, 150))
    sa, sb, both = fingerprint.sketches([a, b, a])
    union = np.unique(np.concatenate(list(textkit_hashes([a, b]))))[: fingerprint.SIZE]
    assert (fingerprint.merge(sa, sb) == union).all() and (sa == both).all()
    assert abs(fingerprint.distinct(sa) - 296) < 80
    prints = fingerprint.fingerprints(table(spark, [(1, a), (2, b)])).selectExpr("'k' AS key", "fingerprint")
    assert fingerprint.merged_fingerprints(prints, "key").first().fingerprint == fingerprint.encode(union)


def textkit_hashes(texts):
    for t in texts:
        h, _ = jaccard.shingle_sets(*textkit.column_bytes(pa.array([t])))
        yield h


def test_language_model_base_scores_and_proper_distribution(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "a", "Cat", "dog", "runs", f"rare{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, "unheard of"), (61, "unheard of")]
    df = table(spark, rows)
    held = brown.held_out(df.doc_id)
    trained = brown.train(df.where(~held), k=4, rounds=3)
    got = brown.perplexities(df, trained, held=held).collect()
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, t or "")] + [None]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(w for i, t in rows if not out(i) for w in low(t))
    total, kinds = sum(count.values()), len(count)
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        r, words = by_id[i], low(t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in count for w in words), total, out(i))
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
    model, placed, _ = trained
    rare = [(n, c) for r in placed.collect() for n, c in zip(np.frombuffer(r["counts"], np.int64), np.frombuffer(r["classes"], np.uint8), strict=True)]
    words = [(int(n), int(c)) for n, c in zip(model.counts, model.cls, strict=False)] + rare
    assert len(words) == kinds
    for s in range(model.k + 1):
        mass = sum(10 ** model.known_word(np.array(s), np.float64(n), np.array(c)) for n, c in words) + 10 ** model.unknown_word(np.array(s))
        assert math.isclose(mass, 1, rel_tol=1e-9)


def test_every_word_is_a_history(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 0.08)  # most words are rare
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["the", "a"]) + f" n{rng.randrange(12)} v{rng.randrange(9)}" for _ in range(rng.randrange(9)))) for i in range(50)] + [(50, "the new n1 v1"), (51, None), (52, "v3 v3 v3")]
    docs = table(spark, rows)
    model, placed, _ = trained = brown.train(docs.where("doc_id <> 50"), k=3, rounds=2)
    cls, count = {}, {}
    for r in placed.collect():
        for w, c, n in zip(np.frombuffer(r["words"], np.uint64), np.frombuffer(r["classes"], np.uint8), np.frombuffer(r["counts"], np.int64), strict=True):
            cls[int(w)], count[int(w)] = int(c), int(n)
    hashes = {i: [int(h) for h in brown.tokens(*textkit.column_bytes(pa.array([t or ""])))[0]] for i, t in rows}
    bigrams, once = np.zeros((4, 3)), np.zeros(4)
    for i, words in hashes.items():
        for before, w in zip([None, *words], words, strict=False) if i != 50 else ():
            s = 3 if before is None else cls[before]
            bigrams[s, cls[w]] += 1
            once[s] += count[w] == 1
    want = brown.Model(bigrams, once, sum(count.values()), len(count), 3, brown.MIX)
    assert np.allclose(model.follow, want.follow) and np.allclose(model.unknown, want.unknown) and (model.class_size == want.class_size).all()
    got = {r.doc_id: r.score for r in brown.perplexities(docs, trained).collect()}
    for i, words in hashes.items():
        score = 0.0
        for before, w in zip([None, *words], words, strict=False):
            s = np.array(3 if before is None else cls.get(before, 4))
            score += want.known_word(s, np.float64(count[w]), np.array(cls[w])) if w in count else want.unknown_word(s)
        assert math.isclose(got[i], score, rel_tol=1e-9)


def test_exchange_never_lowers_the_likelihood_and_keeps_its_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trained = brown.train(docs, k=12, rounds=5)
    history = trained[0].history
    assert len(history) > 2 and all(a < b for a, b in zip(history[:-1], history[1:], strict=True))
    size = np.sort(trained[0].class_size)
    assert size[0] > 0.002 * size.sum() and size[-1] < 0.5 * size.sum()
    base, score = brown.perplexities(docs, trained).selectExpr("sum(base_score)", "sum(score)").first()
    assert score > base


def test_core_words_are_exchanged_to_a_local_optimum():
    rng = np.random.default_rng(8)
    pairs = rng.integers(0, 9, (21, 20)).astype(float)
    weight, k = pairs.sum(axis=0), 4

    def value(cls):
        table = np.zeros((k + 1, k))
        np.add.at(table, (np.append(cls, k)[:, None].repeat(20, 1), cls[None, :].repeat(21, 0)), pairs)
        return brown.likelihood(table)

    cls = brown.exchange(pairs, weight, k, 50)
    for w in range(20):
        for c in range(k):
            assert value(np.where(np.arange(20) == w, c, cls)) <= value(cls) + 1e-6


def test_exchange_gains_are_likelihood_differences():
    rng = np.random.default_rng(3)
    n, k = 12, 3
    pairs = rng.integers(0, 5, (n + 1, n)).astype(float)
    cls = np.append(rng.integers(0, k, n), k)

    def likelihood(c):
        t = np.zeros((k + 1, k))
        np.add.at(t, (c[:, None].repeat(n, 1), c[:n][None, :].repeat(n + 1, 0)), pairs)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(t) - f(t.sum(0)) - f(t.sum(1)[:k])

    for w in range(n):
        table = np.zeros((k + 1, k))
        np.add.at(table, (cls[:, None].repeat(n, 1), cls[:n][None, :].repeat(n + 1, 0)), pairs)
        left = np.bincount(cls, weights=pairs[:, w], minlength=k + 1)[None]
        right = np.bincount(cls[:n], weights=pairs[w], minlength=k)[None]
        best = brown.best_classes(left, right, cls[w : w + 1], table, pairs[w, w][None])[0]
        tried = [likelihood(np.append(np.where(np.arange(n) == w, b, cls[:n]), k)) for b in range(k)]
        assert tried[best] >= max(tried) - 1e-6


def test_language_model_without_documents(spark):
    df = table(spark, ROWS).limit(0)
    assert brown.perplexities(df, brown.train(df)).count() == 0


def brute_units(rows, least=lines.LEAST_WORDS):
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)
    units = []
    for i, t in rows:
        b = (t or "").encode()
        for m in re.finditer(rb"[^\n\r]+", b):
            words = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(WORD.encode(), m[0])]
            sentences, now = [], []
            for a, e in words:
                now.append((a, e))
                if b[e - 1 : e] in (b".", b"!", b"?"):
                    sentences.append(now)
                    now = []
            sentences += [now] if now else []
            for kind, group in [(1, words)] * bool(words) + [(2, s) for s in sentences if len(s) >= least and len(sentences) > 1]:
                units.append((i, group[0][0], kind, group[-1][1], tuple(low(b[a:e]) for a, e in group)))
    first, gone = set(), collections.defaultdict(set)
    for i, a, kind, e, words in sorted(units, key=lambda u: u[:2]):
        if (kind, words) in first:
            gone[i].update(range(a, e))
        first.add((kind, words))
    return gone


def test_line_dedup(spark):
    s = "This sentence has more than eight words in it, it does."
    rows = [(0, f"Head\n{s} Then more of it here.\nfoot"), (1, f"other {s}\nHEAD\n\n  foot  "), (2, f"Some words stand before. {s} And after."), (3, None), (4, "\n\n"), *[(10 + i, t) for i, t in ROWS]]
    gone = brute_units(rows)
    for r in lines.repeated_units(table(spark, rows)).collect():
        spans = {p for x in r.spans for p in range(x.start, x.end)}
        assert spans == gone[r.doc_id] and r.n_removed == len(spans) and r.n_spans == len(r.spans)
    odd = table(spark, odd_rows())
    assert lines.repeated_units(odd).count() == odd.count() and lines.repeated_units(odd.limit(0)).count() == 0
    assert lines.remove_units(odd).columns == odd.columns


def test_a_sentence_is_the_same_on_a_line_of_its_own(spark):
    s = "This passage stands on a line of its own and " + "goes on " * 25 + "to its end."
    rows = [(0, f"Head\n{s}\nfoot"), (1, f"Some words stand before. {s} And after."), (2, s.upper()), (3, f"short.\n{s} More.")]
    gone = {r.doc_id: [rows[r.doc_id][1][x.start : x.end] for x in r.spans] for r in lines.repeated_units(table(spark, rows)).collect()}
    assert gone == {0: [], 1: [s], 2: [s.upper()], 3: [s]}
    back = [(9 - i, t) for i, t in rows]  # the sentence within a line comes first
    gone = {r.doc_id: r.n_spans for r in lines.repeated_units(table(spark, back)).collect()}
    assert gone == {6: 0, 7: 1, 8: 1, 9: 1}


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(6)
    calm = ["river", "stone", "green", "walks", "slowly", "bright", "house", "tree"]
    say = lambda: " ".join(rng.choice(calm) for _ in range(7)) + ". "
    rows, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = say() + say() + (f"you total {rng.choice(['moron', 'scumbag'])} of them all. " if bad else "") + say()
        rows.append((i, text))
        marks.append((i, int(bad)))
    docs, labels = table(spark, [*rows, (900, None), (901, ""), (None, "moron")]), spark.createDataFrame([*marks, (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    held = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and all((got[i] >= toxicity.REJECT) == (i % 4 == 0) for i in held)
    assert got[900] == got[901] == 0 and all(0 <= x <= 1 for x in got.values())
    for r in toxicity.offending_sentences(docs, model).where("doc_id IS NOT NULL").collect():
        assert "moron" in rows[r.doc_id][1][r.start : r.end] or "scumbag" in rows[r.doc_id][1][r.start : r.end]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, b in marks if not b and i in held}
    assert toxicity.scores(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [*ROWS, (60, None), (61, ""), (62, "Straße 12 o'clock it's <|endoftext|> ünder_score ﬁ Σας" * 90), (63, "word " * 6000), (5, TEXTS[5])]
    got = packing.pack(table(spark, rows).repartition(3)).collect()
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: np.array(encoder.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    whole = collections.Counter()
    by_sequence = collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        whole[r.doc_id] += r.length
        by_sequence[r.sequence_id].append(r)
    copies = collections.Counter(i for i, _ in rows)
    assert whole == {i: len(x) * copies[i] for i, x in ids.items()}
    for pieces_ in by_sequence.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= packing.WINDOW
    assert packing.pack(table(spark, rows).limit(0)).count() == 0


def known_of(docs):
    """Statistics of documents given as lists of small numbers, which are their slots."""
    df = np.zeros(packing.SLOTS, np.int64)
    for d in docs:
        df[list(set(d))] += 1
    return packing.Statistics(len(docs), sum(map(len, docs)) / len(docs), df)


def index_of(docs, known):
    return packing.Index(np.array([w for d in docs for w in d], np.uint64), np.cumsum([0, *map(len, docs)]), known)


def bm25(seed, other, known):
    norm = packing.K1 * (1 - packing.B + packing.B * len(other) / known.mean)
    return sum(math.log(1 + (known.n - known.df[w] + 0.5) / (known.df[w] + 0.5)) * other.count(w) * (packing.K1 + 1) / (other.count(w) + norm) for w in set(seed) & set(other))


def test_neighbours_share_rare_words():
    docs = [[1, 2, 3], [1, 9, 8], [2, 3, 7], [5, 6, 4]]
    assert list(index_of(docs, known_of(docs)).neighbours(0, np.array([False, True, True, True]))) == [2, 1]


def test_neighbours_are_scored_with_all_terms_and_the_counts_of_all_documents():
    rng = random.Random(8)
    docs = [list(range(40)) + [100], list(range(40)), [100, 200, 201], [100, 202], *[[rng.randrange(60) for _ in range(rng.randrange(1, 90))] for _ in range(30)]]
    known = known_of(docs + [[100, rng.randrange(60)] for _ in range(50)])  # documents of other shards
    index = index_of(docs, known)
    for seed, d in enumerate(docs):
        score = [bm25(d, other, known) if i != seed else 0 for i, other in enumerate(docs)]
        unused = np.arange(len(docs)) != seed
        got = index.neighbours(seed, unused)
        assert set(got) == {i for i, x in enumerate(score) if x > 0}
        assert np.allclose([score[i] for i in got], sorted((x for x in score if x > 0), reverse=True))


def test_windows_fill_in_the_order_of_brute_force_scores():
    rng = random.Random(3)
    docs = [[rng.randrange(50) for _ in range(rng.randrange(1, 40))] for _ in range(60)]
    known, sizes = known_of(docs), np.array([rng.randrange(1, 3000) for _ in docs])
    room, left, want, rest = 1000, list(range(60)), [], None
    while left:
        seed = rest if rest is not None else left[0]
        if rest is None:
            left.remove(seed)
            want.append(seed)
            room -= sizes[seed]
        ranked = sorted((d for d in left if bm25(docs[seed], docs[d], known) > 0), key=lambda d: (-round(bm25(docs[seed], docs[d], known), 9), d)) if room > 0 else []
        last = seed
        for d in ranked:
            if room <= 0:
                break
            left.remove(d)
            want.append(d)
            room -= sizes[d]
            last = d
        rest = None
        if room <= 0:  # what is left of the last document opens the next window
            over = -room % packing.WINDOW
            room, rest = (packing.WINDOW - over, last) if over else (packing.WINDOW, None)
    assert list(packing.fill_order(index_of(docs, known), sizes, 1000)) == want


def test_documents_that_share_rare_words_meet_wherever_they_stand(spark):
    rng = random.Random(2)
    topic = lambda t: " ".join(rng.choice([f"t{t}w{rng.randrange(12)}", f"c{rng.randrange(400)}"]) for _ in range(60))
    rows = [(i, topic(i % 30)) for i in range(300)] + [(400, None), (401, "alone")]
    df = table(spark, rows)
    known = packing.statistics(df.select("text").fillna(""))
    assert known.n == 302 and math.isclose(known.mean, 18001 / 302)
    count = collections.Counter(w for _, t in rows for w in set(re.findall(WORD, t or "")))
    slot = lambda w: int(packing.word_hashes(*textkit.column_bytes(pa.array([w])))[0][0]) % packing.SLOTS
    assert all(known.df[slot(w)] == n for w, n in count.items())
    keys = packing.shard_keys(known, 100, np.array([i for i, _ in rows]), *textkit.column_bytes(pa.array([t or "" for _, t in rows])))
    by_key = collections.defaultdict(set)
    for (i, _), k in zip(rows[:300], keys, strict=False):
        by_key[k].add(i % 30)
    assert len(by_key) < 150 and sum(len(t) == 1 for t in by_key.values()) > 0.6 * len(by_key)
    layout = lambda d: {(r.doc_id, r.start, r.length) for r in packing.pack(d).collect()}
    assert layout(df.repartition(1)) == layout(df.repartition(7, "text"))  # file order doesn't count


def test_any_tokenizer_gives_its_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "Two  Words,\n and Ünïcode 12"), (2, None), (3, " lead")]
    encoder = Tokenizer.from_file(path)
    for r in packing.pack(table(spark, rows), tokenizer=path).collect():
        ids = np.array(encoder.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_n_best_pieces(spark):
    lattice = pieces.Lattice(pieces.default_model())

    def brute(text):
        edges, out = lattice.edges(text), []

        def go(end, score):
            if not end:
                out.append(score)
            for start, gain, _ in edges[end]:
                go(start, score + gain)

        go(len(text), 0.0)
        return sorted(out, reverse=True)

    for word in (" the", " hello", " wörld☃", "  a", "\n", ""):
        want = brute(word)[:6]
        assert np.allclose([s for s, _ in lattice.n_best(word, 6)], want)
    rng = np.random.default_rng(1)
    for _ in range(60):
        losses = np.sort(rng.integers(0, 9, (rng.integers(1, 5), 4)), axis=1).astype(float)
        losses -= losses[:, :1]
        want = sorted(sum(losses[r, c] for r, c in enumerate(cs)) for cs in itertools.product(range(4), repeat=len(losses)))[:4]
        assert [x for x, _ in pieces.chain_n_best(losses, 4)] == want
    texts = [(1, "the hello wor ld"), (2, None), (3, ""), (4, "  two  ▁ spaces\n\nß☃ "), (None, "x" * 300), (4, "again")]
    got = pieces.decode(pieces.encode(table(spark, texts), with_ids=True)).collect()
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in texts) and all(r.round_trip for r in got)
    one = next(r for r in got if r.doc_id == 1)
    assert np.allclose(one.nbest_scores, [s for s, _ in lattice.n_best(" the hello wor ld", 4)])
    assert pieces.encode(table(spark, texts).limit(0)).count() == 0


def model_pieces(path):
    """Pieces, scores and kinds as the model file has them: field 1 is a piece, with text 1, score 2 and kind 3."""

    def fields(data):
        def varint(at):
            out = shift = 0
            while True:
                out |= (data[at] & 127) << shift
                at, shift = at + 1, shift + 7
                if data[at - 1] < 128:
                    return out, at

        at = 0
        while at < len(data):
            key, at = varint(at)
            if key & 7 == 0:
                value, at = varint(at)
            else:
                size, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
                value, at = data[at : at + size], at + size
            yield key >> 3, value

    with open(path, "rb") as f:
        rows = [dict(fields(value)) for key, value in fields(f.read()) if key == 1]
    return [(r[1].decode(), struct.unpack("<f", r[2])[0], r.get(3, 1)) for r in rows]


def test_spaces_have_their_pieces(spark):
    rows = model_pieces(pieces.default_model())
    normal = {p.replace("▁", " "): (s, i) for i, (p, s, kind) in enumerate(rows) if kind == 1}
    byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(rows) if kind == 6}
    low = min(s for s, _ in normal.values()) - pieces.BYTE_PENALTY
    lattice = pieces.Lattice(pieces.default_model())
    texts = ["1 9", "a  b", "x 世 界", "    if", "\n  y", "☃ 7", " "]
    got = {r.doc_id: r for r in pieces.encode(table(spark, list(enumerate(texts))), with_ids=True).collect()}
    for k, text in enumerate(texts):
        text, found = " " + text, []
        edges = [(a, b, *normal[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in normal]
        edges = [(a, b, s, (i,)) for a, b, s, i in edges] + [(a, a + 1, low * len(c.encode()), tuple(byte[x] for x in c.encode())) for a, c in enumerate(text) if c not in normal]
        assert sorted(edges) == sorted((a, b, s, ids) for b, there in enumerate(lattice.edges(text)) for a, s, ids in there)

        def go(at, score, ids):
            if at == len(text):  # noqa: B023
                found.append((-score, ids))  # noqa: B023
            for a, b, s, i in edges:  # noqa: B023
                if a == at:
                    go(b, score + s, ids + i)

        go(0, 0.0, ())
        found.sort()
        r = got[k]
        assert r.nbest_scores == [-s for s, _ in found[:4]] and r.score == -found[0][0] and r.round_trip
        assert tuple(r.ids) in [ids for s, ids in found if s == found[0][0]] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.n_best == min(4, len(found)) and set(r.nbest_crc32) <= {zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in found} and len(set(r.nbest_crc32)) == r.n_best


@pytest.mark.parametrize("text", ["", "a", "a b", "a\x0bb\x0cc d e f", "é ü", " lead and trail "])
def test_words_and_shingles(text):
    buf, off = textkit.column_bytes(pa.array(["pre fix", text, "post"]))
    starts, ends, first = textkit.word_spans(buf, off)
    mine = [buf[a:b].tobytes().decode() for a, b in zip(starts[first[1] : first[2]], ends[first[1] : first[2]], strict=True)]
    assert mine == re.findall(WORD, text)
    h, bounds = textkit.shingle_hashes(textkit.span_hashes(buf, starts, ends), first)
    alone_buf, alone_off = textkit.column_bytes(pa.array([text]))
    s, e, f = textkit.word_spans(alone_buf, alone_off)
    alone, _ = textkit.shingle_hashes(textkit.span_hashes(alone_buf, s, e), f)
    assert list(h[bounds[1] : bounds[2]]) == list(alone) and len(set(alone)) == len(shingles(text))
