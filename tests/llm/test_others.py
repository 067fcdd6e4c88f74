"""Fingerprints, sharding, decontamination, the quality classifier and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metagauge.llm import quality, sharding
from metagauge.llm.decontaminate import find_items, remove_items
from metagauge.llm.fingerprints import compare_with_edits, containment, merged, resemblance, sketches
from metagauge.llm.queries import QUERIES, SQL
from metagauge.llm.tables import range_of
from tests.llm.conftest import prose

SF_DIR = "/root/testdata/sf0.001"


def in_order(texts):
    return sorted(texts, key=lambda i: (i is not None, i or 0))


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def test_edits_and_likeness(docs, no_docs, texts):
    found = {r.doc_id: r for r in compare_with_edits(docs).collect()}
    order = in_order(texts)
    assert found.keys() == texts.keys()
    by_text = {}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        text, following = texts[i] or "", texts[j] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        a, b, c = (set(re.findall("." * 8, f)) for f in (r.fingerprint, r.edited_fingerprint, found[j].fingerprint))
        assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1)
        assert r.near_next == (len(a & c) / len(a | c) if a | c else 1)
        grams = lambda t: {t.encode()[k : k + 12] for k in range(max(1, len(t.encode()) - 11))} if t else set()
        if len(text) > 3000 and len(grams(text)) > 2000:
            true = len(grams(text) & grams(edited)) / len(grams(text) | grams(edited))
            assert abs(r.near_edited - true) < 0.1
    assert found[0].near_next == 1 and all(bool(f) == bool(t) for t, f in by_text.items())
    assert compare_with_edits(no_docs).count() == 0
    one = compare_with_edits(docs.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_sketches_merge_and_contain(spark):
    long, other = prose(1, 3000), prose(2, 3000)
    short = " ".join(long.split(" ")[500:900])
    df = spark.createDataFrame([(0, long), (1, short), (2, other), (3, long + " " + other), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r.sketch for r in sketches(df).collect()}
    pairs = [(1, 0), (0, 1), (1, 2), (0, 3), (4, 0), (4, 4)]
    given = spark.createDataFrame([(a, b, rows[a], rows[b]) for a, b in pairs], "x long, y long, a array<long>, b array<long>")
    got = {(r.x, r.y): r for r in given.select("x", "y", containment("a", "b").alias("c"), resemblance("a", "b").alias("r")).collect()}
    grams = lambda t: {t[k : k + 12] for k in range(len(t) - 11)}
    share = lambda a, b: len(grams(a) & grams(b)) / len(grams(a))
    assert got[1, 0].c == got[0, 3].c == 1
    assert abs(got[0, 1].c - share(long, short)) < 0.06 and abs(got[1, 2].c - share(short, other)) < 0.1
    assert got[4, 0].c is None and got[4, 4].r == 1
    both = given.filter("x = 1 and y = 2").select(merged("a", "b").alias("m")).first().m
    assert both == sorted(set(rows[1]) | set(rows[2]))


def test_ranges(spark):
    rnd = random.Random(1)
    ids = [rnd.choice([5, 5, 7, rnd.randrange(10**12), -rnd.randrange(100)]) for _ in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids], "key long")
    rows = df.withColumn("part", range_of(df, "key", 40)).collect()
    parts = [p for _, p in sorted((r.key, r.part) for r in rows)]
    assert parts == sorted(parts) and len({(r.key, r.part) for r in rows}) == len(set(ids)) and len(set(parts)) > 10


# --- sharding ---------------------------------------------------------------------------------------------------------------


def test_differencing():
    rnd = random.Random(4)
    for k, n in ((2, 9), (8, 1), (8, 200), (3, 50)):
        given = [[rnd.randrange(1, 1000), *[0] * (k - 1)] for _ in range(n)]
        goes, sums = sharding.difference(given)
        assert all(sorted(g) == list(range(k)) for g in goes)
        total = [sum(s[g.index(p)] for s, g in zip(given, goes, strict=True)) for p in range(k)]
        assert total == sums and sum(total) == sum(map(sum, given))
    nine = [[x, 0] for x in (8, 7, 6, 5, 4)]
    assert sorted(sharding.difference(nine)[1]) == [14, 16]  # as differencing of these numbers is known to end


@pytest.mark.parametrize("together", [4, 4096])
def test_shards(docs, no_docs, texts, together):
    found = sharding.shard_by_bytes(docs.union(docs.limit(7)), 8, together).collect()
    assert len(found) == len(texts) + 7
    home = {}
    for r in found:
        text = texts[r.doc_id]
        assert (r.size, r.text_crc32) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
        assert home.setdefault(text, r.shard) == r.shard and r.law == "bytes" and r.grown_shard is None
    for shard in range(8):
        own = sorted(r.slot for r in found if r.shard == shard)
        assert own == list(range(len(own)))
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_shards_are_even(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, "x" * rnd.randrange(5000) + str(i)) for i in range(3000)], "doc_id long, text string")
    sums = Counter()
    for r in sharding.shard_by_bytes(df, 8, 200).collect():
        sums[r.shard] += r.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 16


# --- decontamination --------------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_hits(texts, items, n):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name) if name is not None else "")
    sizes = sorted({len(w) for w in windows})
    out = {}
    for i, text in texts.items():
        w = plain_words(text)
        hit, names = [False] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit[k : k + size] = [True] * size
                    names |= windows[tuple(w[k : k + size])]
        out[i] = hit, names
    return out


def check_hits(df, texts, items, items_df, n, **more):
    found = {r.doc_id: r for r in find_items(df, items_df, n, **more).collect()}
    for i, (hit, names) in brute_hits(texts, items, n).items():
        own = [False] * len(hit)
        for h in found[i].hits:
            own[h["first"] : h["last"]] = [True] * (h["last"] - h["first"])
        assert (own, sorted(names), len(hit)) == (hit, found[i]["items"], found[i].n_words), i
    assert found.keys() == texts.keys()


@pytest.fixture(scope="module")
def items(texts):
    w = texts[3].split(" ")
    return [
        (1, " ".join(w[5:30])),
        (2, " ".join(w[20:26]).upper()),
        (2, " ".join(w[40:60])),
        (3, texts[4][100:400]),
        (None, "ONE two"),
        (5, None),
        (6, "..."),
        (7, " ".join(w[10:25])),
        (8, texts[10]),
    ]


@pytest.mark.parametrize("n", [3, 10])
def test_find_items(spark, docs, texts, items, n):
    df = spark.createDataFrame(items, "item_id long, text string")
    check_hits(docs, texts, items, df, n)
    check_hits(docs, texts, items, df, n, slice_bytes=60)


def test_single_words_and_random_items(spark):
    rnd = random.Random(8)
    draw = lambda k: " ".join(rnd.choices("abc", k=k))
    texts = {i: draw(rnd.randint(0, 40)) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, sizes in ((4, (3, 12)), (3, (1, 2, 6)), (6, (1, 9))):
        items = [(k, draw(s) + " " + "xyz"[: s % 2]) for k, s in enumerate(sizes * 2)]
        check_hits(df, texts, items, spark.createDataFrame(items, "item_id long, text string"), n)


def test_remove_items(spark, docs, no_docs, texts, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    found = remove_items(docs, df, 10, 0.5)
    rows = {r.doc_id: r for r in found.collect()}
    hits = brute_hits(texts, items, 10)
    assert found.columns == docs.columns
    assert rows.keys() == {i for i, (h, _) in hits.items() if sum(h) <= 0.5 * len(h)}
    for i, r in rows.items():
        assert plain_words(r.text) == [w for w, h in zip(plain_words(texts[i]), hits[i][0], strict=True) if not h]
        if not any(hits[i][0]):
            assert r.text == texts[i]
    assert remove_items(no_docs, df).count() == 0 and remove_items(docs, df.limit(0)).count() == len(texts)


def test_decontamination_query(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op9_decontamination"](spark, SF_DIR).collect()}
    for i, (hit, names) in brute_hits(texts, items, 10).items():
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected = (i, len(hit), sum(hit), len(names), digest, any(hit))
        assert tuple(found[i]) == expected
    assert any(r.contaminated for r in found.values())


# --- quality ----------------------------------------------------------------------------------------------------------------


def test_votes_are_those_of_the_nearest():
    rng = np.random.default_rng(2)
    rows, labels = rng.random((60, quality.BUCKETS)).astype(np.float32), rng.integers(0, 2, 60)
    model = quality._model(rows, labels)
    for given, score in zip(rows[:20], model.scores(rows[:20]), strict=True):
        own = model.latent(given[None])[0]
        cosine = [float(own @ v) for v in model.vectors]
        near = sorted(range(60), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        weight = [max(cosine[k], 0) ** 4 for k in near]
        assert score == pytest.approx(sum(w * labels[k] for w, k in zip(weight, near, strict=True)) / sum(weight), abs=1e-4)


def test_features_see_whole_texts():
    texts = ["", None, "a a a a", "A!! B!!", "x" * 100 + "\n" + "b" * 100]
    found = quality.features(pa.array(texts))
    assert found.shape == (5, quality.BUCKETS) and not found[:2].any() and found[2:].any(1).all()
    assert np.allclose(found[3], quality.features(pa.array([texts[3]]))[0])


def test_held_out_accuracy(spark):
    found = QUERIES["op3_quality"](spark, "/root/testdata/sf0.01")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows) > 0
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_judging_odd_documents(spark, docs, no_docs, texts):
    labels = spark.createDataFrame([(i, int(i != 11)) for i in texts if i is not None] + [(None, 1), (0, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert found.keys() == texts.keys() and all(0 <= r.score <= 1 for r in found.values()) and not found[None].held_out
    assert found[0].score == found[1].score and found[5].score == found[6].score
    assert quality.judge(no_docs, labels).count() == 0
    assert {r.score for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


# --- pipeline ---------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-dedup", "suffix dedup", "decontamination", "sentencepiece"]
    names = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    found = corpus_pipeline.run(spark, SF_DIR)
    rows = found.collect()
    assert found.columns == [*names, "piece_ids"] and 0 < len({r.doc_id for r in rows}) == len(rows) < 200
    judged = {r.doc_id for r in QUERIES["op3_quality"](spark, SF_DIR).filter("predicted = 1").collect()}
    assert {r.doc_id for r in rows} <= judged
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in rows}
    assert not any(any(h) for h, _ in brute_hits(texts, items, 10).values())
    seen = Counter(w for t in texts.values() for w in {tuple(p) for p in _windows(t.split(), 60)})
    assert not [w for w, n in seen.items() if n > 1]
    assert all(bool(r.text) == bool(r.piece_ids) for r in rows)


def _windows(w, n):
    return (w[k : k + n] for k in range(len(w) - n + 1))


def test_stages_take_odd_documents(spark, docs, no_docs):
    for given, some in ((docs, True), (no_docs, False)):
        rows = given
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF_DIR)
            assert rows.columns[: len(docs.columns)] == docs.columns, name
        assert (rows.count() > 0) == some


def test_registered_names():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_twins(spark, name):
    import duckdb

    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = duck.execute(SQL[name])
    names, expected = [d[0] for d in result.description], sorted(result.fetchall())
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns == names and sorted(map(tuple, df.collect())) == expected


def test_an_id_on_many_rows_is_learned_from_once(spark, monkeypatch):
    texts = [(i, f"{'good words here ' if i % 2 else 'x7 #9 '}{i}") for i in range(40)]
    hot = [(3, f"text number {i} of one id") for i in range(300)]
    df = spark.createDataFrame(texts + hot, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen, real = [], quality._model
    monkeypatch.setattr(quality, "_model", lambda rows, own: seen.append((len(rows), own.sum())) or real(rows, own))
    model = quality.fit(df, labels)
    assert seen == [(40, 20)] and len(model.vectors) == 40


def test_sketches_of_short_texts(spark):
    """Of texts of some ten bytes many have no hash below the threshold."""
    rnd = random.Random(11)
    long = "".join(rnd.choices("abcdefgh ", k=3000))
    pairs = []
    for n in range(12, 64, 2):
        for at in rnd.sample(range(2000), 6):
            pairs.append((len(pairs), long[at : at + n], "".join(rnd.choices("xyz", k=n))))
    ids = spark.createDataFrame(pairs, "doc_id long, a string, b string")
    sketch = lambda text, name: sketches(ids.selectExpr("doc_id", f"{text} text"), name)
    joined = sketch("a", "a").join(sketch("b", "b"), "doc_id").join(sketch("concat(a, b)", "ab"), "doc_id")
    whole = sketches(spark.createDataFrame([(0, long)], "doc_id long, text string"), "w").select("w").first().w
    joined = joined.withColumn("w", F.array(*map(F.lit, whole)))
    rows = joined.select("a", "b", containment("a", "w").alias("c"), merged("a", "b").alias("m")).collect()
    limit, bare = 1 << 28, 0
    for r in rows:
        own = [h for h in r.a if h < limit]
        bare += not own
        assert r.c == (1.0 if own else None)
        both = sorted(set(r.a) | set(r.b))
        assert r.m == ([h for h in both if h < limit] or both[:1])
    assert 10 < bare < len(rows) - 10
