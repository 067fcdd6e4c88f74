"""Near-duplicates, repeated passages and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from metagauge.llm import near_dedup as nd
from metagauge.llm import repeats
from metagauge.llm.components import components
from metagauge.llm.queries import QUERIES
from metagauge.llm.repeats import KEY_WORDS, _Windows, find_repeats, remove_repeats
from tests.llm.conftest import prose

SF_DIR = "/root/testdata/sf0.001"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]


def brute_components(texts, n, percent=80):
    sets = {}
    for i, t in texts.items():
        w = words((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in texts}
    key = lambda i: (i is not None, i or 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts, key=key)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                p, q = sorted((top(a), top(b)), key=key)
                root[q] = p
    return {i: (len(sets[i]), top(i), top(i) == i) for i in texts}


def as_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, texts, n):
    assert as_rows(nd.near_duplicates(docs, n)) == brute_components(texts, n)


def variants(n_words, n_variants, n_edits, seed):
    """Edited copies of one text that is not among them: alike to it, often not to each other."""
    rnd, base = random.Random(seed), prose(seed, n_words).split(" ")
    out = []
    for i in range(n_variants):
        own = list(base)
        for at in rnd.sample(range(n_words), n_edits):
            own[at] = f"edit{i}x{at}"
        out.append(" ".join(own))
    return out


def test_a_group_without_its_centre(spark):
    texts = dict(enumerate(variants(100, 60, 4, 1) + variants(60, 40, 3, 2) + [prose(50 + i, 60) for i in range(30)]))
    texts[500] = prose(1, 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_components(texts, 2)
    assert 30 < len({c for _, c, _ in expected.values()}) < len(texts)
    assert as_rows(nd.near_duplicates(df, 2)) == expected
    assert as_rows(nd.near_duplicates(df, 2, block=nd.LEAST * 4)) == expected  # many blocks a band


def test_shared_counts():
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(k)] for k in (5, 7))
    expected = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert nd._shared(x, y).tolist() == expected


def test_posterior_bounds():
    least = nd.least_matches(0.8, 1e-6)
    assert least == sorted(least) and all(0 < m < 0.8 * 32 * (i + 1) for i, m in enumerate(least))
    rng = np.random.default_rng(1)
    for i, m in enumerate(least):  # of links at the limit hardly any falls below
        assert (rng.binomial(32 * (i + 1), 0.8, 20_000) < m).sum() <= 5


def test_keep_one_of_each(docs, no_docs, texts):
    found = nd.keep_one_of_each(docs, 5)
    kept = {i for i, (_, _, k) in brute_components(texts, 5).items() if k}
    assert found.columns == docs.columns and {r.doc_id for r in found.collect()} == kept
    assert nd.keep_one_of_each(no_docs).count() == 0
    twice = nd.near_duplicates(docs.union(docs), 5)
    assert twice.count() == 2 * len(texts) and as_rows(twice) == brute_components(texts, 5)


def test_keep_one_row_of_each_whatever_its_id(spark):
    """Copies under null ids, repeated rows, and an id on two texts."""
    shared, repeated, own, many = (prose(400 + i, 60) for i in range(4))
    near = many.split(" ")
    near[30] = "changed"
    rows = [(1, shared, "a"), (2, shared, "b"), (2, own, "c"), (3, repeated, "d"), (3, repeated, "d"), (3, repeated, "d")]
    rows += [(None, many, "e"), (None, many, "f"), (None, many, "f"), (None, " ".join(near), "g"), (9, many, "h")]
    rows += [(None, None, "i"), (4, "", "j"), (5, own + " end of another text " + prose(410, 60), "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    found = [tuple(r) for r in nd.keep_one_of_each(df, 5).collect()]
    of_many = [r for r in found if r[2] in "efgh"]
    assert len(of_many) == 1 and of_many[0] in rows and of_many[0][0] is None
    expected = [rows[0], rows[2], rows[3], *rows[-3:]]
    assert sorted(map(str, found)) == sorted(map(str, expected + of_many))
    assert of_many == [tuple(r) for r in nd.keep_one_of_each(df.repartition(2), 5).collect() if r.lang in "efgh"]


def test_query_on_the_given_documents(spark):
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert as_rows(QUERIES["op10_near_dedup"](spark, SF_DIR)) == brute_components(given, 2)


def test_components(spark):
    rnd = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    df = spark.createDataFrame(links + links[:5] + [(7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(df).collect()} == {i: top(i) for i in root}
    assert components(df.limit(0)).count() == 0


# --- repeated passages ----------------------------------------------------------------------------------------------------


def brute_repeats(texts, order, n):
    """By id: which words are in a window that comes earlier; whole copies of a text with a smaller id are all repeats."""
    key = lambda i: (i is not None, i or 0)
    first_copy, out, seen = {}, {}, set()
    for i in sorted(texts, key=key):
        w = tuple(words(texts[i]))
        if len(w) >= n and first_copy.setdefault(w, i) != i:
            out[i] = [True] * len(w)
    for i in sorted((i for i in texts if i not in out), key=order):
        w = words(texts[i])
        out[i] = [False] * len(w)
        for p in range(len(w) - n + 1):
            window = tuple(w[p : p + n])
            if window in seen:
                out[i][p : p + n] = [True] * n
            seen.add(window)
    return out


def check_repeats(df, texts, n):
    found = {(None if r.key < 0 else r.key): r for r in find_repeats(df, n, key_words=5).collect()}
    expected = brute_repeats(texts, lambda i: found[i].id, n)
    for i, marks in expected.items():
        own = [False] * len(marks)
        for s in found[i].spans:
            own[s.first : s.last] = [True] * (s.last - s.first)
        assert own == marks, i
        assert found[i].n_words == len(marks)
    return expected


@pytest.mark.parametrize("n", [12, 50])
def test_find_repeats(docs, texts, n):
    marks = check_repeats(docs, texts, n)
    assert any(marks[3]) != any(marks[4])  # of the passage in both one stays
    assert marks[11] == [False] + [True] * 2999  # of a text that repeats itself one period stays


def test_what_a_neighbour_alone_would_miss(spark):
    """Passages that begin alike at a minimiser and differ before it."""
    rnd = random.Random(9)
    heads, tail = [prose(60 + i, 9) for i in range(6)], prose(70, 9)
    texts = dict(enumerate(f"{prose(200 + i, 12)} {rnd.choice(heads)} {tail} {prose(300 + i, 12)}" for i in range(40)))
    check_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, 15)


@pytest.mark.parametrize("range_rows", [7, 40])
def test_runs_over_many_ranges(spark, monkeypatch, range_rows):
    """A hot passage, whole or cut off on either side, between words that differ or are shared in part; long words."""
    monkeypatch.setattr(repeats, "RANGE_ROWS", range_rows)
    rnd, passage = random.Random(4), prose(80, 30).split(" ")
    passage[12] = "x" * 5_000
    befores, afters = ([prose(900 + 10 * k + i, 9).split(" ") for i in range(4)] for k in range(2))
    texts = {}
    for i in range(60):
        a, b = rnd.choice([0, 0, 0, 5, 9]), rnd.choice([30, 30, 30, 24, 19])
        before, after = rnd.choice(befores)[rnd.randrange(9) :], rnd.choice(afters)[: rnd.randrange(10)]
        texts[i] = " ".join([*prose(700 + i, 6).split(" "), *before, *passage[a:b], *after, *prose(800 + i, 6).split(" ")])
    texts[60] = " ".join(passage * 4)
    texts[61] = texts[8]
    texts[62] = "x" * 4_999 + "y " + texts[8]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    marks = check_repeats(df, texts, 15)
    assert sum(any(m) for m in marks.values()) > 50 and not all(any(m) for m in marks.values())


def test_places_alike_within_a_text_are_settled_there(spark, monkeypatch):
    """Words and lines that a text repeats over and over, alone and in several texts, with long words and cut off."""
    line, passage = prose(90, 7), prose(91, 40)
    texts = {i: f"{prose(920 + i, 12)} {'Osas ' * (150 + i)}{prose(940 + i, 5)}" for i in range(6)}
    texts |= {10 + i: f"{prose(960 + i, 9)} {(line + chr(10)) * (20 + i)}" for i in range(4)}
    texts |= {20: " ".join([passage] * 9), 21: passage + " " + prose(92, 30) + " " + passage, 22: "a b " * 60, 23: "a b " * 60 + "a"}
    texts |= {24: ("x" * 40 + " y ") * 50, 25: ("x" * 40 + " y ") * 50 + "z", 26: prose(93, 60), 27: "", 28: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sorted_rows, real = [], repeats._sorted

    def watched(df, count, *by):
        sorted_rows.append((df.count(), count))
        return real(df, count, *by)

    monkeypatch.setattr(repeats, "_sorted", watched)
    for n in (12, 50):
        sorted_rows.clear()
        marks = check_repeats(df, texts, n)
        assert sum(any(m) for m in marks.values()) >= 12
        # Of some 2,700 words each is a suffix, or each seventh of a line; most are like one before.
        assert sorted_rows[0][0] < 800 and sorted_rows[0][1] < 1_600


def test_words_that_two_suffixes_share():
    values = [b"", b"a b ", b"a b c ", b"a bb c ", b"a bb c ", b"a\x00 ", b"a\x00 \x00 ", b"a\x00 "]
    for together in (1, 2, 100):
        assert repeats._common(pa.array(values, pa.binary()), together).tolist() == [0, 0, 2, 1, 3, 0, 1, 1]


def test_rows_of_one_id_are_not_paired(spark, monkeypatch):
    texts = [prose(500 + i, 80) for i in range(40)]
    texts += [f"{t} {prose(600 + i, 40)}" for i, t in enumerate(texts[:20])] + [t + " end" for t in texts[20:30]]
    given = texts + texts[-15:]
    rows = [(None, t) for t in given] + [(7, texts[0]), (8, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    read, real = [], type(df).mapInArrow

    def watched(self, *more, **named):
        if {"text", "row"} & set(self.columns):
            read.append(self)
        return real(self, *more, **named)

    monkeypatch.setattr(type(df), "mapInArrow", watched)
    near = nd.near_duplicates(df, 2).collect()
    brute = brute_components(dict(enumerate(texts)), 2)
    size = {t: brute[i][0] for i, t in enumerate(texts)}
    assert sorted(r.n_shingles for r in near if r.doc_id is None) == sorted(size[t] for t in given)
    assert [(r.component_id, r.kept) for r in near if r.doc_id] == [(None, False)] * 2

    found = remove_repeats(df, 50).collect()
    ids = _Windows(pa.array(texts), 50, KEY_WORDS).ids()
    marks = brute_repeats(dict(enumerate(texts)), lambda i: ids[i], 50)
    left = {t: " ".join(w for w, m in zip(words(t), marks[i], strict=True) if not m) for i, t in enumerate(texts)}
    assert sorted(" ".join(words(r.text)) for r in found if r.doc_id is None) == sorted(left[t] for t in given)
    assert [r.text for r in found if r.doc_id] == ["", ""]
    assert len(read) >= 5 and all(frame.count() <= len(rows) for frame in read)


def test_remove_repeats(docs, no_docs, texts):
    found = remove_repeats(docs, 50)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.columns == docs.columns and rows.keys() == texts.keys()
    ids = {(None if r.key < 0 else r.key): r.id for r in find_repeats(docs, 50).collect()}
    for i, marks in brute_repeats(texts, ids.get, 50).items():
        assert words(rows[i].text) == [w for w, m in zip(words(texts[i]), marks, strict=True) if not m]
        if not any(marks):
            assert rows[i].text == texts[i]
        assert rows[i].n_chars == len(rows[i].text or "")
    assert rows[1].text == "" and rows[5].text is None
    assert remove_repeats(no_docs).count() == 0
