"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from metagauge.llm import runs
from metagauge.llm.queries import QUERIES
from metagauge.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def brute_lyndon(ranks):
    """From suffixes compared as lists: up to the next smaller one."""
    n = len(ranks)
    smaller = lambda i: next((j for j in range(i + 1, n) if ranks[j:] < ranks[i:]), n)
    return [smaller(i) - i for i in range(n)]


def brute_runs(words, min_words=6, min_exponent=4):
    """By period, the maximal stretches in which words so far apart are equal; the least period of a stretch counts."""
    n, found, taken = len(words), [], set()
    for q in range(1, n // min_exponent + 1):
        start = 0
        for i in range(n - q + 1):
            if i == n - q or words[i] != words[i + q]:
                end = i + q
                if end - start >= max(min_words, min_exponent * q) and (start, end) not in taken:
                    taken.add((start, end))
                    found.append((start, end - start, q))
                start = i + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(words, found):
    keep = [True] * len(words)
    for s, m, q in found:
        keep[s + q : s + m] = [False] * (m - q)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    highest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *highest, sha(lines), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k))


def draws(seed, n):
    """Words of few letters, powers of words, and powers within powers."""
    rnd = random.Random(seed)
    out = []
    while len(out) < n:
        letters = rnd.choice([1, 2, 3, 9])
        part = [rnd.randrange(letters) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 7)
        out += part * rnd.randint(1, 2) + part[: rnd.randint(0, len(part))]
    return out[:n]


def test_lyndon_arrays():
    for seed in range(300):
        ranks = draws(seed, 40)
        assert runs.lyndon_array(ranks) == brute_lyndon(ranks)
        inverse = [-r for r in ranks]
        assert runs.lyndon_array(inverse) == brute_lyndon(inverse)
    assert runs.lyndon_array([]) == []


@pytest.mark.parametrize("least", [(6, 4), (6, 3), (9, 5)])
def test_runs_of_numbers(least):
    some = 0
    for seed in range(300):
        words = draws(seed, 90)
        expected = brute_runs(words, *least)
        assert runs.runs_of(np.array(words), *least) == expected
        some += len(expected)
    assert some > 300


def test_runs_of_nested_and_alternating_words():
    fibonacci, step = [0], [0, 1]
    while len(step) < 600:
        fibonacci, step = step, step + fibonacci
    for words in (step, [0] * 700, [0, 1] * 300 + [0], list(range(60)) * 6, ([0] * 7 + [1]) * 30, list(range(300, 0, -1)) * 4):
        assert runs.runs_of(np.array(words)) == brute_runs(words)


def rows(df):
    columns = "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return df.select("row.doc_id", *columns).collect()


def test_find_runs(spark, docs, no_docs, texts):
    more = {i: " ".join(map(str, draws(i, 20 + 9 * i))) for i in range(200, 240)}
    given = texts | more | {300: "\x0b Ä b Ä b\x1c " * 5}
    df = docs.union(docs.where("doc_id in (5, 11)"))
    extra = [(i, t, "en", "src0", 0, 1, "k", "s", "n", 2.0, [1]) for i, t in given.items() if i not in texts]
    df = df.union(spark.createDataFrame(extra, docs.schema))
    found = runs.find_runs(df)
    assert found.count() == len(given) + 2
    expected = {i: brute_row(split(t), brute_runs(split(t))) for i, t in given.items() if i != 12}
    got = {r.doc_id: tuple(r)[1:] for r in rows(found)}
    assert {i: r for i, r in got.items() if i != 12} == expected
    assert expected[11][:5] == (1, 0, 3000, 1, 3_000_000) and expected[5][:2] == (0, None)
    assert sum(r[0] for r in expected.values()) > 40
    one = found.where("row.doc_id = 11").first()
    assert [tuple(r) for r in one.runs] == [(0, 3000, 1)] and one.n_words == 3000 and one.row.score == 2.0
    assert runs.find_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(docs, min_words=5)


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(6000)) + " end" * 9
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(runs, "PIECE_BYTES", 500)
    words = split(text)
    answers = list(runs._texts_runs([text.encode(), b"", b"one"], [1, 2, 3], None, 6, 4))
    assert [(n, r) for n, r, _ in answers] == [(6009, [(0, 6000, 700), (6000, 9, 1)]), (0, []), (1, [])]
    monkeypatch.undo()
    assert tuple(rows(runs.find_runs(df))[0])[1:] == brute_row(words, brute_runs(words))
    assert answers[0][2].hexdigest() == brute_row(words, brute_runs(words))[-1]


def test_query(spark):
    found = {r.doc_id: tuple(r) for r in QUERIES["op11_runs"](spark, SF_DIR).collect()}
    given = table(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    assert len(found) == len(given)
    for doc_id, text in given:
        words = split(text)
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n < 3000:
            assert found[doc_id][1:] == brute_row(words, brute_runs(words))
    assert sum(r[1] > 0 for r in found.values()) > 10
