"""Nearest neighbours against a scan of all vectors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metagauge.llm import neighbours
from metagauge.llm.queries import QUERIES
from metagauge.llm.tables import table

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, is_query, k):
    """By row number of each query: (score, vec_id) of the k best other rows."""
    usable = [
        (i, v, np.array(x, dtype=np.float64))
        for i, (v, x) in enumerate(rows)
        if x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x)
    ]
    width = max((len(x) for _, _, x in usable), default=0)
    padded = np.array([np.concatenate([x, np.zeros(width - len(x))]) for _, _, x in usable])
    out = {}
    for at, (i, v, _) in enumerate(usable):
        if v is not None and is_query(v):
            scores = (padded * padded[at]).sum(axis=1)
            order = sorted((-s, w is None, w or 0) for (j, w, _), s in zip(usable, scores, strict=True) if j != i)
            out.setdefault(v, []).append([(-s, None if missing else w) for s, missing, w in order[:k]])
    return out


def answers(df):
    """By query the ranked lists; rows with equal ids each have one."""
    found = {}
    for r in df.collect():
        found.setdefault(r.query_id, {}).setdefault(r.rank, []).append((r.score, r.vec_id))
    return found


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)


def ask(spark, rows, k=20, every=5, **more):
    return answers(neighbours.nearest(frame(spark, rows, **more), F.col("vec_id") % every == 0, k))


def recall(found, expected):
    hit = total = 0
    for query, lists in expected.items():
        for wanted in lists:
            total += len(wanted)
            hit += len({v for _, v in wanted} & {v for cells in found[query].values() for _, v in cells})
    return hit / total


def check_lists(found, expected, k):
    assert found.keys() == {q for q, lists in expected.items() if lists[0]}
    for query, lists in expected.items():
        ranks = found.get(query, {})
        assert sorted(ranks) == list(range(1, len(lists[0]) + 1))
        scores = [ranks[r][0][0] for r in sorted(ranks)]
        assert scores == sorted(scores, reverse=True) and len(scores) <= k


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(1)
    near = (np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    codes = np.concatenate([rng.integers(0, 2**63, 3000).astype(np.uint64), near, near[:5]])
    part = neighbours.Part(codes)
    for code in (codes[0], near[0], np.uint64(0), np.uint64(0x0123456789ABCDEF)):
        for radius in (0, 1, 7, 8, 13, 20, 27, 31, 40, 63, 64):
            expected = np.flatnonzero(np.bitwise_count(codes ^ code) <= radius)
            assert part.within(code, radius).tolist() == expected.tolist()


def test_learned_codes_bring_neighbours_near():
    rng = np.random.default_rng(2)
    clusters = rng.normal(size=(40, 32)) * 3
    sample = clusters[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 32)) * 0.3
    codes = neighbours.learn(sample, float(neighbours.lengths(sample).max()), 10)
    assert 0 < codes.radius < 20  # of 33 signs
    assert len(neighbours.Part(codes.of_vectors(sample)).within(codes.of_queries(sample[:1])[0], codes.radius)) < 1000


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_and_order(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 24)) * rng.uniform(0.2, 3, size=(900, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(neighbours, "PART", 200)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    found, expected = ask(spark, rows, kind=kind), brute(rows, lambda v: v % 5 == 0, 20)
    check_lists(found, expected, 20)
    assert recall(found, expected) >= 0.95
    by_id = dict(rows)
    for query, ranks in found.items():
        for r in ranks.values():
            (score, vec_id), = r
            assert vec_id != query
            exact = float((np.array(by_id[query]) * np.array(by_id[vec_id])).sum())
            assert math.isclose(score, exact, rel_tol=1e-12, abs_tol=1e-12)


def test_a_small_radius_falls_back_to_all_codes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)).astype(np.float32))]
    learn = neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda *a: neighbours.Codes(*list(vars(learn(*a)).values())[:3], 0))
    found = ask(spark, rows)
    expected = brute(rows, lambda v: v % 5 == 0, 20)
    assert recall(found, expected) == 1.0
    check_lists(found, expected, 20)


def test_copies_ties_and_odd_rows(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 2.0, 1.0]
    rows = [(i, a) for i in range(60)] + [(i, b) for i in range(60, 70)] + [(None, a), (None, [9.0, 0.0, 0.0]), (5, a), (5, b)]
    rows += [(100, None), (105, [0.0, 0.0, 0.0]), (110, [1.0, None, 2.0]), (115, [float("nan"), 1.0, 1.0]), (120, []), (125, [3.0])]
    rows += [(130, [float("inf"), 0.0, 0.0]), (135, [-1.0, -1.0, -1.0])]
    found = ask(spark, rows)
    expected = brute(rows, lambda v: v % 5 == 0, 20)
    assert found.keys() == expected.keys() and 5 in found and len(expected[5]) == 3
    for query, lists in expected.items():
        for rank, cells in found[query].items():
            wanted = sorted((lst[rank - 1] for lst in lists), key=str)
            got = sorted(cells, key=str)
            assert [v for _, v in got] == [v for _, v in wanted], (query, rank)
            assert all(math.isclose(s, t, rel_tol=1e-12) for (s, _), (t, _) in zip(got, wanted, strict=True))


def test_few_rows_and_none(spark):
    one = [(0, [1.0, 0.0])]
    assert ask(spark, one) == {} and ask(spark, []) == {} and ask(spark, [(3, [1.0])]) == {}
    two = ask(spark, one + [(7, [0.5, 0.5])])
    assert two == {0: {1: [(0.5, 7)]}}


def test_other_columns_may_clash(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0], i, "x") for i in range(6)], "vec_id int, embedding array<float>, v int, q string")
    found = answers(neighbours.nearest(df, F.col("vec_id") == 0, 2))
    assert found == {0: {1: [(7.0, 5)], 2: [(6.0, 4)]}}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF_DIR, "embeddings").collect()]
    found = answers(QUERIES["op13_neighbours"](spark, SF_DIR))
    expected = brute(rows, lambda v: v % 20 == 0, 20)
    check_lists(found, expected, 20)
    assert recall(found, expected) >= 0.95
