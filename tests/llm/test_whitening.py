"""Whitening against numpy over all distinct vectors at once."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from metagauge.llm import whitening
from metagauge.llm.queries import QUERIES, whole_numbers
from metagauge.llm.tables import table
from metagauge.llm.vectors import finite

SF_DIR = "/root/testdata/sf0.001"


def frame(spark, vectors, kind="bigint"):
    return spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, x array<{kind}>").repartition(3)


def brute(vectors, components=16, weight="one"):
    """By vector: n, deviation, whitened up to the sign, share."""
    counted = Counter(map(tuple, vectors))
    width = max(map(len, counted))
    distinct = [list(v) + [0] * (width - len(v)) for v in counted]
    w = [1 if weight == "one" else c for c in counted.values()]
    n = sum(w)
    sums = [sum(a * v[j] for a, v in zip(w, distinct, strict=True)) for j in range(width)]
    deviation = [sum((n * v[j] - sums[j]) ** 2 for j in range(width)) for v in distinct]
    c = np.array([[(n * v[j] - sums[j]) / n for j in range(width)] for v in distinct])
    covariance = (c * np.array(w)[:, None]).T @ c / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    white = c @ u / np.sqrt(np.where(e > 1e-9, e, np.inf))
    return {v: (n, deviation[i], white[i], e / np.trace(covariance)) for i, v in enumerate(counted)}


def check(df, vectors, **more):
    found = df.collect()
    expected = brute(vectors, **more)
    components = min(more.get("components", 16), max(map(len, vectors)))
    assert len(found) == components * len(vectors)
    signs = {}
    for r in found:
        n, deviation, white, share = expected[tuple(vectors[r.vec_id])]
        k = r.component - 1
        assert (r.n, r.deviation) == (n, deviation if deviation < 2**63 else None)
        assert math.isclose(r.explained, share[k], rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(abs(r.whitened), abs(white[k]), rel_tol=1e-6, abs_tol=1e-6)
        if abs(white[k]) > 1e-3:
            assert signs.setdefault(k, r.whitened * white[k] > 0) == (r.whitened * white[k] > 0)
        assert r.identity_error < 1e-6
    return found


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    mixed = rnd.normal(size=(150, 20)) @ rnd.normal(size=(20, 20)) * 9 + 1_000_000
    out = np.floor(mixed).astype(int).tolist()
    return out + [out[0]] * 90 + out[5:25]


@pytest.mark.parametrize("weight", ["one", "count"])
@pytest.mark.parametrize("components", [3, 16, 64])
def test_whiten(spark, vectors, weight, components):
    components = min(components, 20)
    check(whitening.whiten(frame(spark, vectors), components, weight), vectors, components=components, weight=weight)


def test_counts_change_the_fit(vectors):
    key = tuple(vectors[0])
    assert brute(vectors)[key][:2] == (150, brute(vectors)[key][1]) and brute(vectors, weight="count")[key][0] == 260


def test_many_rows_of_one_vector_join_back(spark, vectors):
    many = vectors[:30] + [vectors[7]] * 2000
    df = whitening.whiten(frame(spark, many), 2)
    check(df, many, components=2)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Cartesian" not in plan


def test_edges(spark):
    assert whitening.whiten(frame(spark, [None, []])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    one = whitening.whiten(frame(spark, [[5, 7], None, [5, 7]])).collect()
    assert sorted(tuple(r) for r in one) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (0, 2) for k in (1, 2)]
    line = whitening.whiten(frame(spark, [[1, 1], [3, 3], [5, 5]])).collect()  # one direction has no variance
    assert all(r.whitened == 0 and r.explained == 0 for r in line if r.component == 2)
    assert all(r.identity_error < 1e-9 for r in line)
    assert sorted(abs(round(r.whitened, 6)) for r in line if r.component == 1) == [0, 1.224745, 1.224745]
    ragged = [[1, 2, 3], [4], [], [7, 7]]
    check(whitening.whiten(frame(spark, ragged), 2), ragged, components=2)
    huge = [[2**62, -(2**61)], [-(2**62), 3], [2**60, 5]]
    check(whitening.whiten(frame(spark, huge), 1), huge, components=1)
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, huge), weight="none")


def test_other_columns_stay(spark):
    given = spark.createDataFrame([(1, [1, 2], "a", 0.5), (2, [3, 1], "b", None)], "vec_id int, x array<int>, at string, row double")
    rows = whitening.whiten(given, 1).collect()
    assert sorted((r.vec_id, r["at"], r.row) for r in rows) == [(1, "a", 0.5), (2, "b", None)]


def test_finite_vectors(spark):
    given = [None, [], [1.0], [None], [float("nan")], [float("-inf"), 1.0], [3e38, 0.0]]
    for kind in ("float", "double"):
        df = frame(spark, given, kind)
        assert sorted(r.vec_id for r in df.where(finite("x")).collect()) == [1, 2, 6]


def test_query(spark):
    given = table(spark, SF_DIR, "embeddings").select("vec_id", "embedding").collect()
    vectors = {r.vec_id: [math.floor(64 * c) + 1_000_000 for c in r.embedding] for r in given}
    order = sorted(vectors)
    assert order == list(range(len(order)))
    check(QUERIES["op12_whitening"](spark, SF_DIR), [vectors[i] for i in order])


def test_query_with_odd_rows(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, [rnd.random() for _ in range(4)], 1) for i in range(40)]
    rows += [(None, rows[3][1], 2), (41, rows[3][1], 2), (42, None, 3), (43, [1.0, None, 0.0, 0.0], 3), (44, [float("nan")] * 4, 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op12_whitening"](spark, str(tmp_path)).collect()
    assert len(found) == 42 * 4 and {r.n for r in found} == {len({tuple(whole) for whole in _floors(rows[:40])})}
    assert sum(r.vec_id is None for r in found) == 4
    wide = spark.createDataFrame([(1, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert [r.x for r in whole_numbers(wide).collect()] == [[2**62 + 1_000_000, -(2**62) + 1_000_000]]


def _floors(rows):
    return [[math.floor(64 * float(np.float32(c))) for c in v] for _, v, _ in rows]
