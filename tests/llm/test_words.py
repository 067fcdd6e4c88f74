"""Word spans, hashes and shingles against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from metagauge.llm import words as w

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab B\n\tÉ日.'0\x00", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_spans_and_shingles(texts, n):
    data, borders = w.text_bytes(pa.array(texts, pa.string()))
    starts, ends, first = w.spans(data, borders, w.NOT_SPACE)
    expected = [[x for x in re.split("[\x20\x09-\x0d]+", t or "") if x] for t in texts]
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [x for t in expected for x in t]
    assert np.diff(first).tolist() == [len(t) for t in expected]
    hashed = w.hashes(data, starts, ends)
    assert len(set(zip(hashed.tolist(), found, strict=True))) == len(set(found)) == len(set(hashed.tolist()))
    runs, at = w.shingles(hashed, first, n)
    plain = [[tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))] if t else [] for t in expected]
    assert np.diff(at).tolist() == [len(t) for t in plain]
    flat = [x for t in plain for x in t]
    assert len(set(zip(runs.tolist(), flat, strict=True))) == len(set(flat)) == len(set(runs.tolist()))


def test_steps_cover_every_row_once():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 500, "", "c"]})
    parts = list(w.steps(batch, "text", 20))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
    assert list(w.steps(batch.slice(0, 0), "text")) == []


def test_without():
    assert w.without("ab é cd", [(0, 2)]) == "é cd"
    assert w.without("ab é cd", [(3, 5)]) == "ab  cd"
    assert w.without("ab", [(0, 2)]) == ""
