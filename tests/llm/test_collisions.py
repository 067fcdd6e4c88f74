"""Long texts of two letters that a polynomial modulo 2**64 can't tell apart, whatever its base."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from metagauge.llm import pieces
from metagauge.llm import words as w
from metagauge.llm.encoding import tokenizer
from metagauge.llm.near_dedup import near_duplicates
from metagauge.llm.queries import vocabulary
from metagauge.llm.repeats import remove_repeats
from metagauge.llm.token_counts import count_tokens
from metagauge.llm.token_files import read_token_files, write_token_files

SF_DIR = "/root/testdata/sf0.001"


def twins(a: str, b: str, between: str, n: int = 1024) -> tuple[str, str]:
    """The first n letters of the sequence of Thue and Morse, and the same with the letters exchanged."""
    order = [i.bit_count() % 2 for i in range(n)]
    return tuple(between.join((a, b)[x ^ side] for x in order) for side in (0, 1))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_and_sequences_have_hashes_of_their_own(n):
    one, other = twins("a", "b", "", n)
    data, borders = w.text_bytes(pa.array([one, other, one]))
    starts, ends, _ = w.spans(data, borders, w.NOT_SPACE)
    found = w.hashes(data, starts, ends)
    assert found[0] == found[2] != found[1]
    values = np.frombuffer((one + other + one).encode(), np.uint8).astype(np.uint64)
    places = np.arange(3) * n
    found = w.sequence_hashes(values, places, places + n)
    assert found[0] == found[2] != found[1]


def test_ids_of_twins(spark, tmp_path):
    texts = [*twins("a", "b", ""), *twins("x", "yy", ""), " ".join(twins("q", "e", ""))]
    df = frame(spark, texts)
    coder = tokenizer(vocabulary("word_bpe_49k.json"))
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, vocabulary("word_bpe_49k.json")).collect()}
    assert counts == {i: len(coder.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts, 1)}
    coder = tokenizer(vocabulary("byte_bpe_50k.json"))
    write_token_files(df, vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/ids", end_id=0)
    found = {r.doc_id: r.n_tokens for r in read_token_files(spark, f"file://{tmp_path}/ids").collect()}
    assert found == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts, 1)}
    decoded = pieces.encode_and_decode(df, vocabulary("piece_bpe_32k.model"))
    assert {r.doc_id: r.text for r in decoded.collect()} == dict(enumerate(texts, 1))


def test_unlike_twins_are_not_linked_or_cut(spark):
    words = twins("a", "b", "")
    assert {tuple(r) for r in near_duplicates(frame(spark, words), 2).collect()} == {(1, 1, 1, True), (2, 1, 2, True)}
    # Of the sequences of words all windows repeat, but neither is a copy of the other.
    one, other = twins("left", "right", " ")
    texts = [one + " end", other + " stop", one + " end"]
    left = {r.doc_id: r.text for r in remove_repeats(frame(spark, texts), 50).collect()}
    assert left[3] == "" and left[1].endswith("end") and left[2].endswith("stop")
