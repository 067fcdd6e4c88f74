"""Token counts, token files and pieces against the libraries themselves."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from metagauge.llm import encoding, token_files
from metagauge.llm.pieces import Model, decode, encode, round_trip
from metagauge.llm.queries import vocabulary
from metagauge.llm.token_counts import count_tokens
from metagauge.llm.words import text_bytes

BYTE, WORD, PIECE = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["a", "B.", "b,c", "'s", " ", "  ", "\n", "\t", " \n", "x\ny", "é", "́", "Σ", "\x1c", "\x85", "　", "1", "23", "!!"]
ODD += ["<|endoftext|>", "<|startoftext|>", " x", " ", "한", "ß", "'", "<|", "İ", "ǅ", "\0", "ª", "à ", "▁", "𝔘"]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 14))) for _ in range(8000)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_have_the_ids_of_whole_texts(odd_texts, path):
    data, borders = text_bytes(pa.array(odd_texts))
    cut = encoding.dropped_space_pieces(data, borders) if path == WORD else encoding.byte_level_pieces(data, borders, path)
    coder = encoding.Encoder(path)
    at, n = coder.find(data, *cut[:2])
    ids, per_text = coder.table.gather(at, n), encoding.sums(n, cut[2])
    expected = [e.ids for e in encoding.tokenizer(path).encode_batch(odd_texts, add_special_tokens=False)]
    assert per_text.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for e in expected for i in e]


def test_forgetting_changes_nothing(odd_texts, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 50)
    data, borders = text_bytes(pa.array(odd_texts[:300]))
    starts, ends, first = encoding.dropped_space_pieces(data, borders)
    coder = encoding.Encoder(WORD)
    for _ in range(2):
        n = encoding.sums(coder.find(data, starts, ends)[1], first)
        assert n.tolist() == [len(encoding.tokenizer(WORD).encode(t, add_special_tokens=False)) for t in odd_texts[:300]]


def test_counts(docs, no_docs, texts):
    coder = encoding.tokenizer(WORD)
    expected = {i: (len((t or "").encode()), len(coder.encode(t or "", add_special_tokens=False))) for i, t in texts.items()}
    found = count_tokens(docs, WORD, limit=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == expected and len(found) == len(texts)
    assert all(r.over_limit == (r.n_tokens > 100) for r in found)
    assert count_tokens(no_docs, WORD).count() == 0
    assert count_tokens(docs.union(docs), WORD).count() == 2 * len(texts)


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
def test_packing(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        packed = token_files.pack(ids, width)
        assert len(packed) == -(-n // 64) * 8 * width
        assert token_files.unpack(packed, width, n).tolist() == ids.tolist()
        plain = sum(int(v) << (i * width) for i, v in enumerate(ids.tolist()))
        assert int.from_bytes(packed, "little") == plain


def test_widths():
    assert [token_files.width_of(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]


def test_token_files(spark, docs, no_docs, texts, tmp_path):
    coder = encoding.tokenizer(BYTE)
    folder = f"file://{tmp_path}/ids"
    index = token_files.write_token_files(docs, BYTE, folder).collect()
    start, expected = 0, {}
    for i in sorted(texts, key=lambda i: (i is not None, i or 0)):
        ids = [*coder.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        expected[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    found = token_files.read_token_files(spark, folder).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected and len(found) == len(texts)
    assert sum(r.n_ids for r in index) == start
    place, _ = token_files._place(folder)
    file = token_files.TokenFile(place, max(index, key=lambda r: r.n_ids).path)
    whole = file.ids(0, file.n_ids)
    for a, b in ((0, 1), (5, 5), (100, 400), (file.n_ids - 3, file.n_ids)):
        assert file.ids(a, b).tolist() == whole[a:b].tolist()

    token_files.write_token_files(no_docs, BYTE, f"{folder}-none")
    assert token_files.read_token_files(spark, f"{folder}-none").count() == 0


def test_blocks_of_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 128)
    place, root = token_files._place(f"file://{tmp_path}")
    with place.open_output_stream(f"{root}/x.bin") as out:
        writer = token_files._Writer(out, 11)
        for n in (3, 500, 0, 128):
            writer.add(np.arange(n, dtype=np.uint32))
            writer.doc_ids.append(np.array([n]))
            writer.n_tokens.append(np.array([n]))
        writer.end()
    file = token_files.TokenFile(place, f"{root}/x.bin")
    assert file.ids(0, file.n_ids).tolist() == [*range(3), *range(500), *range(128)]
    assert file.ids(400, 510).tolist() == [*range(397, 500), *range(7)]


def test_sentencepiece_ids_are_those_of_the_library(odd_texts):
    import sentencepiece

    from metagauge.llm.encoding import PieceTable

    model, library = Model(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rnd = random.Random(1)
    names = [n for n in model.names if n.isprintable()]
    texts = odd_texts + ["".join(rnd.choices(names, k=rnd.randint(1, 9))).replace("▁", " ") for _ in range(4000)]
    ids, first = model.encode(texts, PieceTable())
    expected = library.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == expected
    assert model.decode(ids, first) == [library.decode(e) for e in expected]


def test_unigram_search_has_the_best_sum():
    model = Model(PIECE)
    model.unigram = True
    rnd = random.Random(2)
    for length in (1, 3, 7):
        words = ["".join(rnd.choices("▁theinato", k=length)) for _ in range(40)]
        points = np.array([[ord(c) for c in x] for x in words], np.uint32)
        for word, found in zip(words, model.viterbi(points), strict=True):
            best = {0: 0.0}
            for e in range(1, length + 1):
                best[e] = max(best[s] + model.score[model.id_of[word[s:e]]] for s in range(e) if word[s:e] in model.id_of)
            assert sum(model.score[i] for i in found) == best[length]
            assert "".join(model.names[i] for i in found) == word


def test_sentencepiece_round_trip(docs, no_docs, texts):
    found = {r.doc_id: r for r in round_trip(docs, PIECE).collect()}
    assert found.keys() == texts.keys() and all(r.same for r in found.values())
    assert found[5].n_tokens == found[6].n_tokens == 0
    encoded = encode(docs, PIECE, "hits")  # replaces a column
    assert encoded.columns[-1] == "hits" and sorted(encoded.columns) == sorted(docs.columns)
    back = decode(encoded, PIECE, "hits", "back")
    assert {r.doc_id: r.back for r in back.collect()} == {i: t or "" for i, t in texts.items()}
    assert round_trip(no_docs, PIECE).count() == 0 and encode(no_docs, PIECE).count() == 0
