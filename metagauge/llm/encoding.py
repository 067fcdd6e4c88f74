"""Encoding with the tokenizers library by pieces that a text may be cut into without changing its ids.

Both vocabularies begin a new pre-token at a space before other text, so what stands between spaces is encoded alone. Pieces
repeat within a batch and between batches: each is encoded once per worker and found by its 64-bit hash from then on.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from metagauge.llm.words import hashes, spans

#: Pieces that a worker remembers; beyond, it begins anew. Bounds memory, never results.
REMEMBERED = 800_000
#: Longer words go through the whole tokenizer.
LONG_PIECE = 200
_SPACE = 0x20
_ASCII_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
_NOT_SPACE = ~np.isin(np.arange(256), [0x20, 0x0A])
_ASCII_TEXT = np.isin(np.arange(256), range(0x21, 0x7F))
_ASCII_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_STOP = np.isin(np.arange(256), [0x2E, 0x2C])
#: White space outside ASCII. Fixed values of Unicode.
_WIDE_SPACE = np.array([0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
_WIDE_SPACE_BYTES = np.array([int.from_bytes(chr(c).encode(), "big") for c in _WIDE_SPACE])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size(with_added_tokens=True)


@lru_cache(maxsize=4)
def _letters(path: str) -> tuple[dict[int, str], frozenset[str]]:
    """How the vocabulary's own normalizer and byte alphabet spell a space and each plain Latin letter; and those letters."""
    coder = tokenizer(path)
    spelled = {32: "Ġ"}
    for c in map(chr, range(0x41, 0x250)):
        if c.isalpha() and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1:
            plain = coder.normalizer.normalize_str(c) if coder.normalizer else c
            spelled[ord(c)] = "".join(x for x, _ in coder.pre_tokenizer.pre_tokenize_str(plain))
    return spelled, frozenset(map(chr, spelled)) - {" "}


def piece_encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a piece. A word of plain letters goes to the vocabulary's model at once; anything else goes through the whole
    tokenizer."""
    coder, model = tokenizer(path), tokenizer(path).model
    spelled, letters = _letters(path)
    folds = coder.normalizer is not None

    def encode(piece: str) -> list[int]:
        core = piece[1:] if piece[:1] == " " else piece
        if core.isalpha() and len(core) <= LONG_PIECE:
            if core.isascii() and not folds:
                return [t.id for t in model.tokenize("Ġ" + core if core is not piece else core)]
            if letters.issuperset(core):
                return [t.id for t in model.tokenize(piece.translate(spelled))]
        return coder.encode(piece, add_special_tokens=False).ids

    return encode


class PieceTable:
    """The ids of the pieces met so far: sorted hashes, and for each where its ids begin in one long array, and how many."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = self.used + np.cumsum(n) - n
        need = self.used + int(n.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.ids[self.used : need] = np.fromiter((i for x in found for i in x), np.uint32, need - self.used)
        self.used = need
        return at, n

    def find(self, hashed: np.ndarray, encode: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, given by its hash: where its ids begin in ``self.ids``, and how many there are. ``encode`` gives
        the ids of the pieces at some positions. Valid until the next call."""
        if len(self.keys) > REMEMBERED or self.used > 8 * REMEMBERED:
            self._clear()
        unique, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        known = self.keys[place] == unique if len(self.keys) else np.zeros(len(unique), bool)
        at, n = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        at[known], n[known] = self.at[place[known]], self.n[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            at[new], n[new] = self._append(encode(first[new]))
            keys = np.concatenate([self.keys, unique[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.at, self.n = np.concatenate([self.at, at[new]])[order], np.concatenate([self.n, n[new]])[order]
        return at[inverse], n[inverse]

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of the pieces, end to end."""
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        return self.ids[np.repeat((at - end + n).astype(np.int32), n) + np.arange(total, dtype=np.int32)]


class Encoder:
    """Looks pieces of UTF-8 text up, and encodes those that are new."""

    def __init__(self, path: str):
        self.table, self.encode = PieceTable(), piece_encoder(path)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def new(at: np.ndarray) -> list[list[int]]:
            raw = data.tobytes()
            return [self.encode(raw[a:b].decode()) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        return self.table.find(hashes(data, starts, ends), new)


def _before_punctuation(data: np.ndarray) -> np.ndarray:
    """Whether a byte is a stop or a comma after an ASCII letter: both vocabularies begin a pre-token there."""
    cut = _STOP[data]
    cut[1:] &= _ASCII_LETTER[data[:-1]]
    cut[:1] = False
    return cut


def dropped_space_pieces(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and at which piece each text begins, for a vocabulary that drops white space."""
    starts, ends, _ = spans(data, borders, _NOT_SPACE)
    cut = np.flatnonzero(_before_punctuation(data))
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, borders)


def byte_level_pieces(data: np.ndarray, borders: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and at which piece each text begins, for a byte-level vocabulary.

    Cuts before each space, around a line end between other ASCII text, and before punctuation. Where white space before a
    space may be joined with it, or the text spells a special token, which the library takes out first, the whole text is
    one piece.
    """
    cut = data == _SPACE
    spaces = np.flatnonzero(cut)
    begins = np.zeros(len(data) + 1, bool)
    begins[borders] = True
    before = data[np.maximum(spaces - 1, 0)]
    two = data[np.maximum(spaces - 2, 0)]
    joined = _ASCII_SPACE[before] | ((two == 0xC2) & ((before == 0x85) | (before == 0xA0)))
    three = data[np.maximum(spaces - 3, 0)]
    wide = np.flatnonzero((three >= 0xE1) & (three <= 0xE3))
    code = (three[wide].astype(np.int64) << 16) | (two[wide].astype(np.int64) << 8) | before[wide]
    joined[wide] |= np.isin(code, _WIDE_SPACE_BYTES)
    odd = spaces[joined & ~begins[spaces]].tolist()
    raw = data.tobytes()
    for special in special_strings(path):
        mark = special.encode()
        found = raw.find(mark)
        while found >= 0:
            odd.append(found)
            found = raw.find(mark, found + 1)
    cut |= _before_punctuation(data)
    lines = np.flatnonzero(data[1:-1] == 0x0A) + 1
    lines = lines[_ASCII_TEXT[data[lines - 1]] & _ASCII_TEXT[data[lines + 1]]]
    cut[lines] = cut[lines + 1] = True
    for text in set((np.searchsorted(borders, odd, "right") - 1).tolist()):
        cut[borders[text] : borders[text + 1]] = False
    starts = np.flatnonzero(cut | begins[:-1])
    return starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, borders)


def sums(n: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of n within each text."""
    total = np.concatenate([[0], np.cumsum(n)])
    return total[first[1:]] - total[first[:-1]]
