"""Words and their hashes over whole Arrow batches of text, in numpy.

Texts lie end to end as UTF-8 bytes. A word is a run of word bytes; every byte from 0x80 on is one, so no character is cut.
Equal words have equal hashes wherever they stand. A word's hash adds up a random number for each of its bytes at its place in
the word, from running sums. Substrings that overlap have no place of their own and get a polynomial modulo 2**64 instead, for
which long texts exist that collide whatever the base; it is for spans of a few values only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that one step of the numpy work takes; a longer text is a step of its own.
STEP_BYTES = 1_000_000

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_ALL = np.arange(256)
#: Everything but ASCII white space.
NOT_SPACE = ~np.isin(_ALL, [0x20, *range(0x09, 0x0E)])
#: Digits, lower-case letters and everything outside ASCII; upper case is folded before.
LETTERS_DIGITS = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
LETTERS_DIGITS |= (_ALL >= 65) & (_ALL <= 90)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _INVERSE = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _POWER, _INVERSE
    if len(_POWER) < n:
        _POWER, _INVERSE = _powers(_BASE, n + n // 4), _powers(pow(_BASE, -1, 1 << 64), n + n // 4)
    return _POWER, _INVERSE


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the n + 1 borders between them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, borders - borders[0]


def steps(batch: pa.RecordBatch, column: str | pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    _, borders = text_bytes(batch.column(column) if isinstance(column, str) else column)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(borders, borders[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # workers live on between stages


def spans(data: np.ndarray, borders: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and at which word each text begins (n + 1 numbers)."""
    inside = is_word[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cut = borders[:-1][borders[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = borders[1:][borders[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, borders)


_PLACES = 64
_PLACED = mix(mix(np.arange(_PLACES, dtype=np.uint64) * _STEP)[:, None] + _VALUE).reshape(-1)


def _places(n: int, starts: np.ndarray) -> np.ndarray:
    """How far each value is from the start of its span; spans ascend and don't overlap."""
    origin = np.zeros(n, dtype=np.int64)
    own = starts[starts < n]
    origin[own] = own
    return np.arange(n) - np.maximum.accumulate(origin)


def _added(placed: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    running = np.zeros(len(placed) + 1, dtype=np.uint64)
    np.cumsum(placed, out=running[1:])
    return mix(running[ends] - running[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans ascend and don't overlap."""
    place = _places(len(data), starts)
    placed = _PLACED[((place & (_PLACES - 1)) << 8) + data]
    late = np.flatnonzero(place >= _PLACES)
    if len(late):
        placed[late] = mix(placed[late] + (place[late] >> 6).astype(np.uint64) * _STEP)
    return _added(placed, starts, ends)


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the numbers of each span; spans ascend and don't overlap."""
    place = _places(len(values), starts).astype(np.uint64)
    return _added(mix(values + place * _STEP), starts, ends)


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, of some hundred bytes at most; spans may overlap."""
    return runs(_VALUE[data], starts, ends)


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the values of each span, of some hundred values at most; spans may overlap."""
    power, inverse = powers(len(values) + 1)
    running = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=running[1:])
    return mix((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within each text, and at which each text begins; a text of fewer words, but not none, has
    one of all its words."""
    count = np.diff(first)
    total = len(words)
    many = np.zeros(max(0, total - n + 1), dtype=np.uint64)
    for j in range(n):
        many = many * _STEP + words[j : j + len(many)]
    short = (count > 0) & (count < n)
    lengths = np.where(count >= n, count - n + 1, short)
    out_first = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(out_first[-1], dtype=np.uint64)
    if total:
        text = np.repeat(np.arange(len(count)), lengths)
        within = np.arange(len(out)) - out_first[text]
        full = ~short[text]
        out[full] = mix(many[first[text[full]] + within[full]])
        for i in np.flatnonzero(short):
            value = 0
            for w in words[first[i] : first[i + 1]].tolist():
                value = (value * int(_STEP) + w) & MASK
            out[out_first[i]] = mix(np.array([value ^ int(count[i])], dtype=np.uint64))[0]
    return out, out_first


def with_texts(row: pa.StructArray, texts: list[str | None]) -> pa.StructArray:
    """Rows with other texts."""
    at = row.type.get_field_index("text")
    fields = [row.field(j) for j in range(row.type.num_fields)]
    fields[at] = pa.array(texts, row.type.field(at).type)
    return pa.StructArray.from_arrays(fields, fields=list(row.type))


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text without these spans of its UTF-8 bytes, which ascend and don't overlap; white space at the ends goes too."""
    data, at, kept = text.encode(), 0, []
    for a, b in cuts:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]).decode().strip()
