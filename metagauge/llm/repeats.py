"""Suffix dedup by a sparse suffix array: passages that stand in several places, found from suffixes at minimisers.

A passage of ``min_words`` words or more that stands twice has the same minimisers in both places, so only the suffixes at
minimisers are retained. Those whose first ``key_words`` words stand nowhere else go. The others are sorted by their words
over ranges of about equal size, neighbours are compared, and what each shares with its neighbours gives the right side of
every match. A place with the same words on both sides as an earlier one of its text is a repeat whatever stands elsewhere; it is
settled where the text is read, and does not enter the sort.

Comparing neighbours once would lose passages: of three suffixes that begin alike, the first and the last may share what
precedes them, and the middle one not. So the suffixes of each run that shares some number of words, and no more, are sorted
once more by the words before them, from the nearest on, and compared with their new neighbours, which extends the matches to
the left. Words are compared as they are; a word of more than ``LONG_WORD`` bytes by 128 bits of its SHA-256.

Both sorts end with the place, so no run, however hot, has to fit one range. A run that goes on beyond the borders of a range
is settled by what the ranges say about their first and last rows, a row a range, which the driver puts in sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from metagauge.llm.tables import order_key, partitions, stored, text_digest, whole_row
from metagauge.llm.words import NOT_SPACE, hashes, runs, sequence_hashes, spans, steps, text_bytes, with_texts, without

#: Words of a suffix that its key covers.
KEY_WORDS = 16
#: Longer words are sorted by a digest.
LONG_WORD = 32
#: About how many suffixes one range of a sort holds.
RANGE_ROWS = 50_000
_DIGEST = 33
_END = 0x20
_NONE = (2**63 - 1, 2**31 - 1)
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS_SQL = "array<struct<first: bigint, last: bigint>>"


class _Windows:
    """Every window of some texts: its text, its first word, and the hash of the suffix it belongs to."""

    def __init__(self, column: pa.Array, min_words: int, key_words: int):
        data, borders = text_bytes(column)
        self.starts, self.ends, self.first = spans(data, borders, NOT_SPACE)
        self.words = hashes(data, self.starts, self.ends)
        self.min_words, self.key_words = min_words, key_words
        self.count = np.diff(self.first)
        n, width = len(self.words), min_words - key_words + 1
        windows = np.maximum(self.count - min_words + 1, 0)
        self.text = np.repeat(np.arange(len(self.count)), windows)
        self.at = self.first[self.text] + np.arange(len(self.text)) - (np.cumsum(windows) - windows)[self.text]
        self.suffix = self.chosen = np.zeros(0, np.uint64)
        if not len(self.at):
            return
        begin = np.arange(n - key_words + 1)
        self.key = runs(self.words, begin, begin + key_words)
        least, size = begin, 1
        while size < width:  # the leftmost least key of 1, 2, 4, ... places, then of all
            step = min(size, width - size)
            a, b = least[: len(least) - step], least[step:]
            least = np.where(self.key[a] <= self.key[b], a, b)
            size += step
        self.chosen = least[self.at]
        self.suffix = self.key[self.chosen]

    def ids(self) -> np.ndarray:
        """A number for each text's words in their order; 0 for a text without a window."""
        out = np.zeros(len(self.count), np.uint64)
        has = np.flatnonzero(self.count >= self.min_words)
        out[has] = sequence_hashes(self.words, self.first[has], self.first[has + 1])
        return out.view(np.int64)

    def retained(self) -> np.ndarray:
        """The first window of each retained suffix."""
        new = np.ones(len(self.text), bool)
        new[1:] = (self.text[1:] != self.text[:-1]) | (self.chosen[1:] != self.chosen[:-1])
        return np.flatnonzero(new)

    def sides(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From which word and up to which a window with the suffix at each place may reach."""
        begin = np.maximum(place - (self.min_words - self.key_words), self.first[text])
        return begin, np.minimum(place + self.min_words, self.first[text + 1])

    def alike(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places of a text, one after the other, that have the same words on both sides, by their hashes."""
        begin, end = self.sides(text, place)
        by = place, place - begin, end - place, runs(self.words, begin, end), text
        order = np.lexsort(by)
        same = np.ones(max(0, len(order) - 1), bool)
        for x in by[1:]:
            same &= x[order[1:]] == x[order[:-1]]
        return order[:-1][same], order[1:][same]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text and key of the retained suffixes, once for each text; the same of those with several places there; and by text
        how many of these places differ in the words on some side."""
        new = self.retained()
        text, key, place = self.text[new], self.suffix[new], self.chosen[new]
        order = np.lexsort((key, text))
        text, key, place = text[order], key[order], place[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
        begins = np.flatnonzero(first)
        size = np.diff(np.append(begins, len(text)))
        several, own = begins[size > 1], np.repeat(size > 1, size)
        differing = np.bincount(text[own], minlength=len(self.count))
        if own.any():
            differing -= np.bincount(text[own][self.alike(text[own], place[own])[1]], minlength=len(self.count))
        return text[first], key[first].view(np.int64), text[several], key[several].view(np.int64), differing


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _retained(rows: DataFrame, min_words: int, key_words: int) -> DataFrame:
    """``key, digest, id, n_words, suffixes, own, n_own`` of every row; ``own`` has the suffixes with several places in the text,
    ``n_own`` is how many of these places are to be sorted."""

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1_000_000):
                w = _Windows(part.column("text"), min_words, key_words)
                text, key, again, own, n_own = w.suffixes()
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("digest"),
                        pa.array(w.ids()),
                        pa.array(w.count),
                        _lists(text, key, n),
                        _lists(again, own, n),
                        pa.array(n_own),
                    ],
                    names=["key", "digest", "id", "n_words", "suffixes", "own", "n_own"],
                )

    schema = "key long, digest long, id long, n_words long, suffixes array<long>, own array<long>, n_own long"
    return rows.mapInArrow(retain, schema)


# --- suffixes as bytes ------------------------------------------------------------------------------------------------------


def _within(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words in the order given, each with an end mark, and the n + 1 borders between them."""
    size = ends - starts
    long = np.flatnonzero(size > LONG_WORD)
    taken = size.copy()
    taken[long] = _DIGEST
    borders = np.concatenate([[0], np.cumsum(taken + 1)])
    out = np.full(borders[-1], _END, np.uint8)
    taken[long] = 0
    out[_within(borders[:-1], taken)] = data[_within(starts, taken)]
    for i in long.tolist():  # no word has a tab
        digest = sha256(data[starts[i] : ends[i]].tobytes()).hexdigest()[: _DIGEST - 1]
        out[borders[i] : borders[i] + _DIGEST] = np.frombuffer(f"\t{digest}".encode(), np.uint8)
    return out, borders


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    flat = data[_within(starts, size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column end to end and the n + 1 borders."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, borders - borders[0]


def _common(column: pa.Array | pa.ChunkedArray, together: int = 2_000) -> np.ndarray:
    """How many words each value begins with that the one before begins with too; 0 for the first."""
    data, borders = _flat(column)
    size = np.diff(borders)
    out = np.zeros(len(size), np.int64)
    for a in range(0, len(size) - 1, together):
        b = min(a + together + 1, len(size))
        grid = np.zeros((b - a, max(1, size[a:b].max())), np.uint8)
        grid[np.repeat(np.arange(b - a), size[a:b]), _within(np.zeros(b - a, np.int64), size[a:b])] = data[borders[a] : borders[b]]
        other = grid[1:] != grid[:-1]
        differ = np.where(other.any(1), other.argmax(1), grid.shape[1])
        out[a + 1 : b] = ((grid[1:] == _END) & (np.arange(grid.shape[1]) < differ[:, None])).sum(1)
    return out


def _shared(a: bytes, b: bytes) -> int:
    return int(_common(pa.array([a, b], pa.binary()))[1])


def _again(w: _Windows, text: np.ndarray, place: np.ndarray, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Which places have the same words on both sides as an earlier one of their text; ``data`` are the words end to end."""
    begin, end = w.sides(text, place)
    out = np.zeros(len(place), bool)
    one, other = w.alike(text, place)
    for a in range(0, len(one), 5_000):
        x, y = one[a : a + 5_000], other[a : a + 5_000]
        size = borders[end[y]] - borders[begin[y]]
        fits = size == borders[end[x]] - borders[begin[x]]
        x, y, size = x[fits], y[fits], size[fits]
        if len(x):
            differ = data[_within(borders[begin[x]], size)] != data[_within(borders[begin[y]], size)]
            out[y] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return out


def _covered(text: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> pa.Array:
    """A list for each of ``n`` texts: the words that the spans cover, which are in order of their texts, borders and ends."""
    if not len(text):
        return pa.array([[]] * n, _SPANS)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (first[1:] > last[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(text)) - 1
    at = np.searchsorted(text[begin], np.arange(n + 1)).astype(np.int32)
    covered = pa.StructArray.from_arrays([pa.array(first[begin]), pa.array(last[end])], fields=list(_SPANS.value_type))
    return pa.ListArray.from_arrays(pa.array(at), covered).cast(_SPANS)


def _contexts(rows: DataFrame, min_words: int, key_words: int) -> DataFrame:
    """``right, left, n_left, id, at, again``: the suffixes at the wanted minimisers, as far as a window from there may reach.

    ``right`` holds the words from ``at`` on, ``left`` those before, the nearest first. Places that have the same words on both
    sides as an earlier one of the text have no row; their words, all of them repeats, are ``again`` of the text's first row.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0
        for batch in batches:
            for part in steps(batch, "text", 1_000_000):
                w = _Windows(part.column("text"), min_words, key_words)
                ids = part.column("id").to_numpy()
                new = ids != np.concatenate([[last], ids[:-1]])  # a row that is repeated comes again at once, if sorted
                last = ids[-1]
                right = new & (w.ids() == ids)
                suffixes = part.column("suffixes")
                at, wanted = suffixes.offsets.to_numpy(), suffixes.flatten().to_numpy().view(np.uint64)
                at = at - at[0]
                kept = w.retained()
                text, place, key = w.text[kept], w.chosen[kept], w.suffix[kept]
                edge = np.searchsorted(text, np.arange(part.num_rows + 1))
                picked = right[text]
                for i in range(part.num_rows):
                    own = slice(edge[i], edge[i + 1])
                    picked[own] &= np.isin(key[own], wanted[at[i] : at[i + 1]])
                text, place = text[picked], place[picked]
                if not len(text):
                    continue
                data, _ = text_bytes(part.column("text"))
                onward, onward_at = _spelled(data, w.starts, w.ends)
                twice = _again(w, text, place, onward, onward_at)
                begin, end = (x - w.first[text] for x in w.sides(text, place))
                whole = twice & (end - begin >= min_words)
                again = _covered(text[whole], begin[whole], end[whole], part.num_rows)
                text, place = text[~twice], place[~twice]
                opens = np.ones(len(text), bool)
                opens[1:] = text[1:] != text[:-1]
                again = pc.take(again, pa.array(text, mask=~opens))
                backward, backward_at = _spelled(data, w.starts[::-1], w.ends[::-1])
                n = len(w.starts)
                for a in range(0, len(text), 5_000):
                    t, p = text[a : a + 5_000], place[a : a + 5_000]
                    end = np.minimum(p + min_words, w.first[t + 1])
                    n_left = np.minimum(p - w.first[t], min_words - key_words)
                    yield pa.RecordBatch.from_arrays(
                        [
                            _slices(onward, onward_at[p], onward_at[end]),
                            _slices(backward, backward_at[n - p], backward_at[n - p + n_left]),
                            pa.array(n_left.astype(np.int32)),
                            pa.array(ids[t]),
                            pa.array((p - w.first[t]).astype(np.int32)),
                            again.slice(a, 5_000),
                        ],
                        names=["right", "left", "n_left", "id", "at", "again"],
                    )

    return rows.mapInArrow(spell, f"right binary, left binary, n_left int, id long, at int, again {_SPANS_SQL}")


# --- sorts ------------------------------------------------------------------------------------------------------------------


def _sorted(df: DataFrame, count: int, *by: str) -> DataFrame:
    few = min(partitions(df.sparkSession), -(-count // 1_000))
    return df.repartitionByRange(max(1, few, -(-count // RANGE_ROWS)), *by).sortWithinPartitions(*by)


def _to_borders(share: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """What each row shares with the first and with the last one; ``share`` is with the row before."""
    head = share.copy()
    head[0] = most
    np.minimum.accumulate(head, out=head)
    tail = np.append(share[1:], most)
    tail = np.minimum.accumulate(tail[::-1])[::-1]
    return head, tail


def _first_of(n: int, value: dict, kind: pa.DataType) -> pa.Array:
    return pa.array([value] + [None] * (n - 1), kind)


_RIGHT = pa.struct(
    [
        ("first", pa.binary()),
        ("last", pa.binary()),
        ("through", pa.int32()),
        ("onward", pa.list_(pa.int32())),
        ("backward", pa.list_(pa.int32())),
    ]
)
_RIGHT_SQL = "struct<first: binary, last: binary, through: int, onward: array<int>, backward: array<int>>"
_PLACE = pa.list_(pa.struct([("id", pa.int64()), ("at", pa.int32())]))
_LEFT = pa.struct(
    [
        ("first_run", pa.binary()),
        ("first", pa.binary()),
        ("last_run", pa.binary()),
        ("last", pa.binary()),
        ("through", pa.int32()),
        ("heads", _PLACE),
        ("tails", _PLACE),
    ]
)
_LEFT_SQL = (
    "struct<first_run: binary, first: binary, last_run: binary, last: binary, through: int, "
    "heads: array<struct<id: bigint, at: int>>, tails: array<struct<id: bigint, at: int>>>"
)


def _compared_right(suffixes: DataFrame, min_words: int, key_words: int) -> DataFrame:
    """The sorted suffixes with ``n_right``, ``copy``, ``part``, ``lengths``, ``head``, ``tail`` and ``border``.

    A suffix is a copy if the one before has the same words on both sides at another place: whatever it shares with others that
    one shares too, and all its words are a repeat. Copies keep neither words nor lengths.
    ``lengths`` are the numbers of words that the suffix shares with some other of its range, ``head`` and ``tail`` what it
    shares with the first and last one of the range; the first row has what the range says of itself.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        n = sum(b.num_rows for b in given)
        if not n:
            return
        rows = pa.Table.from_batches(given).combine_chunks().to_batches(max_chunksize=n)[0]
        share = _common(rows.column("right"))
        head, tail = _to_borders(share, min_words)
        data, borders = _flat(rows.column("right"))
        n_right = np.diff(np.searchsorted(np.flatnonzero(data == _END), borders))
        ids, at, n_left = (rows.column(c).to_numpy() for c in ("id", "at", "n_left"))
        copy = np.zeros(n, bool)
        copy[1:] = (ids[1:] != ids[:-1]) | (at[1:] != at[:-1])
        for alike, size in ((share, n_right), (_common(rows.column("left")), n_left)):
            copy[1:] &= (alike[1:] == size[1:]) & (size[1:] == size[:-1])
        share[0] = 0
        shared = np.zeros((n, min_words - key_words + 1), bool)
        for j, length in enumerate(range(key_words, min_words + 1)):
            begins = np.flatnonzero(share < length)
            least = np.minimum.reduceat(np.where(share < length, min_words + 1, share), begins)
            shared[:, j] = np.repeat(least == length, np.diff(np.append(begins, n)))
        shared[copy] = False
        offsets = np.concatenate([[0], np.cumsum(shared.sum(1))]).astype(np.int32)
        lengths = (np.nonzero(shared)[1] + key_words).astype(np.int32)
        border = {
            "first": rows.column("right")[0].as_py(),
            "last": rows.column("right")[n - 1].as_py(),
            "through": int(head[-1]),
            "onward": np.unique(head[1:]).tolist(),
            "backward": np.unique(tail[:-1]).tolist(),
        }
        part = TaskContext.get().partitionId()
        kept = pa.array(~copy)
        words = [pc.if_else(kept, rows.column(c), pa.scalar(None, pa.binary())) for c in ("right", "left")]
        more = [
            pa.array(n_right.astype(np.int32)),
            pa.array(copy),
            pa.array(np.full(n, part, np.int32)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(lengths)),
            pa.array(head.astype(np.int32)),
            pa.array(tail.astype(np.int32)),
            _first_of(n, border, _RIGHT),
        ]
        out = pa.RecordBatch.from_arrays(
            [*words, *[rows.column(c) for c in ("n_left", "id", "at", "again")], *more],
            names=["right", "left", "n_left", "id", "at", "again", "n_right", "copy", "part", "lengths", "head", "tail", "border"],
        )
        yield from (out.slice(a, 10_000) for a in range(0, n, 10_000))
        pa.default_memory_pool().release_unused()

    more = f"n_right int, copy boolean, part int, lengths array<int>, head int, tail int, border {_RIGHT_SQL}"
    return suffixes.mapInArrow(compare, f"right binary, left binary, n_left int, id long, at int, again {_SPANS_SQL}, {more}")


def _lengths_beyond(borders: list[Row], key_words: int) -> dict[int, tuple[list[int], list[int]]]:
    """By range: the numbers of words that its first row shares with rows before the range, and its last one with rows after."""

    def carried(ranges: list[tuple[int, dict, str, str, str]]) -> dict[int, list[int]]:
        out, seen, before = {}, set(), None
        for part, b, near, far, along in ranges:
            if before is not None:
                share = _shared(before[far], b[near])
                inner = set(before[along]) | {min(x, before["through"]) for x in seen}
                seen = {x for x in {share} | {min(x, share) for x in inner} if x >= key_words}
            out[part] = sorted(seen)
            before = b
        return out

    ranges = sorted((r.part, r.border) for r in borders)
    before = carried([(p, b, "first", "last", "backward") for p, b in ranges])
    after = carried([(p, b, "last", "first", "onward") for p, b in reversed(ranges)])
    return {p: (before[p], after[p]) for p in before}


def _runs(compared: DataFrame, beyond: dict[int, tuple[list[int], list[int]]], min_words: int, key_words: int) -> DataFrame:
    """``run, left, id, at, length``: each suffix once for each run it is in, the suffixes that share ``length`` words."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(key_words, min_words + 1)
        for rows in batches:
            if not rows.num_rows:
                continue
            lists = rows.column("lengths")
            member = np.zeros((rows.num_rows, len(every)), bool)
            member[np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy() - key_words] = True
            part = rows.column("part").to_numpy()
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                for side, lengths in zip(("head", "tail"), beyond[p], strict=True):
                    near = rows.column(side).to_numpy()[own][:, None]
                    if lengths:
                        member[own] |= (near >= every) & np.isin(every, lengths)
                        member[own] |= (near == every) & (lengths[-1] >= near)
            member &= rows.column("n_left").to_numpy()[:, None] >= min_words - every
            row, column = np.nonzero(member)
            length = every[column]
            data, borders = _flat(rows.column("right"))
            marks = np.flatnonzero(data == _END)
            end = marks[np.searchsorted(marks, borders[row]) + length - 1] + 1 if len(row) else row
            raw = data.tobytes()
            for a in range(0, len(row), 10_000):
                some = slice(a, a + 10_000)
                edges = zip(borders[row[some]].tolist(), end[some].tolist(), strict=True)
                names = [sha256(raw[x:y]).digest()[:16] for x, y in edges]
                taken = pa.array(row[some])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.binary()),
                        *[pc.take(rows.column(c), taken) for c in ("left", "id", "at")],
                        pa.array(length[some].astype(np.int32)),
                    ],
                    names=["run", "left", "id", "at", "length"],
                )

    needed = compared.filter("not copy").select("right", "left", "n_left", "id", "at", "part", "lengths", "head", "tail")
    return needed.mapInArrow(name, "run binary, left binary, id long, at int, length int")


def _compared_left(members: DataFrame, min_words: int, key_words: int) -> DataFrame:
    """``id, at, length, reach, head, tail, part, border`` of the sorted members of the runs.

    ``reach`` is how many words before it a member shares with an earlier place of its run and range, -1 for none earlier;
    ``head`` and ``tail`` what it shares with the first and last row of the range. Rows that can't be repeats are left out.
    """
    most = min_words - key_words

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = list(batches)
        n = sum(b.num_rows for b in given)
        if not n:
            return
        rows = pa.Table.from_batches(given).combine_chunks().to_batches(max_chunksize=n)[0]
        run = _flat(rows.column("run"))[0].reshape(n, 16)
        share = _common(rows.column("left"))
        share[1:][(run[1:] != run[:-1]).any(1)] = -1
        head, tail = _to_borders(share, most)
        share[0] = -1
        ids, at = rows.column("id").to_numpy(), rows.column("at").to_numpy()
        order = np.lexsort((at, ids))
        new = np.ones(n, bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(at[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        by_rank = order[new]
        reach = np.full(n, -1)
        for d in range(most + 1):
            begins = np.flatnonzero(share < d)
            least = np.minimum.reduceat(rank, begins)
            reach += rank > np.repeat(least, np.diff(np.append(begins, n)))

        def places(near: np.ndarray, ranks: np.ndarray) -> list[dict]:
            least = np.minimum.accumulate(ranks)
            where = by_rank[least[[int((near >= d).sum()) - 1 for d in range(most + 1)]]]
            return [{"id": i, "at": a} for i, a in zip(ids[where].tolist(), at[where].tolist(), strict=True)]

        left = rows.column("left")
        border = {
            "first_run": run[0].tobytes(),
            "first": left[0].as_py(),
            "last_run": run[-1].tobytes(),
            "last": left[n - 1].as_py(),
            "through": int(head[-1]),
            "heads": places(head, rank),
            "tails": places(tail, rank[::-1]),
        }
        need = min_words - rows.column("length").to_numpy()
        may = (reach >= need) | (head >= need) | (tail >= need)
        may[0] = True
        kept = np.flatnonzero(may)
        part = TaskContext.get().partitionId()
        out = pa.RecordBatch.from_arrays(
            [
                *[pc.take(rows.column(c), pa.array(kept)) for c in ("id", "at", "length")],
                *[pa.array(x[kept].astype(np.int32)) for x in (reach, head, tail)],
                pa.array(np.full(len(kept), part, np.int32)),
                _first_of(len(kept), border, _LEFT),
            ],
            names=["id", "at", "length", "reach", "head", "tail", "part", "border"],
        )
        yield from (out.slice(a, 10_000) for a in range(0, len(kept), 10_000))
        pa.default_memory_pool().release_unused()

    schema = f"id long, at int, length int, reach int, head int, tail int, part int, border {_LEFT_SQL}"
    return members.mapInArrow(compare, schema)


def _earliest_beyond(borders: list[Row], most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By range: the least place, before the range and after it, of those that share 0, 1, ... words with the row at the
    border."""

    def carried(ranges: list[tuple[int, dict, str, str, str]]) -> dict[int, list[tuple[int, int]]]:
        out, before = {}, None
        least = [_NONE] * (most + 1)
        for part, b, near, far, places in ranges:
            if before is not None:
                same = before[f"{far}_run"] == b[f"{near}_run"]
                share = _shared(before[far], b[near]) if same else -1
                least = [
                    min(tuple(before[places][d]), least[d] if before["through"] >= d else _NONE) if share >= d else _NONE
                    for d in range(most + 1)
                ]
            out[part] = least
            before = b
        return out

    ranges = sorted((r.part, r.border) for r in borders)
    before = carried([(p, b, "first", "last", "tails") for p, b in ranges])
    after = carried([(p, b, "last", "first", "heads") for p, b in reversed(ranges)])
    return {p: (np.array(before[p]), np.array(after[p])) for p in before}


def _matches(compared: DataFrame, beyond: dict[int, tuple[np.ndarray, np.ndarray]], min_words: int) -> DataFrame:
    """``id, first, last``: the words of each place that stand earlier as well."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, at, length, reach, part = (rows.column(c).to_numpy() for c in ("id", "at", "length", "reach", "part"))
            reach = reach.copy()
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                for side, least in zip(("head", "tail"), beyond[p], strict=True):
                    near = rows.column(side).to_numpy()[own]
                    for d, (i, a) in enumerate(least.tolist()):
                        earlier = (ids[own] > i) | ((ids[own] == i) & (at[own] > a))
                        reach[own[(near >= d) & earlier]] = np.maximum(reach[own[(near >= d) & earlier]], d)
            found = np.flatnonzero(reach >= min_words - length)
            first, last = at[found] - reach[found], at[found] + length[found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[found]), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))], names=["id", "first", "last"]
            )

    needed = compared.select("id", "at", "length", "reach", "head", "tail", "part")
    return needed.mapInArrow(extend, "id long, first long, last long")


def _spans(rows: DataFrame) -> DataFrame:
    """``id, spans`` from ``id, matches``: the words that the matches cover."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for matches in batch.column("matches"):
                first, last = (matches.values.field(c).to_numpy() for c in ("first", "last"))
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                gap = np.flatnonzero(first[1:] > last[:-1])
                begin, end = first[np.concatenate([[0], gap + 1])], last[np.concatenate([gap, [len(last) - 1]])]
                out.append([{"first": a, "last": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, _SPANS)], names=["id", "spans"])

    return rows.mapInArrow(cover, f"id long, spans {_SPANS_SQL}")


def _found(suffixes: DataFrame, count: int, min_words: int, key_words: int) -> DataFrame:
    """``id, first, last`` of all matches among about ``count`` suffixes."""
    right = stored(_compared_right(_sorted(suffixes, count, "right", "left", "id", "at"), min_words, key_words))
    beyond = _lengths_beyond(right.filter("border is not null").select("part", "border").collect(), key_words)
    count = right.agg(F.sum(F.size("lengths"))).first()[0] or 0
    members = _runs(right, beyond, min_words, key_words)
    left = stored(_compared_left(_sorted(members, count, "run", "left", "id", "at"), min_words, key_words))
    borders = left.filter("border is not null").select("part", "border").collect()
    copies = right.filter("copy").filter(F.col("n_left") + F.col("n_right") >= min_words)
    copies = copies.selectExpr("id", "cast(at - n_left as long) first", "cast(at + n_right as long) last")
    again = right.select("id", F.explode("again").alias("span")).select("id", "span.*")
    return _matches(left, _earliest_beyond(borders, min_words - key_words), min_words).unionByName(copies).unionByName(again)


def find_repeats(docs: DataFrame, min_words: int = 50, key_words: int = KEY_WORDS) -> DataFrame:
    """``key, digest, id, n_words, spans``: of every document the spans of words, counted from 0, that repeat an earlier passage.

    Words stand between ASCII white space and are compared as they are. A window of ``min_words`` words that stands in several
    places stays where it comes first, in the order of a hash of the texts and then of the places; elsewhere its words are
    in a span. Of documents with equal words the one with the least id stays, if they have ``min_words`` words; the others
    are one span as a whole.

    ``key`` is the id, the least number for null, ``digest`` the text's, and ``id`` a hash of the words, 0 for fewer than
    ``min_words``. Texts are found again by key and digest, so an id may have any share of the rows. Null, empty
    and short texts have no spans; rows equal in id and words are one document; other columns are not read; an empty table
    gives no rows.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(order_key().alias("key"), text_digest().alias("digest"), text)
    retained = stored(_retained(rows, min_words, key_words))
    long = retained.filter("id <> 0")
    least = F.min(F.struct("key", "digest", "own", "n_own")).alias("least")
    least = stored(long.groupBy("id").agg(least).select("id", "least.*"))

    suffixes = long.select(F.explode("suffixes").alias("suffix"), "id")
    shared = suffixes.groupBy("suffix").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x <> y").select("suffix")
    found = suffixes.join(shared, "suffix").groupBy("id").agg(F.collect_set("suffix").alias("found"), F.count("*").alias("n"))
    every = F.array_union("own", F.coalesce("found", F.expr("cast(array() as array<long>)")))
    count = F.col("n_own") + F.coalesce("n", F.lit(0))
    wanted = least.join(found, "id", "left").select("id", "key", "digest", every.alias("suffixes"), count.alias("n"))
    wanted = wanted.filter("size(suffixes) > 0")
    wanted = stored(wanted)
    count = wanted.agg(F.sum("n")).first()[0] or 0
    chosen = rows.join(wanted.drop("n"), ["key", "digest"]).select("id", "text", "suffixes")
    matches = _found(_contexts(chosen, min_words, key_words), count, min_words, key_words)
    found = _spans(matches.groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("matches")))

    every = retained.select("key", "digest", "id", "n_words").join(found, "id", "left")
    every = every.join(least.select("id", F.col("key").alias("kept")), "id", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("last")))
    none = F.expr(f"cast(array() as {_SPANS_SQL})")
    own_spans = F.when(F.col("kept") < F.col("key"), whole).otherwise(F.coalesce("spans", none))
    return every.select("key", "digest", "id", "n_words", own_spans.alias("spans"))


def words_in(spans: str = "spans"):
    """How many words the spans hold."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])


def cut_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``row, n_words, spans``: each document as a struct of all its columns, its text without the spans that
    :func:`find_repeats` finds, and what the text had.

    What stands before and after a span keeps its own spelling; a text that is a repeat as a whole becomes empty. Documents
    without spans are unchanged.
    """
    found = find_repeats(docs, min_words).dropDuplicates(["key", "digest"])
    rows = docs.select(order_key().alias("key"), text_digest().alias("digest"), whole_row(docs).alias("row"))
    rows = rows.join(found, ["key", "digest"]).select("row", "n_words", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column("row"), batch.column("row").field("text").to_pylist()
            for i, own in enumerate(batch.column("spans").to_pylist()):
                if own:
                    starts, ends, _ = spans(*text_bytes(pa.array([texts[i]], pa.string())), NOT_SPACE)
                    texts[i] = without(texts[i], [(starts[s["first"]], ends[s["last"] - 1]) for s in own])
            columns = [with_texts(row, texts), batch.column("n_words"), batch.column("spans")]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_words", "spans"])

    return rows.mapInArrow(cut, rows.schema)


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents with all their columns as :func:`cut_repeats` leaves them; ``n_chars``, where there is one, follows the
    text."""
    clean = cut_repeats(docs, min_words).select("row.*")
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))
    return clean
