"""Periodic runs of words in texts, from Lyndon arrays of both orders.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends keeping the period. Every run
of two periods or more holds, under the order of words or under the inverse one, Lyndon words of length q that are the longest
to start where they do. So the longest Lyndon word at each place is found under both orders by the first phase of Baier's
suffix sorter, which groups suffixes by just that word, and where two of equal length stand end to end, they are extended both
ways by the longest common extensions.

Only places that can belong to a run are sorted: within a run of ``min_exponent`` >= 3 periods and ``min_words`` >= 6 words all
stretches of five words stand elsewhere in the run too, so words outside all such repeated stretches are passed over. Their
hashes only choose what is sorted; runs themselves are found on exact word numbers.

Memory: a text is one unit, cut into pieces for reading only. It takes about six times its bytes (numbers of four bytes and
hashes of eight for each word), and where it repeats itself some 500 bytes for each word of the repeating stretch.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metagauge.llm.tables import whole_row
from metagauge.llm.words import mix, steps

#: Words of the stretches that must repeat; runs of at least six words and three periods have no other ones.
STRETCH = 5
#: Bytes of a long text that are split into words at once.
PIECE_BYTES = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = b" \t\n\x0b\x0c\r"

Run = tuple[int, int, int]
#: From an id and a number of words, which word stands at each place; None for the words as they are.
Reading = Callable[[int | None, int], np.ndarray | None]


def lyndon_array(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place.

    Suffixes begin in groups by their first word. Groups are taken from the highest down. Each suffix of the group taken hands
    the group's word to the nearest suffix before it that is in a lower group, which so moves to a new group right above its
    old one; the more words it was handed, the higher. What a group's suffixes have in common when it is taken is the word.
    """
    n = len(ranks)
    letters = sorted(set(ranks))
    of_letter = {letter: g for g, letter in enumerate(letters)}
    group = [of_letter[r] for r in ranks]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(letters)
    below = list(range(-1, len(letters) - 1))
    above = list(range(1, len(letters) + 1))
    above[-1:] = [-1]
    left = list(range(-1, n - 1))  # the nearest place before that may still be in a lower group
    taken = bytearray(n)
    out = [0] * n
    g = len(letters) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        length = size[g]
        for i in own:
            taken[i] = 1
            out[i] = length
        handed: dict[int, int] = {}
        for i in own:
            p = left[i]
            while p >= 0 and taken[p]:
                p = left[p]
            q = i
            while q > p and left[q] != p:
                left[q], q = p, left[q]
            if p >= 0:
                handed[p] = handed.get(p, 0) + 1
        moving: dict[tuple[int, int], list[int]] = {}
        for p, times in handed.items():
            moving.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moving, reverse=True):
            new = len(size)
            size.append(size[old] + times * length)
            members.append(moving[times, old])
            for p in members[new]:
                group[p] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = new
            if up >= 0:
                below[up] = new
        members[g] = own
        g = below[g]
    return out


def _common(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and from j on are equal, forward (1) or backward (-1)."""
    n, width, found = len(words), 8, 0
    while True:
        if step > 0:
            a, b = words[i + found : i + found + width], words[j + found : j + found + width]
            short = min(len(a), len(b))
            same = a[:short] == b[:short]
        else:
            a_end, b_end = i - found + 1, j - found + 1
            short = max(0, min(width, a_end, b_end))
            same = (words[a_end - short : a_end] == words[b_end - short : b_end])[::-1]
        if not same.all():
            return found + int(np.argmin(same))
        found += short
        if short < width:
            return found
        width = min(2 * width, n)


def runs_of(words: np.ndarray, min_words: int = 6, min_exponent: int = 4) -> list[Run]:
    """``(start, length, period)`` of all runs of a sequence of numbers that are so long, ordered."""
    found: set[Run] = set()
    for sign in (1, -1):
        lyndon = np.array(lyndon_array((words * sign).tolist()), dtype=np.int64)
        after = np.arange(len(words)) + lyndon
        inside = after < len(words)
        twice = np.flatnonzero(inside)[lyndon[inside] == lyndon[after[inside]]]
        last: dict[int, int] = {}
        for i in twice.tolist():
            q = int(lyndon[i])
            if i + q < last.get(q, 0):
                continue  # within the run of this period found before
            ahead = _common(words, i, i + q, 1)
            if ahead < q:
                continue
            start = i - _common(words, i - 1, i + q - 1, -1) if i else 0
            end = i + q + ahead
            last[q] = end
            if end - start >= max(min_words, min_exponent * q):
                found.add((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _numbers(data: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The number of each word; a long text is split piece by piece, between words."""
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE_BYTES
        while end < len(data) and data[end] not in _SPACE:
            end += 1
        found = (data if not at and end >= len(data) else data[at:end]).split()
        parts.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _stretches(numbers: list[np.ndarray]) -> dict[int, list[tuple[int, int]]]:
    """By text, the spans of words that stretches which repeat within the text cover together."""
    sizes = np.array([len(x) for x in numbers])
    first = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate(numbers).astype(np.uint64) if len(numbers) > 1 else numbers[0].astype(np.uint64)
    n = len(words) - STRETCH + 1
    if n < 2:
        return {}
    text = np.repeat(np.arange(len(numbers), dtype=np.int32), sizes)
    key = text[:n].astype(np.uint64)
    for j in range(STRETCH):
        key = key * _ODD + words[j : j + n] + np.uint64(1)
    key = mix(key)
    within = text[:n] == text[STRETCH - 1 :]
    key = key[within]
    place = np.flatnonzero(within).astype(np.int32 if len(words) < 2**31 else np.int64)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.sort(place[order[twice]])
    if not len(repeated):
        return {}
    cut = np.flatnonzero((np.diff(repeated) > STRETCH) | (np.diff(text[repeated]) > 0))
    starts = repeated[np.concatenate([[0], cut + 1])]
    ends = repeated[np.concatenate([cut, [len(repeated) - 1]])] + STRETCH
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        t = int(text[a])
        out[t].append((a - int(first[t]), b - int(first[t])))
    return out


def _texts_runs(texts: list[bytes], ids: list[int | None], reading: Reading | None, min_words: int, min_exponent: int):
    """For each text its number of words, its runs and the text of one period of each."""
    known: dict[bytes, int] = defaultdict(count().__next__)
    numbers, changed = [], []
    for data, own in zip(texts, ids, strict=True):
        n = _numbers(data, known)
        places = reading(own, len(n)) if reading and len(n) else None
        changed.append(places is not None)
        numbers.append(n if places is None else n[places])
    spelled = list(known)
    likely = _stretches(numbers)
    for t, (data, n) in enumerate(zip(texts, numbers, strict=True)):
        found: list[Run] = []
        for a, b in likely.get(t, []):
            if b - a >= min_words:
                found += [(a + s, length, q) for s, length, q in runs_of(n[a:b].astype(np.int64), min_words, min_exponent)]
        if not found and not changed[t] and len(data) <= PIECE_BYTES:
            yield len(n), found, hashlib.sha256(b" ".join(data.split()))
            continue
        keep = np.ones(len(n), dtype=bool)
        for start, length, q in found:
            keep[start + q : start + length] = False
        digest, kept = hashlib.sha256(), n[keep]
        for at in range(0, len(kept), 100_000):
            digest.update(b" " * (at > 0) + b" ".join(map(spelled.__getitem__, kept[at : at + 100_000].tolist())))
        yield len(n), found, digest


def _highest(found: list[Run]) -> Run | None:
    """The run with the greatest exact ratio of length to period; ties go to the smallest start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_COLUMNS = {name: pa.int64() for name in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")}
_COLUMNS |= {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(_RUN)}
_SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,"
    " collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
)


def find_runs(
    docs: DataFrame, key: str = "doc_id", min_words: int = 6, min_exponent: int = 4, reading: Reading | None = None
) -> DataFrame:
    """One row for each of ``docs``: its columns as the struct ``row``, its number of words (runs of anything but ASCII white
    space), all its ``runs`` of at least ``min_words`` words (six or more) and ``min_exponent`` periods (three or more), the one
    with most periods, and digests of the runs and of the text that keeps one period of each. ``reading`` gives, from a row's id
    and its number of words, which word is to be read at each place.

    A null text has no words. A text without runs has nulls for the highest run, an empty list, and the digest of no runs; rows
    that are repeated, or whose id is null, are each answered alone. Nothing is shuffled.
    """
    if min_words <= STRETCH or min_exponent < 3:
        raise ValueError("runs of at least six words and three periods are found")
    given = docs.select(
        F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"), whole_row(docs).alias("row")
    )

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "text"):
                texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
                answers = []
                ids = batch.column("id").to_pylist()
                for n, runs, collapsed in _texts_runs(texts, ids, reading, min_words, min_exponent):
                    start, length, period = _highest(runs) or (None, None, None)
                    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
                    answers.append(
                        {
                            "n_words": n,
                            "n_runs": len(runs),
                            "start": start,
                            "length": length,
                            "period": period,
                            "exponent_milli": 1000 * length // period if runs else None,
                            "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(),
                            "collapsed_sha256": collapsed.hexdigest(),
                            "runs": [{"start": s, "length": m, "period": q} for s, m, q in runs],
                        }
                    )
                arrays = [pa.array([a[name] for a in answers], kind) for name, kind in _COLUMNS.items()]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], ["row", *_COLUMNS])

    return given.mapInArrow(found, f"row {given.schema['row'].dataType.simpleString()}, {_SCHEMA}")
