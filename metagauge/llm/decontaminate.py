"""Benchmark decontamination: a generalised suffix automaton of the items, through which the documents' words are streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metagauge.llm.tables import stored, whole_row
from metagauge.llm.words import FOLD, LETTERS_DIGITS, hashes, mix, spans, steps, text_bytes, with_texts, without

#: Bytes of item texts in one automaton; more items are searched for slice by slice, each slice in a pass of its own.
SLICE_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
Batches = Iterator[pa.RecordBatch]
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _STEP + words[1:])


class Automaton:
    """Suffix automaton of all items; its letters are word hashes.

    ``items`` gives an id and the word hashes of each. A window is ``window`` consecutive words of an item, or the whole of an
    item that has fewer. Every state knows the items whose windows end a match that stands in it.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words.tolist()) for name, words in items if len(words)]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.full: dict[int, set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.step[state][w]
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                if i + 1 >= window:
                    self.full.setdefault(state, set()).add(name)
            if len(words) < window:
                short.setdefault(state, {}).setdefault(len(words), set()).add(name)
        #: For each state: (length, items) of whole short items that end a match in it.
        self.short: list[list[tuple[int, set[str]]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + list(short.get(state, {}).items())
        self.least = min((min(window, len(words)) for _, words in items), default=0)
        seen = [np.array(words, np.uint64) for _, words in items]
        #: Matches of the least length consist of these words, or pairs of words.
        known = [x if self.least == 1 else _pairs(x) for x in seen]
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.known & np.uint64((1 << 20) - 1)] = True

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        """Adds a word to the item that ends in state ``last``; returns the state of the longer item."""
        there = self.step[last].get(w)
        if there is not None and self.length[there] == self.length[last] + 1:
            return there
        new = last if there is not None else self._state(self.length[last] + 1, {}, 0)
        at = last
        if there is None:
            while at >= 0 and w not in self.step[at]:
                self.step[at][w] = new
                at = self.link[at]
            if at < 0:
                return new
        target = self.step[at][w]
        if self.length[target] == self.length[at] + 1:
            self.link[new] = target
            return new
        copy = self._state(self.length[at] + 1, dict(self.step[target]), self.link[target])
        while at >= 0 and self.step[at].get(w) == target:
            self.step[at][w] = copy
            at = self.link[at]
        self.link[target] = copy
        if there is not None:
            return copy
        self.link[new] = copy
        return new

    def regions(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """Text, begin and end of the runs of words that can hold a window: elsewhere the automaton falls back to its start."""
        if not self.least or len(words) < self.least:
            return []
        single = self.least == 1
        key = words if single else _pairs(words)
        ok = self.sieve[key & np.uint64((1 << 20) - 1)]
        maybe = np.flatnonzero(ok)
        place = np.minimum(np.searchsorted(self.known, key[maybe]), len(self.known) - 1)
        ok[maybe] = self.known[place] == key[maybe]
        if not single:
            last = first[1:-1] - 1
            ok[last[(last >= 0) & (last < len(ok))]] = False
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + (not single)
        found = []
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            if e - b < self.least:
                continue
            text = int(np.searchsorted(first, b, "right")) - 1
            while b < e:  # a run of single words may go on into the next text
                end = min(e, int(first[text + 1]))
                if end > b:
                    found.append((text, b, end))
                b, text = max(b, end), text + 1
        return found

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words inside windows, merged, and the items of those windows."""
        state = matched = 0
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, w in enumerate(words):
            while state and w not in self.step[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.step[state].get(w, 0)
            matched = matched + 1 if state else 0
            longest = 0
            for length, names in self.short[state]:
                if length <= matched:
                    longest = max(longest, length)
                    items |= names
            if matched >= self.window:
                longest = self.window
                top = state
                while self.length[self.link[top]] >= self.window:
                    top = self.link[top]
                items |= self.full[top]
            if longest:
                begin = i + 1 - longest
                while hits and hits[-1][1] >= begin:
                    begin = min(begin, hits.pop()[0])
                hits.append((begin, i + 1))
        return hits, items


def _merged(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, borders = text_bytes(column)
    starts, ends, first = spans(data, borders, LETTERS_DIGITS)
    return hashes(FOLD[data], starts, ends), starts, ends, first


def _slices(items: DataFrame, slice_bytes: int) -> list[DataFrame]:
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // slice_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _searched(
    rows: DataFrame, items: DataFrame, window: int, slice_bytes: int, last: Callable[[Batches], Batches] | None = None
) -> DataFrame:
    """``row, n_words, hits, items``: one pass over the rows for each slice of the items; the last pass also does ``last``."""
    spark = rows.sparkSession
    found = rows.select(
        "row",
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)").alias("hits"),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    parts = _slices(items.select("item_id", "text"), slice_bytes)
    for i, part in enumerate(parts):
        given = part.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").collect()
        words, _, _, first = _word_hashes(pa.array([r.text for r in given], pa.string()))
        automaton = Automaton([(r.name, words[a:b]) for r, a, b in zip(given, first, first[1:], strict=False)], window)
        shared = spark.sparkContext.broadcast(automaton)
        if i:
            found = stored(found)
        end = last if last and i == len(parts) - 1 else iter
        found = found.mapInArrow(lambda batches, shared=shared, end=end: end(_pass(batches, shared.value)), found.schema)
    return found


def _pass(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, batch.column("row").field("text")):
            words, _, _, first = _word_hashes(part.column("row").field("text"))
            new: dict[int, tuple[list, set]] = {}
            for text, b, e in automaton.regions(words, first):
                hits, items = automaton.stream(words[b:e].tolist())
                if hits:
                    own = new.setdefault(text, ([], set()))
                    shift = b - int(first[text])
                    own[0].extend((x + shift, y + shift) for x, y in hits)
                    own[1].update(items)
            hits, items = part.column("hits"), part.column("items")
            if new:
                hits, items = hits.to_pylist(), items.to_pylist()
                for text, (more, names) in new.items():
                    before = [(h["first"], h["last"]) for h in hits[text]]
                    hits[text] = [{"first": a, "last": b} for a, b in _merged(before + more)]
                    items[text] = sorted(names.union(items[text]))
                hits, items = pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(np.diff(first)), hits, items], names=["row", "n_words", "hits", "items"]
            )


def find_items(docs: DataFrame, items: DataFrame, window: int = 10, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, n_words, hits, items`` of every document: spans of words inside any item's window, and those items.

    Words are runs of ASCII digits and letters, lower-cased, and of everything outside ASCII. A slice of the items holds about
    ``slice_bytes`` of text, so what is built on the driver and sent to the tasks is bounded however many items there are;
    with more than one slice the documents are stored between the passes.

    Null and empty texts have no words and no hits; an item without words matches nothing; an item with a null id is listed
    as an empty string; items repeated under one id count once; repeated documents are each answered; other columns are not
    read; without items nothing is hit.
    """
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("row"))
    found = _searched(rows, items, window, slice_bytes)
    return found.select("row.doc_id", "n_words", "hits", "items")


def hit_words(hits: str = "hits") -> Column:
    """How many words the spans hold."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"])


def remove_items(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The documents with all their columns, without the spans that stand in the items, and without the documents of whose
    words more than ``max_coverage`` do.

    What stands before and after a removed span keeps its own spelling. ``n_chars``, where there is one, follows the text. A
    document without hits is unchanged, and so is one with a null text; see :func:`find_items` for other cases.
    """
    rows = docs.select(whole_row(docs).alias("row"))
    clean = _searched(rows, items, window, slice_bytes, lambda batches: _without_hits(batches, max_coverage)).select("row.*")
    if "n_chars" in docs.columns:
        own = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(own))
    return clean


def _without_hits(batches: Batches, max_coverage: float) -> Batches:
    for batch in batches:
        row, hits, n_words = batch.column("row"), batch.column("hits"), batch.column("n_words").to_numpy()
        cut = np.flatnonzero(np.diff(hits.offsets.to_numpy())).tolist()
        if cut:
            texts, keep = row.field("text").to_pylist(), np.ones(len(row), bool)
            for i in cut:
                own = [(h["first"], h["last"]) for h in hits[i].as_py()]
                keep[i] = sum(b - a for a, b in own) <= max_coverage * n_words[i]
                _, starts, ends, _ = _word_hashes(pa.array([texts[i]], pa.string()))
                texts[i] = without(texts[i], [(starts[a], ends[b - 1]) for a, b in own])
            columns = [with_texts(row, texts), *batch.columns[1:]]
            batch = pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))
        yield batch
