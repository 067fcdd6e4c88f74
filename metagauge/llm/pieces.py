"""SentencePiece encoding and decoding by a Viterbi search in numpy, over all words of one length at once.

Texts are cut where two characters never stand together inside a piece. What lies between two cuts is a word; distinct words
of equal length advance together through their positions. Hashes of the substrings that end at a position probe the sorted
hashes of the pieces, and the best way to reach the position is kept with a pointer back.

For a unigram model the best way has the largest sum of scores. A byte-pair model merges pairs by rank instead, and its result
is the one path on which no two neighbouring pieces would have been merged otherwise; there a step is allowed only if its piece
and the piece before are such neighbours, and the search finds that path.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from metagauge.llm.encoding import PieceTable, sums
from metagauge.llm.tables import whole_row
from metagauge.llm.words import mix, powers, runs, sequence_hashes, steps, with_texts

SPACE = "▁"
#: Words of one length that advance together.
TOGETHER = 20_000
_SIEVE = 1 << 22
_UNIGRAM = 1
#: A worker remembers about as many pairs of neighbouring pieces as this many bits count.
_PAIR_BITS = 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _values(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _sieve_at(points: np.ndarray) -> np.ndarray:
    return ((points[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + points[1:]) * np.uint64(0x85EBCA6B)) % np.uint64(_SIEVE)


class Model:
    """A model's pieces, ready to be probed."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(processor.serialized_model_proto())
        if spec.normalizer_spec.name not in ("", "identity") or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are")
        self.unigram = spec.trainer_spec.model_type == _UNIGRAM
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        self.size = processor.get_piece_size()
        self.unknown = processor.unk_id()
        names = [processor.id_to_piece(i) for i in range(self.size)]
        is_byte = [processor.is_byte(i) for i in range(self.size)]
        plain = [
            i
            for i in range(self.size)
            if not (is_byte[i] or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))
        ]
        self.score = np.array([processor.get_score(i) for i in range(self.size)] + [0.0])
        self.score[-1] = min(self.score[plain], default=0.0) - 10
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(self.size) if is_byte[i]}
        self.names = names
        self.id_of = {names[i]: i for i in plain}
        self.longest = max((len(names[i]) for i in plain), default=1)

        points = _points("".join(names[i] for i in plain))
        length = np.array([len(names[i]) for i in plain], np.int64)
        ends = np.cumsum(length)
        keys = runs(_values(points), ends - length, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.int64)[order]
        inner = np.ones(max(0, len(points) - 1), bool)
        inner[ends[:-1] - 1] = False
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[_sieve_at(points)[inner]] = True

        text = [b"" if processor.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(self.size)]
        for value, i in self.byte_ids.items():
            text[i] = bytes([value])
        text[self.unknown] = " ⁇ ".encode()
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_n = np.array([len(t) for t in text], np.int64)
        self.text_at = np.cumsum(self.text_n) - self.text_n
        if not self.unigram:
            self._ranks()

    # --- byte-pair models -------------------------------------------------------------------------------------------

    def _merged(self, word: str) -> list[tuple[int, float, tuple | None]]:
        """The symbols that a word's characters merge to: (id, score of its merge, the two it was merged from)."""
        parts = [(self.id_of.get(c, -1), np.inf, None, c) for c in word]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
                found = self.id_of.get(a[3] + b[3])
                if found is not None and self.score[found] > best:
                    best, at = self.score[found], i
            if at < 0:
                break
            a, b = parts[at], parts[at + 1]
            parts[at : at + 2] = [(self.id_of[a[3] + b[3]], best, (a[0], b[0]), a[3] + b[3])]
        return [p[:3] for p in parts]

    def _ranks(self) -> None:
        """Which pieces merging reaches, from which two, and the sorted table of all pairs that merge."""
        n = self.size + 1
        left, right = np.full(n, -1), np.full(n, -1)
        self.born, self.reached = np.full(n, np.inf), np.zeros(n, bool)
        pairs: dict[int, int] = {}
        for name, i in self.id_of.items():
            for cut in range(1, len(name)):
                a, b = self.id_of.get(name[:cut]), self.id_of.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
            found = self._merged(name)
            if len(found) == 1:
                self.reached[i] = True
                _, self.born[i], parts = found[0]
                if parts:
                    left[i], right[i] = parts
        self.reached[-1] = True
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        self.last_parts, self.first_parts = self._edge(right), self._edge(left)
        #: Pieces in which some merge comes before one that it needs: the lifetimes of :meth:`_apart` don't hold for them.
        self.odd = np.zeros(n, bool)
        for i in sorted(self.id_of.values(), key=lambda i: len(self.names[i])):
            if self.reached[i] and left[i] >= 0:
                a, b = left[i], right[i]
                self.odd[i] = self.odd[a] or self.odd[b] or min(self.born[a], self.born[b]) <= self.born[i]
        self.known_pairs, self.known_fits = np.full(1 << _PAIR_BITS, -1), np.zeros(1 << _PAIR_BITS, bool)

    @staticmethod
    def _edge(inner: np.ndarray) -> list[np.ndarray]:
        """The symbols at one edge of a piece: itself, the part at that edge, that part's part, ..., -1 beyond."""
        chain = [np.arange(len(inner))]
        while (following := np.where(chain[-1] >= 0, inner[chain[-1]], -1)).max() >= 0:
            chain.append(following)
        return chain

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and then b stay as they are, merging what they spell.

        Each symbol at a's right edge lives from its own merge until it is merged on, and so does each at b's left edge. The
        two pieces stay apart unless a pair of these that are there at one time has a merge that comes before both are merged
        on; of equal merges the leftmost is first.
        """
        n = self.size + 1
        fits = np.ones(len(a), bool)
        gone_x = np.full(len(a), -np.inf)
        for xs in self.last_parts:
            x = xs[a]
            gone_y = np.full(len(a), -np.inf)
            for ys in self.first_parts:
                y = ys[b]
                there = np.flatnonzero((x >= 0) & (y >= 0))
                if not len(there):
                    break
                key = x[there] * n + y[there]
                place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[place] == key
                at = there[hit]
                merge = self.score[self.pair_ids[place[hit]]]
                together = (self.born[x[at]] >= gone_y[at]) & (self.born[y[at]] > gone_x[at])
                fits[at[together & (merge > gone_x[at]) & (merge >= gone_y[at])]] = False
                gone_y = np.where(y >= 0, self.born[y], gone_y)
            gone_x = np.where(x >= 0, self.born[x], gone_x)
        for i in np.flatnonzero(self.odd[a] | self.odd[b]).tolist():
            found = self._merged(self.names[a[i]] + self.names[b[i]])
            fits[i] = [p for p, *_ in found] == [a[i], b[i]]
        return fits

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_apart`, remembered in a table of fixed size where a pair's hash says."""
        key = a * (self.size + 1) + b
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _PAIR_BITS)
        out = self.known_fits[place]
        new = np.flatnonzero(self.known_pairs[place] != key)
        if len(new):
            out[new] = self._apart(a[new], b[new])
            self.known_pairs[place[new]], self.known_fits[place[new]] = key[new], out[new]
        return out

    # --- search -------------------------------------------------------------------------------------------------------

    def viterbi(self, words: np.ndarray) -> list[list[int]]:
        """The pieces of some words of one length, a row of code points each."""
        n, length = words.shape
        power, inverse = powers(length + 1)
        running = np.zeros((length + 1, n), np.uint64)
        np.cumsum(_values(words.T) * power[:length, None], axis=0, out=running[1:])
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        piece = np.full((length + 1, n), self.size)
        back = np.zeros((length + 1, n), np.int64)
        for e in range(1, length + 1):
            for size in range(1, min(e, self.longest) + 1):
                s = e - size
                key = mix((running[e] - running[s]) * inverse[s] + np.uint64(size))
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = np.where(self.keys[place] == key, self.ids[place], self.size)
                may = (found < self.size) | (size == 1)
                if not self.unigram:
                    may &= self.reached[found]
                at = np.flatnonzero(may & (best[s] > -np.inf))
                if not self.unigram and s and len(at):
                    known = (found[at] < self.size) & (piece[s][at] < self.size)
                    inner = at[known]
                    at = np.concatenate([at[~known], inner[self.fits(piece[s][inner], found[inner])]])
                value = best[s][at] + self.score[found[at]]
                better = value > best[e][at]
                at, value = at[better], value[better]
                best[e][at], piece[e][at], back[e][at] = value, found[at], s
        out: list[list[int]] = [[] for _ in range(n)]
        at = np.full(n, length)
        rows = np.arange(n)
        while len(rows):
            for r, p, s in zip(rows.tolist(), piece[at[rows], rows].tolist(), back[at[rows], rows].tolist(), strict=True):
                out[r].append(p if p < self.size else ~int(words[r, s]))
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        return [self._spelled(x[::-1]) for x in out]

    def _spelled(self, pieces: list[int]) -> list[int]:
        """Characters without a piece, marked by their complement, become their bytes, or the unknown piece."""
        if all(p >= 0 for p in pieces):
            return pieces
        out = []
        for p in pieces:
            if p >= 0:
                out.append(p)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in chr(~p).encode())
            else:
                out.append(self.unknown)
        return out

    # --- whole texts --------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str], table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin."""
        spelled = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        borders = np.concatenate([[0], np.cumsum([len(t) for t in spelled])])
        points = _points("".join(spelled))
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = ~self.sieve[_sieve_at(points)] if len(points) > 1 else cut[1:-1]
        cut[borders] = True
        edges = np.flatnonzero(cut)
        starts, ends = (edges[:-1], edges[1:]) if len(points) else (edges[:0], edges[:0])

        def new(at: np.ndarray) -> list[list[int]]:
            begin, size = starts[at], (ends - starts)[at]
            out: list[list[int]] = [[] for _ in range(len(at))]
            order = np.argsort(size, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
                for some in np.array_split(same, -(-len(same) // TOGETHER)):
                    words = points[begin[some][:, None] + np.arange(size[some[0]])]
                    for i, ids in zip(some.tolist(), self.viterbi(words), strict=True):
                        out[i] = ids
            return out

        at, n = table.find(sequence_hashes(_values(points), starts, ends), new)
        per_text = sums(n, np.searchsorted(starts, borders))
        return table.gather(at, n), np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The texts that ids spell; the space set before a text is taken off, and bytes that are no UTF-8 are replaced."""
        n = self.text_n[ids]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        data = self.text[np.repeat(self.text_at[ids] - end + n, n) + np.arange(total)].tobytes()
        at = np.concatenate([[0], end])[first].tolist()
        texts = [data[a:b].decode(errors="replace") for a, b in zip(at, at[1:], strict=False)]
        return [t[1:] if self.prefix and t[:1] == " " else t for t in texts]


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Model, PieceTable]:
    return Model(path), PieceTable()


def encode(docs: DataFrame, model: str, name: str = "piece_ids") -> DataFrame:
    """The documents with all their columns and ``name``, the ids of their whole texts.

    Null and empty texts have no ids. A column of that name is replaced. Characters without a piece are spelled in bytes.
    """
    rows = docs.select(whole_row(docs, name).alias("row"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = _loaded(model)
        for batch in batches:
            for part in steps(batch, batch.column("row").field("text"), 1_000_000):
                texts = [t or "" for t in part.column("row").field("text").to_pylist()]
                ids, first = pieces.encode(texts, table)
                found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("row"), found], names=["row", name])

    schema = StructType([*rows.schema, StructField(name, ArrayType(IntegerType()))])
    return rows.mapInArrow(encoded, schema).select("row.*", name)


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """The rows with ``name``, the texts that their ids spell; no ids, or null, spell an empty text."""
    rows = encoded.select(whole_row(encoded, name).alias("row"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _ = _loaded(model)
        for batch in batches:
            found = batch.column("row").field(ids)
            first = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())])
            texts = pieces.decode(found.flatten().to_numpy(), first)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", name])

    schema = StructType([*rows.schema, StructField(name, StringType())])
    return rows.mapInArrow(decoded, schema).select("row.*", name)


def encode_and_decode(docs: DataFrame, model: str, name: str = "piece_ids") -> DataFrame:
    """:func:`encode`, with the texts that the ids spell in place of the texts, null texts empty, in one pass."""
    rows = docs.select(whole_row(docs, name).alias("row"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = _loaded(model)
        for batch in batches:
            for part in steps(batch, batch.column("row").field("text")):
                row = part.column("row")
                ids, first = pieces.encode([t or "" for t in row.field("text").to_pylist()], table)
                found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([with_texts(row, pieces.decode(ids, first)), found], names=["row", name])

    schema = StructType([*rows.schema, StructField(name, ArrayType(IntegerType()))])
    return rows.mapInArrow(both, schema).select("row.*", name)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, decoded_sha256, same``: every whole text encoded, and decoded again from its ids.

    The crc is that of the ids as little-endian unsigned 32-bit integers. ``same`` tells whether the decoded text is the text;
    only the sign that stands for a space (U+2581) comes back as a space. Null texts are empty; null ids and repeated rows are
    rows like others; other columns are not read; an empty table gives no rows.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = _loaded(model)
        for batch in batches:
            for part in steps(batch, "text", 1_000_000):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, first = pieces.encode(texts, table)
                back = pieces.decode(ids, first)
                raw, at = ids.astype("<u4").tobytes(), (4 * first).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first)),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()),
                        pa.array([sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([a == b for a, b in zip(back, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "same"],
                )

    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(checked, schema)
