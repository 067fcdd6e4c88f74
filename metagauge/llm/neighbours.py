"""Nearest neighbours by inner product, through multi-index hashing of learned binary codes.

Vectors get one more entry, so that all are equally long and the order of inner products is that of angles. A rotation of their
principal directions is learned (iterative quantisation) so that signs lose little; 64 signs are a code. Codes are cut into bytes
and each byte is an index of its own: of codes within r bits of the query's, one byte differs in no more than r / 8 bits, so all
of them are found by probing each index with the bytes that near. What was found is compared as a whole code, and those within r
are ranked by their inner products in double precision.

The rotation and r are learned from a sample of about ``SAMPLE_ROWS`` vectors, or ``SAMPLE_BYTES`` of them, those with the
least hashes (all, if there are no more): r is the least radius that holds ``RECALL`` of the true neighbours of sampled vectors among the sample. Neighbours
in the whole table are at least as near. Every vector is in the index, and a query that finds fewer neighbours than it should
goes through all codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metagauge.llm.tables import stored
from metagauge.llm.vectors import finite, matrix, widest

BITS = 64
BYTES = BITS // 8
#: The size of the sample that the codes are learned from, and how many of it are taken as queries.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 16_384, 16_000_000, 512
RECALL = 0.97
#: Vectors of a part of the index, and of a block of queries that meets it.
PART, BLOCK = 8192, 4096
_ROUNDS = 30
_NULL_ID = 2**63 - 1

_NEAR = [np.array([v for v in range(256) if v.bit_count() <= d], dtype=np.uint8) for d in range(9)]


@dataclass(frozen=True)
class Codes:
    """How a vector becomes a code: its length in the measure, the middle of the sample and the rotated directions."""

    longest: float
    middle: np.ndarray
    directions: np.ndarray
    radius: int = BITS

    def _bits(self, unit: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (np.column_stack([unit, last]) - self.middle) @ self.directions >= 0

    def of_vectors(self, v: np.ndarray) -> np.ndarray:
        unit = v / self.longest
        return packed(self._bits(unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        unit = v / lengths(v)[:, None]
        return packed(self._bits(unit, np.zeros(len(v))))


def lengths(v: np.ndarray) -> np.ndarray:
    """Of the rows; scaled, so that squares neither overflow nor vanish."""
    most = np.abs(v).max(axis=1, initial=0.0)
    scale = np.where(most > 0, most, 1.0)
    return scale * np.sqrt(((v / scale[:, None]) ** 2).sum(axis=1))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of signs as 64-bit codes; fewer signs leave zeros."""
    full = np.zeros((len(bits), BITS), dtype=bool)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.uint64).reshape(-1)


def learn(sample: np.ndarray, longest: float, k: int) -> Codes:
    """Codes for vectors like these: a rotation that brings signs near to values, and the radius."""
    unit = sample / longest
    whole = np.column_stack([unit, np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))])
    middle = whole.mean(axis=0)
    _, vectors = np.linalg.eigh((whole - middle).T @ (whole - middle))
    principal = vectors[:, ::-1][:, :BITS]
    values = (whole - middle) @ principal
    bits = values.shape[1]
    rotation, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))
    for _ in range(_ROUNDS):
        u, _, vt = np.linalg.svd(np.where(values @ rotation >= 0, 1.0, -1.0).T @ values)
        rotation = (u @ vt).T
    codes = Codes(longest, middle, principal @ rotation)

    asked = min(SAMPLE_QUERIES, len(sample))
    scores = sample[:asked] @ sample.T
    scores[np.arange(asked), np.arange(asked)] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return codes
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    apart = np.bitwise_count(codes.of_queries(sample[:asked])[:, None] ^ codes.of_vectors(sample)[nearest])
    radius = int(np.quantile(apart, RECALL, method="higher"))
    return Codes(longest, middle, codes.directions, radius)


class Part:
    """A part of the index: codes in eight orders, one by each byte, with the place where each byte's codes begin."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        each = codes.view(np.uint8).reshape(-1, BYTES)
        self.orders, self.firsts = [], []
        for b in range(BYTES):
            order = np.argsort(each[:, b], kind="stable")
            self.orders.append(order)
            self.firsts.append(np.searchsorted(each[order, b], np.arange(257)))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """All places whose codes differ from this one in at most so many bits."""
        if radius >= BITS:
            return np.arange(len(self.codes))
        found = np.zeros(len(self.codes), dtype=bool)
        base, more = divmod(radius, BYTES)
        for b, byte in enumerate(np.array([code]).view(np.uint8)):
            bits = base if b <= more else base - 1
            if bits < 0:
                continue
            probes = byte ^ _NEAR[min(bits, 8)]
            starts, ends = self.firsts[b][probes], self.firsts[b][probes.astype(np.int64) + 1]
            sizes = ends - starts
            shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            found[self.orders[b][np.arange(len(shift)) + shift]] = True
        places = np.flatnonzero(found)
        return places[np.bitwise_count(self.codes[places] ^ code) <= radius]


_HIT = "query long, score double, vec_id long, own boolean"


def _best(query: np.ndarray, places: np.ndarray, vectors: np.ndarray, owners: tuple, own: np.ndarray | None, k: int):
    """The k best rows among the vectors at these places, with their scores summed in one fixed order."""
    first, ids, missing = owners
    scores = vectors[places] @ query
    if len(places) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        slack = 1e-9 * (1 + float(np.abs(scores).max()))
        places = places[scores >= least - slack]
    scores = (vectors[places] * query).sum(axis=1)
    sizes = first[places + 1] - first[places]
    row = np.repeat(np.arange(len(places)), sizes)
    at = np.arange(len(row)) - np.concatenate([[0], np.cumsum(sizes)[:-1]])[row] + first[places][row]
    order = np.lexsort((ids[at], missing[at], -scores[row]))[:k]
    same = np.zeros(len(places), dtype=bool) if own is None else own[places]
    return scores[row][order], ids[at][order], missing[at][order], same[row][order]


def _searcher(codes: Codes, width: int, k: int):
    def search(key: tuple, part: pa.Table, block: pa.Table) -> pa.Table:
        vectors = matrix(part.column("v"), width).astype(np.float64)
        queries = matrix(block.column("v"), width).astype(np.float64)
        index = Part(codes.of_vectors(vectors))
        lists = part.column("ids").combine_chunks()
        each = lists.flatten().field("vec_id")
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        owners = first, each.fill_null(_NULL_ID).to_numpy(), each.is_null().to_numpy(zero_copy_only=False)
        kept: list[list[np.ndarray]] = [[] for _ in range(5)]
        asked = zip(
            block.column("query").to_pylist(),
            codes.of_queries(queries),
            block.column("radius").to_pylist(),
            queries,
            strict=True,
        )
        for query, code, radius, vector in asked:
            places = index.within(code, radius)
            if len(places):
                own = (vectors == vector).all(axis=1)
                hits = _best(vector, places, vectors, owners, own, k)
                for column, cells in zip(kept, (np.full(len(hits[0]), query), *hits), strict=True):
                    column.append(cells)
        query, score, ids, missing, own = (np.concatenate(c) if c else np.zeros(0) for c in kept)
        return pa.table(
            {
                "query": pa.array(query.astype(np.int64)),
                "score": pa.array(score.astype(np.float64)),
                "vec_id": pa.array(ids.astype(np.int64), mask=missing.astype(bool)),
                "own": pa.array(own.astype(bool)),
            }
        )

    return search


def _search(index: DataFrame, queries: DataFrame, codes: Codes, width: int, k: int, parts: int, blocks: int) -> DataFrame:
    """The k best rows for each query: every block of queries meets every part of the index, each pair in a task of its own."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("v", "ids", "part", every(blocks).alias("block"))
    right = queries.select("v", "query", "radius", "block", every(parts).alias("part"))
    pairs = left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
    hits = pairs.applyInArrow(_searcher(codes, width, k), _HIT)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row that is a query, the k other rows with the largest inner products found,
    all of them where there are no more; nearest first, ties to the smaller ``vec_id``, nulls last.

    Vectors that are null, zero, or hold null or non-finite entries take no part; a shorter vector counts as one with zeros at
    its end. A row is left out of its own neighbours, other rows with its vector or its id are not.

    Equal vectors are indexed and searched once. Of the rows of one vector only the k + 1 least ids can be among k neighbours,
    so each vector keeps that many, cut before the shuffle, and no vector's copies fill a task. Parts and blocks are by hash.
    """
    usable = finite(column) & F.exists(column, lambda c: c != 0)
    rows = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"), is_query.alias("q"))
    by_id = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    least = rows.select("v", "vec_id").withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    index = stored(least.groupBy("v").agg(F.collect_list(F.struct("vec_id")).alias("ids")))
    asking = rows.where("q").select("v", "vec_id")
    queries = stored(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()))

    n, n_rows = index.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    asked, width = queries.count(), widest(index, "v")
    answers = "query_id long, rank int, vec_id long, score double"
    if not asked:
        return vectors.sparkSession.createDataFrame([], answers)
    parts, blocks = -(-n // PART), -(-asked // BLOCK)
    share = min(1.0, min(SAMPLE_ROWS, max(k + 1, SAMPLE_BYTES // (8 * width))) / n)
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = index.where(drawn).select("v").toArrow().column("v") if share < 1 else index.select("v").toArrow().column("v")
    codes = learn(matrix(sample, width).astype(np.float64), _longest(index, width), k)

    part = F.pmod(F.xxhash64(F.lit(1), "v"), F.lit(parts)).cast("int").alias("part")
    index = index.select("v", "ids", part)
    block = F.pmod(F.xxhash64(F.lit(2), "v"), F.lit(blocks)).cast("int").alias("block")
    queries = queries.select("v", "query", block)
    more = k + 1  # a query's own row is among them
    hits = stored(_search(index, queries.withColumn("radius", F.lit(codes.radius)), codes, width, more, parts, blocks))
    enough = min(more, n_rows)
    found = hits.groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    short = queries.join(found, "query", "left").where(F.coalesce("found", F.lit(0)) < enough)
    short = stored(short.select("v", "query", "block", F.lit(BITS).alias("radius")))
    if not short.isEmpty():
        again = _search(index, short, codes, width, more, parts, blocks)
        hits = hits.join(short, "query", "left_anti").unionByName(again)

    lists = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score", "own"))).alias("hits"))
    by_vector = lists.join(queries.select("query", "v"), "query").select("v", "hits")
    own = asking.join(by_vector, "v").select(F.col("vec_id").alias("query_id"), _without_own_row(k).alias("hits"))
    placed = own.select("query_id", F.posexplode("hits").alias("at", "hit"))
    return placed.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def _without_own_row(k: int) -> Column:
    """The first k hits but the query's own row; one row of that id and vector is the query."""
    mine = F.filter("hits", lambda h: h.own & h.vec_id.eqNullSafe(F.col("vec_id")))
    at = F.try_element_at(mine, F.lit(1)).getField("rank")
    return F.slice(F.filter("hits", lambda h: at.isNull() | (h.rank != at)), 1, k)


def _longest(index: DataFrame, width: int) -> float:
    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((lengths(matrix(b.column("v"), width).astype(np.float64)).max(initial=0.0) for b in batches), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([float(most)])], ["most"])

    return index.select("v").mapInArrow(longest, "most double").agg(F.max("most")).first()[0]
