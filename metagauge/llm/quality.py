"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed features of its form: runs of character classes, and words that repeat the one before or one
shortly before. The labelled sample gives their weights, and its leading singular directions the latent space. Each document
is then compared with every labelled vector, block by block, and its nearest ones vote by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from metagauge.llm.tables import whole_row
from metagauge.llm.words import FOLD, NOT_SPACE, hashes, mix, spans, steps, text_bytes

#: Labelled rows of each class that a model is fitted on: the bound of all that the driver holds and broadcasts.
SAMPLE = 2000
BUCKETS, DIMENSIONS, NEIGHBOURS = 1024, 32, 15
#: Documents compared with all labelled vectors at once.
BLOCK = 512
#: Words that may lie between a word and the one it repeats.
NEAR = 8

#: Classes of bytes: lower and upper case, digits, white space, line ends, other scripts; punctuation has one for each sign.
_CLASS = np.zeros(256, np.uint64)
_CLASS[0x21:0x7F] = np.arange(0x21, 0x7F)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 1
_CLASS[[0x20, 0x09]], _CLASS[0x0A] = 4, 5


def _bucket(kind: int, code: np.ndarray) -> np.ndarray:
    return (mix(code + np.uint64(kind << 48)) % np.uint64(BUCKETS)).astype(np.int64)


def features(column: pa.Array) -> np.ndarray:
    """A row of feature shares for each text, dampened; null and empty texts have only zeros."""
    data, borders = text_bytes(column)
    n = len(column)
    out = np.zeros(n * BUCKETS, np.float32)
    if not len(data):
        return out.reshape(n, BUCKETS)
    lengths = np.diff(borders)
    text = np.repeat(np.arange(n), lengths)
    kind = _CLASS[data]
    code = np.zeros(len(data), np.uint64)
    for order in range(1, 5):
        code = code * np.uint64(128) + np.concatenate([kind[order - 1 :], np.zeros(order - 1, np.uint64)])
        small = code if order < 3 else mix(code)
        inside = np.flatnonzero(np.arange(len(data)) + order <= borders[text + 1])
        table = _bucket(order, small[inside])
        out += np.bincount(text[inside] * BUCKETS + table, minlength=n * BUCKETS)
    starts, ends, first = spans(data, borders, NOT_SPACE)
    words = hashes(FOLD[data], starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    before = np.zeros(len(words), np.int64)
    for back in range(NEAR, 0, -1):
        same = np.flatnonzero((words[back:] == words[:-back]) & (owner[back:] == owner[:-back])) + back
        before[same] = back
    hit = np.flatnonzero(before)
    repeated = np.bincount(owner[hit] * BUCKETS + _bucket(9, before[hit].astype(np.uint64)), minlength=n * BUCKETS)
    out = out.reshape(n, BUCKETS) / np.maximum(lengths, 1)[:, None]
    out += 4 * repeated.reshape(n, BUCKETS) / np.maximum(np.diff(first), 1)[:, None]
    return np.sqrt(out).astype(np.float32)


@dataclass
class Neighbours:
    """Feature weights, the directions of the latent space, and the labelled vectors in it."""

    weight: np.ndarray
    mean: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.weight - self.mean) @ self.directions
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The share of label 1 among the nearest vectors, each weighted by its cosine, negative ones by nothing."""
        out = np.full(len(rows), 0.5)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(rows), BLOCK):
            cosine = self.latent(rows[at : at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.where(total > 1e-12, vote, 0.5)
        return np.clip(out, 0, 1)


def _model(rows: np.ndarray, labels: np.ndarray) -> Neighbours:
    weight = 1 / np.sqrt((rows**2).mean(0) + 1e-4) if len(rows) else np.ones(BUCKETS)
    weighted = rows * weight
    mean = weighted.mean(0) if len(rows) else np.zeros(BUCKETS)
    centred = (weighted - mean).astype(np.float64)
    _, directions = np.linalg.eigh(centred.T @ centred)
    model = Neighbours(
        weight.astype(np.float32),
        mean.astype(np.float32),
        directions[:, : -DIMENSIONS - 1 : -1].astype(np.float32),
        np.zeros((0, DIMENSIONS), np.float32),
        labels.astype(float),
    )
    model.vectors = model.latent(rows) if len(rows) else model.vectors
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    """Learns from at most ``sample`` rows of each label, those whose ids have the least hashes.

    ``labels`` holds ``doc_id, quality``; which of them may be learned from is the caller's choice. Rows without a label or an
    id are not learned from. Of an id that stands on several rows one is learned from, the one with the least row of shares.
    The driver gets that row of each sampled id, never a text.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = None
    for label in (0, 1):
        own = known.filter((F.col("quality") > 0) == F.lit(bool(label)))
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", 1_000_000):
                rows = [r.astype(np.float16).tobytes() for r in features(part.column("text"))]
                names = ["doc_id", "quality", "row"]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())], names=names
                )

    ids = [(r.doc_id, int(r.quality > 0)) for r in picked.collect()]
    spark = docs.sparkSession
    sampled = F.broadcast(spark.createDataFrame(ids, "doc_id long, quality int"))  # at most twice the sample
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sampled, "doc_id")
    texts = texts.select("doc_id", "quality", "text")
    each = texts.mapInArrow(rows_of, "doc_id long, quality int, row binary")
    found = sorted(each.groupBy("doc_id", "quality").agg(F.min("row").alias("row")).collect())
    rows = np.array([np.frombuffer(r.row, np.float16) for r in found], np.float32).reshape(len(found), BUCKETS)
    return _model(rows, np.array([r.quality for r in found]))


def score(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``row, score``: each document as a struct of all its columns, and from 0 to 1, the higher the likelier label 1.

    A null or empty text has no features and is judged by what such a text is nearest to; without labelled vectors every score
    is 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(whole_row(docs).alias("row"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, batch.column("row").field("text"), 1_000_000):
                found = shared.value.scores(features(part.column("row").field("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found)], names=["row", "score"])

    return rows.mapInArrow(scored, StructType([*rows.schema, StructField("score", DoubleType())]))


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: a fifth of all ids."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learned from the labelled rows that are not held out.

    A null id is not held out; repeated rows are judged each; other columns are not read.
    """
    model = fit(docs, labels.filter(~held_out()))
    found = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select(
        "row.doc_id",
        F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents with all their columns whose score reaches the threshold."""
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).filter(F.col("score") >= threshold).select("row.*")
