"""Document fingerprints: sketches that keep every shingle hash below a fixed threshold."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metagauge.llm.tables import order_key, partitions, range_of
from metagauge.llm.words import steps, substring_hashes, text_bytes

#: Bytes of a shingle, and the share of all hashes that a sketch keeps: one in 2**KEPT_BITS.
SHINGLE_BYTES = 12
KEPT_BITS = 4
#: Below the threshold a hash has this many bits left.
_HASH_BITS = 32 - KEPT_BITS


def sketch_keys(column: pa.Array, width: int = SHINGLE_BYTES) -> np.ndarray:
    """``text << 32 | hash`` for every kept hash of every text, ascending and distinct.

    Shingles are all runs of ``width`` bytes, a shorter text being one shingle. A hash is kept if it is below the threshold;
    a text whose hashes all lie above keeps its least one, so no text but an empty one has an empty sketch.
    """
    data, borders = text_bytes(column)
    lengths = np.diff(borders)
    count = np.where(lengths >= width, lengths - width + 1, lengths > 0)
    text = np.repeat(np.arange(len(lengths)), count)
    starts = borders[text] + np.arange(len(text)) - (np.cumsum(count) - count)[text]
    value = substring_hashes(data, starts, np.minimum(starts + width, borders[text + 1])) >> np.uint64(32)
    kept = value < np.uint64(1 << _HASH_BITS)
    has = np.zeros(len(lengths), bool)
    has[text[kept]] = True
    bare = np.flatnonzero(~has & (count > 0))
    least = np.zeros(0, np.uint64)
    if len(bare):
        first = (np.cumsum(count) - count)[count > 0]
        least = np.minimum.reduceat(value, first)[np.searchsorted(np.flatnonzero(count > 0), bare)]
    keys = np.concatenate([text[kept], bare]).astype(np.uint64) << np.uint64(32)
    return np.unique(keys | np.concatenate([value[kept], least]))


def _split(keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


def _as_text(keys: np.ndarray, n: int) -> list[str]:
    """Each text's hashes in ascending order, 8 hex digits a hash."""
    digits = (keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
    at = (8 * _split(keys, n)).tolist()
    return [digits[a:b] for a, b in zip(at, at[1:], strict=False)]


def _likeness(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Shared over all hashes of each pair of sketches; two empty ones are alike."""
    shared = np.diff(_split(np.intersect1d(a, b, assume_unique=True), n))
    total = np.diff(_split(a, n)) + np.diff(_split(b, n)) - shared
    return np.where(total == 0, 1.0, shared / np.maximum(total, 1))


def sketches(docs: DataFrame, name: str = "sketch") -> DataFrame:
    """``doc_id`` and the sketch of every whole text, an ascending array of hashes; :func:`merged`, :func:`containment` and
    :func:`resemblance` work on them.

    Null and empty texts have an empty sketch; null ids and repeated rows are rows like others; other columns are not read.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                keys = sketch_keys(part.column("text"))
                offsets = pa.array(_split(keys, part.num_rows).astype(np.int32))
                values = pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", name]
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(made, f"doc_id long, {name} array<long>")


def _regular(sketch: str | Column) -> Column:
    """The hashes below the threshold, without the one that stands in where there is none."""
    return F.filter(sketch, lambda h: h < (1 << _HASH_BITS))


def merged(a: str, b: str) -> Column:
    """The sketch of both texts' shingles together, exactly: the threshold is the same for all, and where no hash lies below
    it, the least of all is kept again."""
    both = F.array_sort(F.array_union(a, b))
    return F.when(F.size(_regular(both)) > 0, _regular(both)).otherwise(F.slice(both, 1, 1))


def containment(a: str, b: str) -> Column:
    """The share of a's shingles that b has, unbiased however unequal the two are; null where a has no hash below the
    threshold, as nothing is known then: of texts of 30 bytes about 3 in 10, of 60 bytes 1 in 25."""
    own = _regular(a)
    return F.size(F.array_intersect(own, b)) / F.nullif(F.size(own), F.lit(0))


def resemblance(a: str, b: str) -> Column:
    """Shared over all shingles; 1 for two empty sketches. Of texts without a hash below the threshold only the least hashes
    are compared, which tells equal ones and little else."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last quarter of code points, rounded down, replaced by the first as many, or all, of the next
    document in ascending ``doc_id``; the first follows the last. ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    The documents are dealt once, by ranges of the id; each range also gets the first document of the range that follows.
    Null ids come first; equal ids are ordered by their texts; null texts are empty; two empty fingerprints are alike; one
    document alone follows itself; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), order_key().alias("key")
    )
    rows = rows.withColumn("part", range_of(rows, "key", 4 * partitions(spark)))
    heads = sorted(rows.groupBy("part").agg(F.min("key")).collect())  # a row for each range
    before = [(key, heads[i - 1][0]) for i, (_, key) in enumerate(heads)]
    ahead = spark.createDataFrame(before, "key long, part int")
    ahead = rows.drop("part").join(F.broadcast(ahead), "key").groupBy("part", "key").agg(F.min("text").alias("text"))
    both = rows.select("part", F.lit(0).alias("ahead"), "key", "doc_id", "text").union(
        ahead.select("part", F.lit(1), "key", F.lit(None).cast("long"), "text")
    )
    dealt = both.repartition(partitions(spark), "part").sortWithinPartitions("part", "ahead", "key", "text")
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double"
    )
    return dealt.select("ahead", "doc_id", "text").mapInArrow(_compared, schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each but the rows from ahead is compared with the row that follows it."""
    waiting: tuple | None = None
    for batch in batches:
        for part in steps(batch, "text", 1_000_000):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            is_ahead = part.column("ahead").to_pylist()
            if waiting:
                ids, texts, is_ahead = [waiting[0], *ids], [waiting[1], *texts], [waiting[2], *is_ahead]
            waiting = ids[-1], texts[-1], is_ahead[-1]
            n = len(texts) - 1
            if not n:
                continue
            edited = []
            for text, following in zip(texts, texts[1:], strict=False):
                cut = len(text) // 4
                edited.append(text[: len(text) - cut] + following[:cut])
            own = sketch_keys(pa.array(texts))
            last = np.uint64(n) << np.uint64(32)
            one = np.uint64(1) << np.uint64(32)
            following, own = own[own >= one] - one, own[own < last]
            changed = sketch_keys(pa.array(edited))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[:n], pa.int64()),
                    pa.array([len(t) for t in texts[:n]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(_as_text(own, n)),
                    pa.array(_as_text(changed, n)),
                    pa.array(_likeness(own, changed, n)),
                    pa.array(_likeness(own, following, n)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            yield out.filter(pa.array([not a for a in is_ahead[:n]]))
