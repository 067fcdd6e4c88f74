"""Sharding by Karmarkar-Karp differencing: near-equal bytes for groups of rows that may not be divided."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metagauge.llm.tables import order_key, partitions, stored

#: Partial partitions that one task combines.
TOGETHER = 4096


def difference(sums: list[list[int]]) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions into one; each is the sums of its k parts.

    The two with the largest spread are added in opposite order, the largest part of one to the smallest of the other, until
    one is left. Returns for each given one where its parts went, and the sums of the parts of the result.
    """
    k = len(sums[0])
    own = [sorted(range(k), key=lambda j: (-s[j], j)) for s in sums]
    heap = []
    for i, s in enumerate(sums):
        ordered = [s[j] for j in own[i]]
        heap.append((ordered[-1] - ordered[0], i, ordered))
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        both = [x + y for x, y in zip(left, reversed(right), strict=True)]
        order = sorted(range(k), key=lambda j: (-both[j], j))
        both = [both[j] for j in order]
        merged.append((a, b, order))
        heapq.heappush(heap, (both[-1] - both[0], len(sums) + len(merged) - 1, both))
    goes = {heap[0][1]: list(range(k))}
    for node in range(len(sums) + len(merged) - 1, len(sums) - 1, -1):
        a, b, order = merged[node - len(sums)]
        to = goes.pop(node)
        first, second = [0] * k, [0] * k
        for place, j in enumerate(order):
            first[j] = second[k - 1 - j] = to[place]
        goes[a], goes[b] = first, second
    out = []
    for i in range(len(sums)):
        parts = [0] * k
        for place, j in enumerate(own[i]):
            parts[j] = goes[i][place]
        out.append(parts)
    return out, heap[0][2]


def _combined(items: DataFrame) -> DataFrame:
    """``id, bucket, goes, sums`` of each item: where its parts go among those of its bucket, and the bucket's sums."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        goes, sums = difference([list(map(int, s)) for s in pdf["sums"]])
        return pd.DataFrame({"id": pdf["id"], "bucket": pdf["bucket"], "goes": goes, "sums": [sums] * len(pdf)})

    return items.groupBy("bucket").applyInPandas(combine, "id binary, bucket binary, goes array<int>, sums array<long>")


def shard_of_groups(groups: DataFrame, shards: int, together: int = TOGETHER) -> DataFrame:
    """``id, shard`` for groups ``id binary, bytes long`` with distinct ids, so that the shards' bytes are near equal.

    Groups are dealt to buckets of about ``together``; a task partitions a bucket; the buckets, now partial partitions of
    some parts each, are dealt and combined in the same way, level by level until one is left. No task and no driver holds
    more than a bucket.
    """
    first = F.array(F.col("bytes"), *[F.lit(0).cast("long")] * (shards - 1))
    items, levels = groups.select("id", first.alias("sums")), []
    n = groups.count()
    while True:
        buckets = -(-n // together) or 1
        dealt = F.pmod(F.xxhash64("id", F.lit(len(levels))), F.lit(buckets))
        bucket = F.encode(F.concat(F.lit(f"{len(levels)}:"), dealt.cast("string")), "utf-8")
        level = stored(_combined(items.select("id", "sums", bucket.alias("bucket"))))
        levels.append(level)
        if buckets == 1:
            break
        items = level.groupBy("bucket").agg(F.first("sums").alias("sums")).withColumnRenamed("bucket", "id")
        n = buckets
    at = levels[0].select("id", "bucket", F.element_at("goes", 1).alias("shard"))
    for level in levels[1:]:
        up = level.select(F.col("id").alias("bucket"), F.col("bucket").alias("next"), "goes")
        at = at.join(up, "bucket").select("id", F.col("next").alias("bucket"), F.expr("goes[shard]").alias("shard"))
    return at.select("id", "shard")


def shard_by_bytes(docs: DataFrame, shards: int = 8, together: int = TOGETHER) -> DataFrame:
    """Puts every document into one of ``shards`` shards of near-equal bytes; equal texts stay together.

    ``doc_id, size, text_crc32, law, shard, slot, grown_shard``: the size is the text's bytes and 1; slots count the rows of
    a shard from 0 on, by a hash of the id; ``grown_shard`` is null, as this law moves rows when shards are added. Null texts
    have size 1 and the crc of an empty text, and are a group of their own; null ids and repeated rows are rows like others;
    other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(text, 256)), 1, 16)
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit(b"")).otherwise(digest).alias("id"),
        )
    )
    shard = shard_of_groups(rows.groupBy("id").agg(F.sum("size").alias("bytes")), shards, together)
    part = F.pmod(F.xxhash64("doc_id", "id"), F.lit(4 * partitions(docs.sparkSession))).cast("int")
    placed = stored(rows.join(shard, "id").withColumn("part", part))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "part").orderBy(order_key(), "id")
    numbered = placed.withColumn("within", F.row_number().over(own) - 1).join(starts, ["shard", "part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("start") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
