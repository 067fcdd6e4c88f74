"""The shared file aggregate.

Live metrics, file metrics, partition statistics and everything behind them are functions of counts, sums, minima and
maxima per (table, spec, partition, content). Those re-aggregate exactly, so one pass over the manifest entries serves
all of them; the roll-ups then read thousands of rows instead of millions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

FULL_KEYS = ("table_name", "spec_id", "partition", "content")

_SUMS = ("file_count", "record_count", "total_bytes")
_MINS = ("min_record_count", "min_bytes")
_MAXS = ("max_record_count", "max_bytes")


def as_stats(files: DataFrame) -> DataFrame:
    """Files in the shape of the aggregate: each row stands for itself. Costs a projection, no shuffle."""
    if "total_bytes" in files.columns:
        return files
    size = F.col("file_size_in_bytes")
    return files.select(
        *[c for c in FULL_KEYS if c in files.columns],
        F.lit(1).cast("bigint").alias("file_count"),
        F.col("record_count"),
        F.col("record_count").alias("min_record_count"),
        F.col("record_count").alias("max_record_count"),
        size.alias("total_bytes"),
        size.alias("min_bytes"),
        size.alias("max_bytes"),
    )


def file_stats(files: DataFrame, keys: Sequence[str] = FULL_KEYS) -> DataFrame:
    """Counts, sums, minima and maxima of ``files``, or of an earlier aggregate of them, per ``keys``."""
    return (
        as_stats(files)
        .groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in _SUMS],
            *[F.min(c).alias(c) for c in _MINS],
            *[F.max(c).alias(c) for c in _MAXS],
        )
    )
