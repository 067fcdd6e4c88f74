"""The health summary of a table and its per-partition tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import format_bytes, partition_label
from .partitions import population_skew


def _count_per_table(df: DataFrame, name: str) -> DataFrame:
    """Rows of each table; a row without one is refused when it is counted."""
    known = F.coalesce("table_name", F.raise_error(F.lit("the listing must tell the table of each file")))
    return df.groupBy(known.alias("table_name")).agg(F.count(F.lit(1)).alias(name))


def health_summary(
    tables: DataFrame, partition_metrics: DataFrame, orphans: DataFrame, expirable: DataFrame
) -> DataFrame:
    """Totals, skew, and numbers of orphan files and expirable snapshots, one row per table.

    Sizes and counts cover data files, so they agree with the partition metrics. Lists and per-partition maps stay
    DataFrames of their own (orphans, expirable snapshots and the two functions below): packed into one row they would
    have to fit one task. Orphans of unknown tables are refused when the summary is computed, as they would count for none.
    """
    totals = partition_metrics.groupBy("table_name").agg(
        F.sum("total_data_file_size").alias("total_size_bytes"),
        F.sum("data_file_count").alias("total_files"),
        F.count(F.lit(1)).alias("total_partitions"),
        population_skew(F.col("total_data_file_size")).alias("partition_skewness"),
    )
    joined = (
        tables.select("table_name")
        .join(totals, "table_name", "left")
        .join(_count_per_table(orphans, "orphan_file_count"), "table_name", "left")
        .join(_count_per_table(expirable, "expirable_snapshot_count"), "table_name", "left")
        .na.fill(0)
    )
    average = F.when(
        F.col("total_partitions") > 0, F.col("total_size_bytes") / F.col("total_partitions")
    ).otherwise(F.lit(0.0))
    return joined.select(
        "table_name",
        "total_size_bytes",
        format_bytes("total_size_bytes").alias("total_size_text"),
        "total_files",
        "total_partitions",
        average.alias("average_partition_size_bytes"),
        "partition_skewness",
        "orphan_file_count",
        "expirable_snapshot_count",
    )


def files_per_partition(partition_metrics: DataFrame) -> DataFrame:
    label = partition_label(partition_metrics).alias("partition_label")
    return partition_metrics.groupBy("table_name", label).agg(F.sum("data_file_count").alias("file_count"))


def partition_sizes(partition_metrics: DataFrame) -> DataFrame:
    label = partition_label(partition_metrics).alias("partition_label")
    sizes = partition_metrics.groupBy("table_name", label).agg(F.sum("total_data_file_size").alias("size_bytes"))
    return sizes.withColumn("size_text", format_bytes("size_bytes"))
