"""Metrics over the live files of a table. Inputs are live files, or the shared aggregate of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import file_type, fixed_text, grouped_text, half_even_mean, megabytes
from ..plans.file_stats import as_stats, file_stats
from ..schemas import CONTENT_DATA, CONTENT_EQUALITY_DELETES, CONTENT_POSITION_DELETES


def _sum_where(value: str, content: int) -> Column:
    # 0, not NULL, where a table has no such file: a NULL would swallow differences built on it.
    return F.coalesce(F.sum(F.when(F.col("content") == content, F.col(value))), F.lit(0)).cast("bigint")


LIVE_COLUMNS = (
    "total_data_files",
    "total_delete_files",
    "total_files_size",
    "data_file_size",
    "delete_file_size",
    "record_count",
    "total_equality_delete_files",
    "equality_delete_file_size",
)


def live_table_metrics(files: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Counts and sizes of the live files, and the records that position deletes leave.

    ``total_files_size`` covers every file, the delete columns cover position deletes; equality deletes have columns of
    their own. With ``tables``, a table without any file gets a row of zeros.
    """
    metrics = (
        as_stats(files)
        .groupBy("table_name")
        .agg(
            _sum_where("file_count", CONTENT_DATA).alias("total_data_files"),
            _sum_where("file_count", CONTENT_POSITION_DELETES).alias("total_delete_files"),
            F.coalesce(F.sum("total_bytes"), F.lit(0)).cast("bigint").alias("total_files_size"),
            _sum_where("total_bytes", CONTENT_DATA).alias("data_file_size"),
            _sum_where("total_bytes", CONTENT_POSITION_DELETES).alias("delete_file_size"),
            (
                _sum_where("record_count", CONTENT_DATA) - _sum_where("record_count", CONTENT_POSITION_DELETES)
            ).alias("record_count"),
            _sum_where("file_count", CONTENT_EQUALITY_DELETES).alias("total_equality_delete_files"),
            _sum_where("total_bytes", CONTENT_EQUALITY_DELETES).alias("equality_delete_file_size"),
        )
    )
    if tables is None:
        return metrics
    return tables.select("table_name").join(metrics, "table_name", "left").na.fill(0, list(LIVE_COLUMNS))


def live_size_mb(live: DataFrame) -> DataFrame:
    """The three sizes in MB."""
    return live.select(
        "table_name",
        megabytes("total_files_size").alias("total_files_mb"),
        megabytes("data_file_size").alias("data_file_mb"),
        megabytes("delete_file_size").alias("delete_file_mb"),
    )


def live_display(live: DataFrame) -> DataFrame:
    """The live metrics as shown: sizes as MB texts, records with grouped digits."""
    return live.select(
        "table_name",
        "total_data_files",
        "total_delete_files",
        fixed_text(megabytes("total_files_size"), " MB").alias("total_files_size"),
        fixed_text(megabytes("data_file_size"), " MB").alias("data_file_size"),
        fixed_text(megabytes("delete_file_size"), " MB").alias("delete_file_size"),
        grouped_text("record_count", 0).alias("record_count"),
    )


def live_file_share(live: DataFrame) -> DataFrame:
    """Data and delete files as rows, with their share of both; no share where a table has neither."""
    both = F.col("total_data_files") + F.col("total_delete_files")
    rows = live.select("table_name", "total_data_files", "total_delete_files", both.alias("both")).unpivot(
        ["table_name", "both"], ["total_data_files", "total_delete_files"], "kind", "file_count"
    )
    return rows.select(
        "table_name",
        F.when(F.col("kind") == "total_data_files", F.lit("Data Files"))
        .otherwise(F.lit("Delete Files"))
        .alias("label"),
        "file_count",
        F.when(F.col("both") > 0, F.col("file_count") / F.col("both")).alias("share"),
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """Count, mean, largest and smallest per content type.

    Both kinds of delete files carry the label ``DELETE_FILES``; ``content`` tells them apart.
    """
    n = F.col("file_count")
    return file_stats(files, ("table_name", "content")).select(
        "table_name",
        "content",
        file_type().alias("file_type"),
        n,
        half_even_mean(F.col("record_count"), n).alias("avg_record_count"),
        "max_record_count",
        "min_record_count",
        half_even_mean(F.col("total_bytes"), n).alias("avg_file_size"),
        F.col("max_bytes").alias("max_file_size"),
        F.col("min_bytes").alias("min_file_size"),
    )


def file_metrics_display(metrics: DataFrame) -> DataFrame:
    """The file metrics as shown."""
    counts = ("file_count", "max_record_count", "min_record_count")
    sizes = ("avg_file_size", "max_file_size", "min_file_size")
    return metrics.select(
        "table_name",
        "content",
        "file_type",
        *[grouped_text(c, 0).alias(c) for c in counts],
        grouped_text("avg_record_count").alias("avg_record_count"),
        *[fixed_text(megabytes(c), " MB").alias(c) for c in sizes],
    )


def file_type_comparison(metrics: DataFrame) -> DataFrame:
    """File types side by side, for tables that have more than one. A table has at most three rows here."""
    types = F.count(F.lit(1)).over(Window.partitionBy("table_name"))
    return (
        metrics.withColumn("types", types)
        .where("types > 1")
        .select(
            "table_name",
            "content",
            "file_type",
            "file_count",
            "avg_record_count",
            megabytes("avg_file_size").alias("avg_file_size_mb"),
        )
    )
