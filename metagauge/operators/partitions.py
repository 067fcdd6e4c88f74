"""Partition statistics and what is derived from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import (
    bytes_to_mb,
    gauge_band,
    grouped_text,
    megabytes,
    partition_columns,
    partition_label,
    safe_average,
    skew_class,
)
from ..plans.file_stats import as_stats
from ..plans.running import running_totals
from ..plans.top import top_per_group
from ..schemas import CONTENT_DATA, CONTENT_EQUALITY_DELETES, CONTENT_POSITION_DELETES

METRIC_COLUMNS = ("data_file_count", "delete_file_count", "total_data_file_size", "avg_file_size_per_partition")


def _sum_where(value: str, content: int) -> Column:
    return F.sum(F.when(F.col("content") == content, F.col(value)).otherwise(F.lit(0))).cast("bigint")


def partition_stats(files: DataFrame) -> DataFrame:
    """One row per table, partition spec and partition; ``file_count``, records and bytes are those of data files."""
    return (
        as_stats(files)
        .groupBy("table_name", "spec_id", "partition")
        .agg(
            _sum_where("record_count", CONTENT_DATA).alias("record_count"),
            _sum_where("file_count", CONTENT_DATA).alias("file_count"),
            _sum_where("total_bytes", CONTENT_DATA).alias("total_data_file_size_in_bytes"),
            _sum_where("file_count", CONTENT_POSITION_DELETES).alias("position_delete_file_count"),
            _sum_where("file_count", CONTENT_EQUALITY_DELETES).alias("equality_delete_file_count"),
        )
    )


def partition_metrics(partitions: DataFrame) -> DataFrame:
    """Size and file counts per partition.

    The counts belong to the key: the same partition under two specs stays apart while its counts differ, and merges
    once they agree. The average divides the merged size by one row's count.
    """
    merged = (
        partitions.select(
            "table_name",
            "partition",
            F.col("file_count").alias("data_file_count"),
            (F.col("position_delete_file_count") + F.col("equality_delete_file_count")).alias("delete_file_count"),
            "total_data_file_size_in_bytes",
        )
        .groupBy("table_name", "partition", "data_file_count", "delete_file_count")
        .agg(F.sum("total_data_file_size_in_bytes").alias("total_data_file_size"))
    )
    return merged.withColumn(
        "avg_file_size_per_partition", safe_average(F.col("total_data_file_size"), F.col("data_file_count"))
    )


def in_report_order(metrics: DataFrame) -> DataFrame:
    """Many small files first: data files descending, average size ascending."""
    return metrics.orderBy(
        "table_name",
        F.desc("data_file_count"),
        F.asc("avg_file_size_per_partition"),
        partition_label(metrics),
    )


def partition_flatten(metrics: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The partition tuple as leading columns ``partition_<field>``."""
    rest = [c for c in metrics.columns if c not in ("table_name", "partition")]
    return metrics.select("table_name", *partition_columns(metrics, names=names), *rest)


def partition_display(metrics: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """The table as shown: fields without a prefix, sizes as MB texts."""
    return metrics.select(
        "table_name",
        *partition_columns(metrics, names=names, prefix=""),
        "data_file_count",
        "delete_file_count",
        grouped_text(megabytes("total_data_file_size"), suffix=" MB").alias("total_data_size_mb"),
        grouped_text(megabytes("avg_file_size_per_partition"), suffix=" MB").alias("avg_file_size_mb"),
    )


def partition_totals(metrics: DataFrame) -> DataFrame:
    totals = metrics.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("total_partitions"),
        F.sum("data_file_count").alias("total_data_files"),
        F.sum("delete_file_count").alias("total_delete_files"),
        F.sum("total_data_file_size").alias("total_data_size"),
    )
    return totals.withColumn("total_data_size_mb", bytes_to_mb("total_data_size"))


def partition_totals_display(totals: DataFrame) -> DataFrame:
    """The totals as texts with grouped digits."""
    return totals.select(
        "table_name",
        grouped_text("total_partitions", 0).alias("total_partitions"),
        grouped_text("total_data_files", 0).alias("total_data_files"),
        grouped_text("total_delete_files", 0).alias("total_delete_files"),
        grouped_text(megabytes("total_data_size"), suffix=" MB").alias("total_data_size"),
    )


QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}

# Sizes are multiples of 0.01 MB, so a slice this wide holds at most 65,536 different ones.
_SLICE_MB = 655.36


def partition_size_describe(metrics: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of the partition sizes in rounded MB.

    Quartiles interpolate linearly. They are exact: equal sizes are counted first, then the counts are accumulated along
    the sizes in bounded slices, so a table with any number of partitions is never gathered in one task. With ``accuracy``
    they are sizes whose ranks are off by at most one part in that many, from a single aggregate.
    """
    sizes = metrics.select("table_name", bytes_to_mb("total_data_file_size").alias("mb"))
    if accuracy is not None:
        quartiles = [F.percentile_approx("mb", q, accuracy).alias(name) for name, q in QUANTILES.items()]
        return sizes.groupBy("table_name").agg(
            F.count("mb").alias("count"),
            F.avg("mb").alias("mean"),
            F.stddev_samp("mb").alias("std"),
            F.min("mb").alias("min"),
            *quartiles,
            F.max("mb").alias("max"),
        )
    moments = sizes.groupBy("table_name").agg(
        F.count("mb").alias("count"),
        F.avg("mb").alias("mean"),
        F.stddev_samp("mb").alias("std"),
        F.min("mb").alias("min"),
        F.max("mb").alias("max"),
    )
    counts = sizes.groupBy("table_name", "mb").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("slice", F.floor(F.col("mb") / _SLICE_MB))
    ranked = running_totals(counts, ["table_name"], ["slice"], "mb", {"n": "upto"})

    # A value covers the 0-based ranks [upto - n, upto).
    placed = ranked.join(moments.select("table_name", "count"), "table_name")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("mb")))

    bounds = []
    for name, q in QUANTILES.items():
        position = (F.col("count") - 1) * F.lit(q)
        bounds += [at(F.floor(position)).alias(f"{name}_low"), at(F.ceil(position)).alias(f"{name}_high")]
    bounded = placed.groupBy("table_name").agg(*bounds)

    result = moments.join(bounded, "table_name")
    columns = []
    for name, q in QUANTILES.items():
        position = (F.col("count") - 1) * F.lit(q)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        part = position - F.floor(position)
        # From the nearer neighbour, so that the last digit is the same as numpy's.
        upper = high - (high - low) * (1 - part)
        columns.append(F.when(part < 0.5, low + (high - low) * part).otherwise(upper).alias(name))
    return result.select("table_name", "count", "mean", "std", "min", *columns, "max")


# Names of the statistics, in report order.
STATISTICS = {
    "count": "count",
    "mean": "mean",
    "std": "std",
    "min": "min",
    "p25": "25%",
    "p50": "50%",
    "p75": "75%",
    "max": "max",
}


def describe_rows(described: DataFrame) -> DataFrame:
    """The description as one row per statistic, the value as text."""
    wide = described.select(
        "table_name", *[F.col(c).cast("double").alias(name) for c, name in STATISTICS.items()]
    )
    rows = wide.unpivot(["table_name"], [F.col(f"`{n}`") for n in STATISTICS.values()], "statistic", "value")
    return rows.select("table_name", "statistic", grouped_text("value").alias("value_mb"))


def _coefficient_of_variation(std: Column, mean: Column) -> Column:
    return F.when(mean > 0, std / mean).otherwise(F.lit(0.0))


def partition_skew_sample(metrics: DataFrame) -> DataFrame:
    """Sample deviation over mean of the partition sizes; undefined (NULL) for a single partition."""
    size = F.col("total_data_file_size")
    return metrics.groupBy("table_name").agg(
        _coefficient_of_variation(F.stddev_samp(size), F.avg(size)).alias("skewness")
    )


def population_skew(size: Column) -> Column:
    """Aggregate: population deviation over mean, 0 where that is undefined."""
    return F.coalesce(_coefficient_of_variation(F.stddev_pop(size), F.avg(size)), F.lit(0.0))


def partition_skew_population(metrics: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Population deviation over mean of the partition sizes; 0 without partitions."""
    skew = metrics.groupBy("table_name").agg(population_skew(F.col("total_data_file_size")).alias("skewness"))
    if tables is None:
        return skew
    return tables.select("table_name").join(skew, "table_name", "left").na.fill(0.0, ["skewness"])


def partition_skew_class(sample_skew: DataFrame) -> DataFrame:
    return sample_skew.withColumn("skew_class", skew_class("skewness"))


def skew_gauge_band(population_skew: DataFrame) -> DataFrame:
    return population_skew.withColumn("band", gauge_band("skewness"))


def partition_distribution(partitions: DataFrame) -> DataFrame:
    """Mean, largest, smallest, sample deviation and skew of records and files per partition.

    Deviation and skew are 0 for a single partition, skew also for a mean of 0.
    """

    def spread(column: str, name: str) -> list[Column]:
        value = F.col(column)
        deviation = F.coalesce(F.stddev_samp(value), F.lit(0.0))
        mean = F.sum(value) / F.count(value)
        return [
            mean.alias(f"avg_{name}"),
            F.max(value).alias(f"max_{name}"),
            F.min(value).alias(f"min_{name}"),
            deviation.alias(f"deviation_{name}"),
            F.when(mean != 0, deviation / mean).otherwise(F.lit(0.0)).alias(f"skew_{name}"),
        ]

    return partitions.groupBy("table_name").agg(
        *spread("record_count", "record_count"), *spread("file_count", "file_count")
    )


def partition_file_histogram(metrics: DataFrame, bins: int = 20) -> DataFrame:
    """Partitions per equal-width bin of their data file count; the last bin includes its upper end.

    Equal counts are added up first; each table's range, and the join with it, then see one row per distinct count.
    """
    counts = metrics.groupBy("table_name", "data_file_count").agg(F.count(F.lit(1)).alias("n"))
    ranges = counts.groupBy("table_name").agg(
        F.min("data_file_count").alias("lo"), F.max("data_file_count").alias("hi")
    )
    lo, hi = F.col("lo"), F.col("hi")
    width = (hi - lo) / F.lit(float(bins))
    spread = F.least(F.floor((F.col("data_file_count") - lo) * bins / (hi - lo)) + 1, F.lit(bins))
    bin_no = F.when(hi > lo, spread).otherwise(F.lit(1)).cast("int")
    return (
        counts.join(ranges, "table_name")
        .groupBy("table_name", bin_no.alias("bin"), "lo", "hi")
        .agg(F.sum("n").alias("partitions"))
        .select(
            "table_name",
            "bin",
            (lo + width * (F.col("bin") - 1)).alias("bin_start"),
            (lo + width * F.col("bin")).alias("bin_end"),
            "partitions",
        )
    )


def partition_size_vs_files(metrics: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    return metrics.select(
        "table_name",
        *partition_columns(metrics, names=names),
        "data_file_count",
        "delete_file_count",
        "avg_file_size_per_partition",
        bytes_to_mb("total_data_file_size").alias("total_data_size_mb"),
    )


def top_partitions_by_size(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """The largest partitions of each table by rounded MB, equal sizes by label."""
    labelled = metrics.select(
        "table_name",
        partition_label(metrics).alias("partition_label"),
        bytes_to_mb("total_data_file_size").alias("total_data_size_mb"),
        "data_file_count",
        "delete_file_count",
    )
    order = [
        F.desc("total_data_size_mb"),
        F.asc("partition_label"),
        F.desc("data_file_count"),
        F.desc("delete_file_count"),
    ]
    return top_per_group(labelled, "table_name", order, limit, rank="rank")
