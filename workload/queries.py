"""The registered queries: every operator over the derived relations, all rows of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from metagauge import TableAnalyzer
from metagauge.functions import bytes_to_mb, format_bytes, partition_label, short_table_name, utc_micros, utc_text
from metagauge.operators import files as file_ops
from metagauge.operators import health as health_ops
from metagauge.operators import orphans as orphan_ops
from metagauge.operators import partitions as partition_ops
from metagauge.operators import snapshots as snapshot_ops
from metagauge.plans.lineage import stored
from metagauge.plans.report import table_report_row
from metagauge.sources import catalog, manifests, metadata, storage

from . import relations as rel
from .lake import lake

AS_OF = dt.datetime.fromisoformat(rel.AS_OF)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles that depend on the order of addition, cut to digits that do not."""
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


def _flat_partition(df: DataFrame) -> DataFrame:
    """The partition struct as its two columns."""
    rest = [c for c in df.columns if c != "partition"]
    return df.select("partition.part_status", "partition.part_month", *rest)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_ops.partition_metrics(partition_ops.partition_stats(rel.files(spark, sf_dir)))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_ops.live_table_metrics(rel.files(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_ops.historical_snapshots(rel.snapshots(spark, sf_dir), 20)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_ops.snapshot_summary_metrics(rel.commits(spark, sf_dir))


# -- sources -----------------------------------------------------------------------------------------------------------


@register("src_metadata_json")
def _(spark, sf_dir):
    t = metadata.tables(metadata.parse_documents(rel.documents(spark, sf_dir)))
    return t.select(
        "table_name", "metadata_location", "table_uuid", "location", "format_version", "current_snapshot_id"
    )


@register("src_catalog_load")
def _(spark, sf_dir):
    return catalog.newest_metadata(rel.metadata_paths(spark, sf_dir))


@register("fleet_newest_metrics")
def _(spark, sf_dir):
    """Change metrics of the newest version of each table, among documents of all versions."""
    newest = catalog.newest_metadata(rel.metadata_paths(spark, sf_dir)).select("metadata_location")
    parsed = metadata.parse_documents(rel.documents(spark, sf_dir).join(newest, "metadata_location"))
    return snapshot_ops.latest_snapshot_metrics(metadata.tables(parsed), metadata.snapshots(parsed))


@register("src_shared_manifests")
def _(spark, sf_dir):
    """Files of tables that are registered under two names with different specs over the same manifests."""
    own = rel.manifests(spark, sf_dir)
    second = own.withColumns({"table_name": F.concat(F.lit("copy_of_"), F.col("table_name")), "spec_id": F.lit(1)})
    entries = manifests.parse_entries(rel.owned_records(spark, sf_dir, own.unionByName(second)))
    return entries.groupBy("table_name", "spec_id").agg(
        F.count(F.lit(1)).alias("entry_count"), F.sum("record_count").alias("record_count")
    )


@register("catalog_inventory")
def _(spark, sf_dir):
    inventory = metadata.catalog_inventory(rel.documents(spark, sf_dir))
    columns = F.transform(F.map_entries("schema"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return inventory.select(
        "database",
        "name",
        "location",
        F.try_element_at("properties", F.lit("owner")).alias("owner"),
        F.concat_ws(", ", "partition_keys").alias("partition_keys"),
        F.concat_ws(", ", columns).alias("schema"),
    )


@register("fleet_errors")
def _(spark, sf_dir):
    parsed = metadata.parse_documents(rel.documents(spark, sf_dir))
    return metadata.fleet_errors(parsed).select("table_name", "metadata_location")


@register("src_snapshots")
def _(spark, sf_dir):
    s = metadata.snapshots(metadata.parse_documents(rel.documents(spark, sf_dir)))
    metrics = snapshot_ops.summary_metrics()
    return s.select(
        "table_name",
        "snapshot_id",
        "parent_id",
        utc_text(utc_micros("committed_at")).cast("timestamp_ntz").alias("committed_at"),
        "timestamp_ms",
        "operation",
        "manifest_list",
        *metrics,
    )


@register("src_files_live")
def _(spark, sf_dir):
    entries = manifests.parse_entries(rel.owned_records(spark, sf_dir, rel.manifests(spark, sf_dir))).drop("error")
    live = manifests.live_files(entries)
    names = ("part_status", "part_month")
    return live.select(
        *[c for c in live.columns if c not in ("partition", "manifest_path")],
        *[F.try_element_at(F.map_from_entries("partition"), F.lit(n)).alias(n) for n in names],
    )


# Through the readers themselves, over files that are written for it.


def _lake(spark, sf_dir):
    return TableAnalyzer(spark, warehouse=lake(spark, sf_dir), database="*", strict=False)


def _name(path: str):
    return F.regexp_extract(path, "[^/]*$", 0).alias("file_name")


@register("lake_live_metrics")
def _(spark, sf_dir):
    return _lake(spark, sf_dir).live_table_metrics()


@register("lake_partition_metrics")
def _(spark, sf_dir):
    found = _lake(spark, sf_dir).partition_metrics()
    label = partition_label(found).alias("partition_label")
    return found.select("table_name", label, "data_file_count", "total_data_file_size")


@register("lake_listing")
def _(spark, sf_dir):
    listing = _lake(spark, sf_dir).storage()
    return listing.where("file_path LIKE '%.parquet'").select("table_name", _name("file_path"), "length")


@register("lake_orphans")
def _(spark, sf_dir):
    own = _lake(spark, sf_dir)
    return own.orphan_files(own.storage()).select("table_name", _name("file_path"), "length")


@register("lake_errors")
def _(spark, sf_dir):
    return _lake(spark, sf_dir).errors.select("table_name", _name("error"))


@register("src_partitions")
def _(spark, sf_dir):
    return _flat_partition(partition_ops.partition_stats(rel.files(spark, sf_dir))).drop("spec_id")


@register("src_referenced_files")
def _(spark, sf_dir):
    return orphan_ops.referenced_files(rel.all_entries(spark, sf_dir))


@register("src_storage_listing")
def _(spark, sf_dir):
    listing = storage.inventory_listing(rel.storage(spark, sf_dir), "file_path", "file_size_in_bytes")
    return listing.select("file_path", "length")


@register("current_snapshot")
def _(spark, sf_dir):
    current = snapshot_ops.current_snapshot(rel.tables(spark, sf_dir), rel.commits(spark, sf_dir))
    return current.select(
        "table_name", "current_snapshot_id", "snapshot_id", "committed_at", "operation", "manifest_list"
    )


# -- files -------------------------------------------------------------------------------------------------------------


@register("live_table_metrics")
def _(spark, sf_dir):
    return _live(spark, sf_dir)


@register("fleet_live_metrics")
def _(spark, sf_dir):
    return file_ops.live_table_metrics(rel.files(spark, sf_dir), rel.tables(spark, sf_dir))


@register("live_size_mb")
def _(spark, sf_dir):
    return file_ops.live_size_mb(_live(spark, sf_dir))


@register("live_file_share")
def _(spark, sf_dir):
    return file_ops.live_file_share(_live(spark, sf_dir))


@register("file_metrics")
def _(spark, sf_dir):
    return file_ops.file_metrics(rel.files(spark, sf_dir))


@register("live_display")
def _(spark, sf_dir):
    return file_ops.live_display(_live(spark, sf_dir))


@register("file_metrics_display")
def _(spark, sf_dir):
    return file_ops.file_metrics_display(file_ops.file_metrics(rel.files(spark, sf_dir)))


@register("file_type_comparison")
def _(spark, sf_dir):
    return file_ops.file_type_comparison(file_ops.file_metrics(rel.files(spark, sf_dir)))


@register("bytes_to_mb")
def _(spark, sf_dir):
    return rel.files(spark, sf_dir).select("file_path", bytes_to_mb("file_size_in_bytes").alias("size_mb"))


# -- partitions --------------------------------------------------------------------------------------------------------


@register("partition_metrics")
def _(spark, sf_dir):
    return _flat_partition(partition_ops.in_report_order(_metrics(spark, sf_dir)))


@register("partition_flatten")
def _(spark, sf_dir):
    return partition_ops.partition_flatten(_metrics(spark, sf_dir))


@register("partition_display")
def _(spark, sf_dir):
    return partition_ops.partition_display(_metrics(spark, sf_dir))


@register("partition_totals")
def _(spark, sf_dir):
    return partition_ops.partition_totals(_metrics(spark, sf_dir))


@register("partition_totals_display")
def _(spark, sf_dir):
    return partition_ops.partition_totals_display(partition_ops.partition_totals(_metrics(spark, sf_dir)))


@register("partition_size_describe")
def _(spark, sf_dir):
    described = partition_ops.partition_size_describe(_metrics(spark, sf_dir))
    return _rounded(described, mean=6, std=6, p25=6, p50=6, p75=6)


@register("partition_size_statistics")
def _(spark, sf_dir):
    return partition_ops.describe_rows(partition_ops.partition_size_describe(_metrics(spark, sf_dir)))


@register("partition_skew_sample")
def _(spark, sf_dir):
    return _rounded(partition_ops.partition_skew_sample(_metrics(spark, sf_dir)), skewness=9)


@register("partition_skew_population")
def _(spark, sf_dir):
    return _rounded(partition_ops.partition_skew_population(_metrics(spark, sf_dir)), skewness=9)


@register("partition_skew_class")
def _(spark, sf_dir):
    skew = partition_ops.partition_skew_sample(_metrics(spark, sf_dir))
    return _rounded(partition_ops.partition_skew_class(skew), skewness=9)


@register("skew_gauge_band")
def _(spark, sf_dir):
    skew = partition_ops.partition_skew_population(_metrics(spark, sf_dir))
    return _rounded(partition_ops.skew_gauge_band(skew), skewness=9)


@register("partition_distribution")
def _(spark, sf_dir):
    d = partition_ops.partition_distribution(partition_ops.partition_stats(rel.files(spark, sf_dir)))
    return _rounded(
        d,
        avg_record_count=6,
        deviation_record_count=6,
        skew_record_count=9,
        avg_file_count=6,
        deviation_file_count=6,
        skew_file_count=9,
    )


@register("partition_file_histogram")
def _(spark, sf_dir):
    return _rounded(partition_ops.partition_file_histogram(_metrics(spark, sf_dir)), bin_start=6, bin_end=6)


@register("partition_size_vs_files")
def _(spark, sf_dir):
    return partition_ops.partition_size_vs_files(_metrics(spark, sf_dir))


@register("top_partitions_by_size")
def _(spark, sf_dir):
    return partition_ops.top_partitions_by_size(_metrics(spark, sf_dir), 10)


# -- snapshots ---------------------------------------------------------------------------------------------------------


@register("snapshot_summary_metrics")
def _(spark, sf_dir):
    return _changes(spark, sf_dir)


@register("snapshot_iso_time")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_iso_time(rel.commits(spark, sf_dir))


@register("latest_snapshot_metrics")
def _(spark, sf_dir):
    return snapshot_ops.latest_snapshot_metrics(rel.tables(spark, sf_dir), rel.commits(spark, sf_dir))


@register("snapshot_metrics_by_id")
def _(spark, sf_dir):
    """Of a snapshot that one table has, and of one that none has."""
    tables, commits = rel.tables(spark, sf_dir), rel.commits(spark, sf_dir)
    wanted = [snapshot_ops.snapshot_metrics(tables, commits, i).withColumn("wanted", F.lit(i).cast("bigint")) for i in (7, -1)]
    return wanted[0].unionByName(wanted[1])


@register("historical_snapshots")
def _(spark, sf_dir):
    return snapshot_ops.history_in_order(_history(spark, sf_dir))


@register("snapshot_detail")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_detail(_history(spark, sf_dir))


@register("snapshot_option_text")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_options(rel.commits(spark, sf_dir))


@register("operation_class")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_operation_class(rel.commits(spark, sf_dir))


@register("snapshot_timeline")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_timeline(_history(spark, sf_dir))


@register("snapshot_trends")
def _(spark, sf_dir):
    history = snapshot_ops.history_in_order(_history(spark, sf_dir), newest_first=False)
    return snapshot_ops.snapshot_trends(history)


@register("snapshot_record_trend")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_record_trend(_history(spark, sf_dir))


@register("snapshot_change_breakdown")
def _(spark, sf_dir):
    return snapshot_ops.snapshot_change_breakdown(_changes(spark, sf_dir))


@register("snapshots_with_file_changes")
def _(spark, sf_dir):
    return snapshot_ops.snapshots_with_file_changes(_changes(spark, sf_dir))


def _expirable(spark: SparkSession, sf_dir: str, protect: bool = False) -> DataFrame:
    protected = snapshot_ops.protected_snapshots(rel.tables(spark, sf_dir)) if protect else None
    return snapshot_ops.expirable_snapshots(rel.commits(spark, sf_dir), AS_OF, 30, protected)


def _plain(expirable: DataFrame) -> DataFrame:
    return expirable.drop("summary").withColumn("timestamp", utc_text(utc_micros("timestamp")).cast("timestamp_ntz"))


@register("expirable_snapshots")
def _(spark, sf_dir):
    return _plain(_expirable(spark, sf_dir))


@register("expirable_unprotected_snapshots")
def _(spark, sf_dir):
    return _plain(_expirable(spark, sf_dir, protect=True))


@register("expirable_by_ancestry")
def _(spark, sf_dir):
    """Old snapshots that are not among the last of any branch."""
    chain = stored(rel.snapshots(spark, sf_dir).drop("committed_at"))
    found = snapshot_ops.expirable_by_ancestry(chain, rel.branched_tables(spark, sf_dir), AS_OF, 30)
    return found.select("table_name", "snapshot_id", "timestamp_ms", "manifest_list")


@register("short_table_name")
def _(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    full = F.concat(F.lit("lake."), F.lower("c_mktsegment"), F.lit("."), F.col("c_name"))
    return customers.select("c_custkey", short_table_name(full).alias("short_name"))


# -- orphans and composites --------------------------------------------------------------------------------------------


@register("orphan_files")
def _(spark, sf_dir):
    orphans = orphan_ops.orphan_files(rel.storage(spark, sf_dir), rel.all_entries(spark, sf_dir))
    return orphans.select("file_path", "file_size_in_bytes")


@register("format_bytes")
def _(spark, sf_dir):
    return rel.files(spark, sf_dir).select("file_path", format_bytes("file_size_in_bytes").alias("size_text"))


@register("health_partition_sizes")
def _(spark, sf_dir):
    return health_ops.partition_sizes(_metrics(spark, sf_dir))


@register("health_files_per_partition")
def _(spark, sf_dir):
    return health_ops.files_per_partition(_metrics(spark, sf_dir))


@register("health_summary")
def _(spark, sf_dir):
    summary = health_ops.health_summary(
        rel.tables(spark, sf_dir),
        _metrics(spark, sf_dir),
        orphan_ops.orphan_files(rel.storage(spark, sf_dir), rel.all_entries(spark, sf_dir)),
        _expirable(spark, sf_dir),
    )
    return _rounded(summary, average_partition_size_bytes=6, partition_skewness=9)


@register("table_metrics_report")
def _(spark, sf_dir):
    return table_report_row(rel.tables(spark, sf_dir), rel.commits(spark, sf_dir), rel.files(spark, sf_dir))
