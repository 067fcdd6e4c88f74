"""The full report of one table or a fleet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.files import file_metrics, live_table_metrics
from ..operators.partitions import in_report_order, partition_metrics, partition_stats
from ..operators.snapshots import historical_snapshots, history_in_order, latest_snapshot_metrics
from .file_stats import file_stats
from .lineage import Kept


@dataclass
class TableReport:
    """Lazy parts of the report. ``stats`` is persisted on first use; call :meth:`release` when done."""

    live_table_metrics: DataFrame
    snapshot_metrics: DataFrame
    partition_metrics: DataFrame
    file_metrics: DataFrame
    historical_snapshots: DataFrame
    stats: DataFrame

    def release(self) -> None:
        self.stats.unpersist()


def table_report(
    tables: DataFrame,
    snapshots: DataFrame,
    files: DataFrame,
    history: int = 20,
    strict: bool = True,
    all_tables: DataFrame | None = None,
) -> TableReport:
    """All five parts. The manifest entries are read once, for the shared aggregate; every file figure rolls up from it.

    ``tables`` are those whose files are known, ``all_tables`` those whose snapshots are; by default the same.
    """
    stats = file_stats(files).persist()
    return TableReport(
        live_table_metrics=live_table_metrics(stats, tables),
        snapshot_metrics=latest_snapshot_metrics(tables if all_tables is None else all_tables, snapshots, strict),
        partition_metrics=in_report_order(partition_metrics(partition_stats(stats))),
        file_metrics=file_metrics(stats),
        historical_snapshots=history_in_order(historical_snapshots(snapshots, history, strict)),
        stats=stats,
    )


def table_report_row(
    tables: DataFrame,
    snapshots: DataFrame,
    files: DataFrame,
    history: int = 20,
    strict: bool = True,
    kept: Kept | None = None,
) -> DataFrame:
    """One flat row per table: live metrics, latest change, and the sizes of the report's lists.

    The aggregate is cached, when the row is first asked for, as three roll-ups read it: each needs other columns of it, so
    Spark would not share its shuffle between them and derive the files three times. ``kept`` takes it over and can release
    it; without, it stays until the session ends.
    """
    stats = (kept or Kept()).cached(file_stats(files))
    live = live_table_metrics(stats)
    lists = (
        partition_metrics(partition_stats(stats))
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("partition_count"))
    )
    types = stats.groupBy("table_name").agg(F.count_distinct("content").alias("file_type_count"))
    kept = snapshots.groupBy("table_name").agg(
        F.least(F.count(F.lit(1)), F.lit(history)).alias("history_length")
    )
    return (
        latest_snapshot_metrics(tables, snapshots, strict)
        .join(live.withColumnRenamed("record_count", "live_record_count"), "table_name", "left")
        .join(lists, "table_name", "left")
        .join(types, "table_name", "left")
        .join(kept, "table_name", "left")
        .na.fill(0)
    )
