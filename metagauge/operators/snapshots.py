"""Snapshot history: latest change, past snapshots, trends, and what may expire."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import (
    display_time,
    iso_time,
    megabytes,
    operation_class,
    operation_colour,
    snapshot_option_text,
    summary_metrics,
    title_words,
)
from ..plans.lineage import Kept
from ..plans.top import top_per_group
from ..schemas import (
    CHANGE_COLUMNS,
    CHANGE_KEYS,
    FILE_CHANGE_COLUMNS,
    RECORD_CHANGE_COLUMNS,
    TOTAL_KEYS,
)


def _newest_first(time: str = "committed_at") -> list[Column]:
    # The id settles equal commit times.
    return [F.desc(time), F.desc("snapshot_id")]


def snapshot_summary_metrics(snapshots: DataFrame, extra: Iterable[str] = (), strict: bool = True) -> DataFrame:
    """The change metrics of every snapshot, and ``extra`` summary keys."""
    return snapshots.select("table_name", "snapshot_id", "operation", *summary_metrics(extra, strict))


def summary_errors(snapshots: DataFrame) -> DataFrame:
    """Summary values that should be numbers and are not, as rows."""
    keys = F.array(*[F.lit(k) for k in (*CHANGE_KEYS, *TOTAL_KEYS)])
    entries = snapshots.select("table_name", "snapshot_id", F.explode("summary").alias("key", "value"))
    return entries.where(
        F.array_contains(keys, F.col("key")) & F.col("value").isNotNull() & F.col("value").try_cast("bigint").isNull()
    )


def snapshot_iso_time(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("table_name", "snapshot_id", iso_time("committed_at").alias("timestamp"))


def current_snapshot(tables: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every table with the snapshot it points to; a table without one keeps its row.

    The few snapshots that are current are picked first, so the outer join never sees the whole history.
    """
    wanted = tables.where("current_snapshot_id IS NOT NULL").select(
        "table_name", F.col("current_snapshot_id").alias("snapshot_id")
    )
    current = snapshots.join(wanted, ["table_name", "snapshot_id"])
    return tables.select("table_name", "current_snapshot_id").join(current, "table_name", "left")


def latest_snapshot_metrics(tables: DataFrame, snapshots: DataFrame, strict: bool = True) -> DataFrame:
    """Change metrics of the current snapshot; zeros and an empty operation for a table without one."""
    return (
        current_snapshot(tables, snapshots)
        .select("table_name", *summary_metrics(strict=strict), "operation")
        .na.fill("", ["operation"])
    )


def snapshot_metrics(
    tables: DataFrame, snapshots: DataFrame, snapshot_id: int, strict: bool = True
) -> DataFrame:
    """Change metrics of the snapshot with the given id; zeros and an empty operation for a table that has no such."""
    one = snapshots.where(F.col("snapshot_id") == F.lit(snapshot_id))
    return (
        tables.select("table_name")
        .join(one, "table_name", "left")
        .select("table_name", *summary_metrics(strict=strict), "operation")
        .na.fill("", ["operation"])
    )


def historical_snapshots(snapshots: DataFrame, limit: int = 10, strict: bool = True) -> DataFrame:
    """The newest ``limit`` snapshots of each table with change metrics and totals.

    Summaries are read after the cut, so only the kept snapshots pay for it.
    """
    newest = top_per_group(snapshots, "table_name", _newest_first(), limit)
    return newest.select(
        "table_name",
        "snapshot_id",
        F.col("committed_at").alias("timestamp"),
        "parent_id",
        "operation",
        *summary_metrics(TOTAL_KEYS, strict),
    )


def history_in_order(history: DataFrame, newest_first: bool = True) -> DataFrame:
    """A history in display order: newest first, or oldest first for trends."""
    if newest_first:
        return history.orderBy("table_name", *_newest_first("timestamp"))
    return history.orderBy("table_name", F.asc("timestamp"), F.asc("snapshot_id"))


def snapshot_detail(history: DataFrame, snapshot_id: int | None = None) -> DataFrame:
    """One snapshot with its time as text: the given one, else each table's newest."""
    if snapshot_id is None:
        picked = top_per_group(history, "table_name", _newest_first("timestamp"), 1)
    else:
        picked = history.where(F.col("snapshot_id") == F.lit(snapshot_id))
    return picked.select(
        "table_name",
        "snapshot_id",
        "parent_id",
        display_time("timestamp").alias("formatted_time"),
        "operation",
        *CHANGE_COLUMNS,
    )


def snapshot_options(snapshots: DataFrame) -> DataFrame:
    """The text under which each snapshot is offered for selection."""
    return snapshots.select(
        "table_name",
        "snapshot_id",
        snapshot_option_text("snapshot_id", "committed_at", "operation").alias("display_option"),
    )


def snapshot_operation_class(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(
        "table_name",
        "snapshot_id",
        "operation",
        operation_class().alias("operation_class"),
        operation_colour().alias("colour"),
    )


def snapshot_timeline(history: DataFrame) -> DataFrame:
    """Marks of a history, each linked to the next older one.

    ``history`` is already cut to a number of snapshots per table, which bounds the window.
    """
    older = Window.partitionBy("table_name").orderBy(*_newest_first("timestamp"))
    return history.select(
        "table_name",
        "snapshot_id",
        "timestamp",
        display_time("timestamp").alias("formatted_time"),
        "operation",
        operation_class().alias("operation_class"),
        operation_colour().alias("colour"),
        "added_data_files",
        "deleted_data_files",
        "added_records",
        "deleted_records",
        F.lead("timestamp").over(older).alias("linked_timestamp"),
    )


def snapshot_trends(history: DataFrame) -> DataFrame:
    """Totals of each snapshot, sizes in MB."""
    return history.select(
        "table_name",
        "timestamp",
        "snapshot_id",
        "operation",
        "total_data_files",
        "total_delete_files",
        megabytes("total_files_size").alias("total_files_size_mb"),
    )


def snapshot_record_trend(history: DataFrame) -> DataFrame:
    """Added and deleted records as one row per snapshot and kind."""
    rows = history.unpivot(
        ["table_name", "timestamp", "snapshot_id", "operation"], list(RECORD_CHANGE_COLUMNS), "metric_type", "count"
    )
    return rows.withColumn("metric_type", title_words("metric_type"))


def snapshot_change_breakdown(metrics: DataFrame) -> DataFrame:
    """File and record changes as (name, value) rows."""
    ids = [c for c in ("table_name", "snapshot_id") if c in metrics.columns]
    rows = metrics.unpivot(ids, [*FILE_CHANGE_COLUMNS, *RECORD_CHANGE_COLUMNS], "change", "value")
    return rows.withColumn("change", title_words("change"))


def snapshots_with_file_changes(metrics: DataFrame) -> DataFrame:
    """Snapshots that changed some file."""
    changed = None
    for name in FILE_CHANGE_COLUMNS:
        test = F.col(name) != 0
        changed = test if changed is None else changed | test
    return metrics.where(changed)


def expirable_snapshots(
    snapshots: DataFrame,
    as_of: dt.datetime | int,
    days: int = 30,
    protected: DataFrame | None = None,
) -> DataFrame:
    """Snapshots committed strictly more than ``days`` before ``as_of`` (a UTC time, or epoch milliseconds).

    ``protected`` names snapshots to keep, as (table_name, snapshot_id): those a table or one of its refs points to.
    This only reports; nothing is removed.
    """
    if isinstance(as_of, dt.datetime):
        moment = as_of if as_of.tzinfo else as_of.replace(tzinfo=dt.timezone.utc)
        as_of = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(milliseconds=1)
    cutoff = as_of - days * 24 * 60 * 60 * 1000
    old = snapshots.where(F.col("timestamp_ms") < F.lit(cutoff))
    if protected is not None:
        old = old.join(protected, ["table_name", "snapshot_id"], "left_anti")
    return old.select(
        "table_name",
        "snapshot_id",
        "timestamp_ms",
        F.timestamp_millis("timestamp_ms").alias("timestamp"),
        "manifest_list",
        "summary",
    )


def protected_snapshots(tables: DataFrame) -> DataFrame:
    """Snapshots that a table or one of its branches and tags points to."""
    current = tables.select("table_name", F.col("current_snapshot_id").alias("snapshot_id"))
    if "ref_snapshot_ids" in tables.columns:
        refs = tables.select("table_name", F.explode("ref_snapshot_ids").alias("snapshot_id"))
        current = current.unionByName(refs)
    return current.where("snapshot_id IS NOT NULL").distinct()


def branch_heads(tables: DataFrame, keep: int = 1) -> DataFrame:
    """``table_name, snapshot_id, keep`` of every branch: how many snapshots of its line stay, ``keep`` where it doesn't say."""
    each = tables.select("table_name", F.explode("branches").alias("b"))
    kept = F.greatest(F.coalesce("b.keep", F.lit(keep)), F.lit(1)).cast("int")
    return each.select("table_name", "b.snapshot_id", kept.alias("keep")).where("snapshot_id IS NOT NULL")


def ancestors_within(snapshots: DataFrame, heads: DataFrame, kept: Kept | None = None) -> DataFrame:
    """``table_name, snapshot_id`` of the first ``keep`` snapshots on the way from each head to its ancestors, itself included.

    Every snapshot points to its parent, then to its second, fourth, eighth ancestor: with each doubling the lines known reach
    twice as far, so a line of any length takes as many rounds as its logarithm. Of lines that meet, the one that reaches
    further counts. A parent that is not there ends its line. Rounds are stored, as each is read twice.
    """
    kept = kept or Kept()
    own = ["table_name", "snapshot_id"]
    longest = heads.agg(F.max("keep")).first()[0] or 0
    links = snapshots.select(*own, "parent_id").where("parent_id IS NOT NULL").distinct()
    # How many more snapshots of the line from here stay, this one included.
    reached = heads.groupBy(*own).agg(F.max("keep").alias("left"))
    step = 1
    while step < longest:
        links = kept.stored(links)
        if links.isEmpty():
            break
        further = reached.join(links, own).select("table_name", F.col("parent_id").alias("snapshot_id"), F.col("left") - step)
        further = further.toDF(*own, "left").where("left > 0")
        reached = kept.stored(reached.unionByName(further).groupBy(*own).agg(F.max("left").alias("left")))
        ahead = links.select("table_name", F.col("snapshot_id").alias("parent_id"), F.col("parent_id").alias("next"))
        links = links.join(ahead, ["table_name", "parent_id"]).select(*own, F.col("next").alias("parent_id"))
        step *= 2
    return reached.join(snapshots.select(*own).distinct(), own, "left_semi").select(*own)


def expirable_by_ancestry(
    snapshots: DataFrame,
    tables: DataFrame,
    as_of: dt.datetime | int,
    days: int = 30,
    keep: int = 1,
    kept: Kept | None = None,
) -> DataFrame:
    """Snapshots old enough to go that no branch or tag holds: of each branch the newest ``keep`` of its line stay (or as many
    as the branch says), whatever their age, and so does what a tag names. See :func:`expirable_snapshots`."""
    held = ancestors_within(snapshots, branch_heads(tables, keep), kept).unionByName(protected_snapshots(tables))
    return expirable_snapshots(snapshots, as_of, days, held.distinct())
