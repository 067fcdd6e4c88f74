"""Metadata relations that Spark derives from the lineitem, orders and customer tables.

A line of an order stands for a manifest entry, an order for a snapshot. ``SQL`` in :mod:`workload.oracles` states the
same relations for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metagauge.functions import utc_micros
from metagauge.plans.lineage import stored
from metagauge.plans.running import running_totals
from metagauge.schemas import CHANGE_COLUMNS, CHANGE_KEYS, STATUS_DELETED, TOTAL_COLUMNS, TOTAL_KEYS

TABLES = 20
AS_OF = "2001-08-01 00:00:00"

# Snapshot ids of one day are cut into slices of this many ids, which bounds a running total's window.
_ID_SLICE = 1 << 20
# Months that the bits of one number stand for.
_MASK = 64
# Bytes and rows of a file that one task groups. Rows of a file that repeats its values take few bytes.
_PART_BYTES = 8 << 20
_PART_ROWS = 400_000
# For up to so many tasks Spark writes a shuffle row by row, for more it sorts what a scan's split sends in memory. Before there
# are more, a task groups up to the most rows.
_FEW_PARTS = 200
_MOST_ROWS = 2_000_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many tasks group the rows of a file: as its size and its rows say, and enough to use all cores."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    # Tasks read the rows' number from the footers.
    rows = _read(spark, sf_dir, name).count()
    wanted = max(-(-size // _PART_BYTES), -(-rows // _PART_ROWS))
    if wanted > _FEW_PARTS:
        wanted = max(_FEW_PARTS, -(-rows // _MOST_ROWS))
    return max(spark.sparkContext.defaultParallelism, wanted)


def _table(key: str) -> Column:
    return F.concat(F.lit("t"), (F.col(key) % TABLES).cast("string"))


def _cents() -> Column:
    # Prices have two decimals: nothing lies halfway, so the cheap rounding is the right one.
    return F.sum(F.rint(F.col("l_extendedprice") * 100).cast("bigint"))


def _month(date: str) -> Column:
    return F.year(date) * 100 + F.month(date)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest entries: one per order key and line number, partitioned by line status and ship month."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        # A line status is one character. The smallest number aggregates by hash, the smallest text by sorting.
        F.char(F.min(F.ascii("l_linestatus"))).alias("part_status"),
        F.min(_month("l_shipdate")).cast("int").alias("part_month"),
        F.sum("l_quantity").cast("bigint").alias("record_count"),
        _cents().alias("file_size_in_bytes"),
    )
    late = (F.col("part_month") >= 200110) | (F.col("l_linenumber") == 6)
    return lines.select(
        F.concat(
            F.lit("data/"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber"), F.lit(".parquet")
        ).alias("file_path"),
        _table("l_orderkey").alias("table_name"),
        F.when(late, 1).when(F.col("l_linenumber") == 7, 2).otherwise(0).alias("content"),
        F.when(F.col("l_orderkey") % 17 == 0, STATUS_DELETED).otherwise(1).alias("status"),
        F.col("l_orderkey").alias("snapshot_id"),
        F.lit(0).alias("spec_id"),
        F.struct("part_status", "part_month").alias("partition"),
        "record_count",
        "file_size_in_bytes",
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).where(F.col("status") != STATUS_DELETED)


def order_changes(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """What each order changes, grouped by ``parts`` tasks.

    Its months are bits of two numbers, so that a row holds 128 of them, from 1970 on. Rows of later and earlier months are
    added up in a last step. Lines are dealt out to as many tasks as their file's size and rows ask for, and so are the rows
    that these tasks combine: what one task holds is bounded, whatever the tables, a file's layout or a session's number of
    shuffle partitions.
    """
    parts = parts or _parts(spark, sf_dir, "lineitem")
    line, flag, quantity = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity")
    lines = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        "l_quantity",
        "l_extendedprice",
        ((F.year("l_shipdate") - 1970) * 12 + F.month("l_shipdate") - 1).alias("month"),
    )
    # By all columns: neither an order nor a line number of it, however frequent, meets in one task.
    deal = F.pmod(F.xxhash64(*lines.columns), F.lit(parts)).alias("deal")
    lines = lines.select("*", deal).repartition(parts, "l_orderkey", "deal")
    bit = F.expr(f"shiftleft(1L, pmod(month, {_MASK}))")
    late = F.pmod(F.col("month"), F.lit(2 * _MASK)) >= _MASK
    dealt = lines.groupBy("l_orderkey", "deal", F.floor(F.col("month") / (2 * _MASK)).alias("span")).agg(
        F.count_if(line <= 5).alias("added_data_files"),
        F.count_if(flag == "R").alias("deleted_data_files"),
        F.count_if(line >= 6).alias("added_delete_files"),
        F.count_if((line >= 6) & (flag == "A")).alias("removed_delete_files"),
        F.sum(quantity).alias("added_records"),
        F.sum(F.when(flag == "R", quantity)).alias("deleted_records"),
        _cents().alias("bytes"),
        F.bit_or(F.when(late, 0).otherwise(bit)).alias("first_months"),
        F.bit_or(F.when(late, bit).otherwise(0)).alias("last_months"),
    )
    masks = ("first_months", "last_months")
    sums = [c for c in dealt.columns if c not in ("l_orderkey", "deal", "span", *masks)]
    # An order has a row per deal and span at most. Both steps that follow find their rows in the task.
    spans = dealt.repartition(parts, "l_orderkey").groupBy("l_orderkey", "span").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.bit_or(c).alias(c) for c in masks]
    )
    # Lines without a date are a partition too.
    months = F.when(F.col("span").isNull(), 1).otherwise(F.bit_count("first_months") + F.bit_count("last_months"))
    # Quantities are cut to whole numbers once all are added up.
    return spans.groupBy("l_orderkey").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in sums], F.sum(months).alias("changed_partition_count")
    )


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "append")
        .when(F.col("o_orderpriority") == "2-HIGH", "overwrite")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "replace")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "delete")
        .otherwise("rewrite")
    )
    parts = _parts(spark, sf_dir, "lineitem")
    changes = order_changes(spark, sf_dir, parts)
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    # Both sides grow alike, so neither is broadcast; the changes are already partitioned by the key, into as many tasks.
    orders = orders.repartition(parts, "o_orderkey")
    joined = orders.join(changes.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # After the join, whose sort then holds the short columns.
    return joined.select(
        _table("o_custkey").alias("table_name"),
        F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("committed_at"),
        F.floor(utc_micros("o_orderdate") / 1000).alias("timestamp_ms"),
        operation.alias("operation"),
        F.concat(F.lit("metadata/snap-"), F.col("o_orderkey"), F.lit(".avro")).alias("manifest_list"),
        *[c for c in changes.columns if c != "l_orderkey"],
    )


def _summary(keys: tuple[str, ...], columns: tuple[str, ...]) -> Column:
    """The metrics as a snapshot summary: text values, and no key for a missing one."""
    pairs = []
    for key, column in zip(keys, columns):
        pairs += [F.lit(key), F.col(column).cast("string")]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("summary")


SNAPSHOT_COLUMNS = ("table_name", "snapshot_id", "committed_at", "timestamp_ms", "operation", "manifest_list")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots whose summaries tell their changes only."""
    return _commits(spark, sf_dir).select(*SNAPSHOT_COLUMNS, _summary(CHANGE_KEYS, CHANGE_COLUMNS))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with parents, and with running totals in their summaries."""
    rows = stored(_commits(spark, sf_dir)).withColumns(
        {
            "id_slice": F.floor(F.col("snapshot_id") / _ID_SLICE),
            "known": F.col("bytes").isNotNull().cast("bigint"),
            "data": F.coalesce("added_data_files", F.lit(0)),
            "deletes": F.coalesce("added_delete_files", F.lit(0)),
            "size": F.coalesce(F.col("bytes") * 100, F.lit(0)),
        }
    )
    running = running_totals(
        rows,
        ["table_name"],
        ["committed_at", "id_slice"],
        "snapshot_id",
        {"known": "known_upto", "data": "all_data", "deletes": "all_deletes", "size": "all_size"},
        {"snapshot_id": "parent_id"},
    )
    # Unknown until some snapshot of the table has metrics.
    totals = {
        name: F.when(F.col("known_upto") > 0, F.col(source))
        for name, source in zip(TOTAL_COLUMNS, ("all_data", "all_deletes", "all_size"))
    }
    return running.withColumns(totals).select(
        *SNAPSHOT_COLUMNS,
        "parent_id",
        _summary(CHANGE_KEYS + TOTAL_KEYS, CHANGE_COLUMNS + TOTAL_COLUMNS),
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current snapshot per table, and one table without any."""
    orders = _read(spark, sf_dir, "orders")
    # First the last id of each day, which aggregates by hash, then the last day.
    days = orders.groupBy(_table("o_custkey").alias("table_name"), "o_orderdate").agg(
        F.max("o_orderkey").alias("snapshot_id")
    )
    current = days.groupBy("table_name").agg(F.max_by("snapshot_id", "o_orderdate").alias("current_snapshot_id"))
    empty = spark.range(1).select(F.lit("t_empty"), F.lit(None).cast("bigint"))
    return current.union(empty)


def branched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with branches: the current snapshot ends one that keeps twenty, each five hundredth order one that keeps five."""
    branch = lambda name, keep: F.struct(
        name.alias("name"), F.col("snapshot_id"), F.lit(keep).alias("keep")
    )
    ids = _read(spark, sf_dir, "orders").select(_table("o_custkey").alias("table_name"), F.col("o_orderkey").alias("snapshot_id"))
    others = ids.where("snapshot_id % 500 = 0").select("table_name", branch(F.col("snapshot_id").cast("string"), 5).alias("b"))
    current = tables(spark, sf_dir).withColumn("snapshot_id", F.col("current_snapshot_id"))
    main = current.select("table_name", branch(F.lit("main"), 20).alias("b"))
    branches = main.unionByName(others).groupBy("table_name").agg(F.collect_list("b").alias("branches"))
    return tables(spark, sf_dir).join(branches, "table_name", "left")


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing: every entry's file, and a stray one per customer."""
    strays = _read(spark, sf_dir, "customer")
    return (
        entries(spark, sf_dir)
        .select("table_name", "file_path", "file_size_in_bytes")
        .union(
            strays.select(
                _table("c_custkey"),
                F.concat(F.lit("data/stray-"), F.col("c_custkey"), F.lit(".parquet")),
                F.col("c_custkey").cast("bigint"),
            )
        )
    )


def all_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all snapshots that still exist: those of the first two months have expired, and left their files."""
    return entries(spark, sf_dir).where(F.col("partition.part_month") >= 199503)


# -- documents and manifest records ------------------------------------------------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata documents: one version of a table per order, with that order's snapshot.

    Those of orders without lines are cut off in the middle.
    """
    c = commits(spark, sf_dir)
    database = F.concat(F.lit("db"), (F.substring("table_name", 2, 9).cast("int") % 4).cast("string"))
    location = F.concat(F.lit("/lake/"), database, F.lit("/"), F.col("table_name"))
    field = F.struct(
        F.lit("part_month").alias("name"), F.lit("month").alias("transform"), F.lit(2).alias("source-id")
    )
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(t).alias("type"))
            for i, n, t in ((1, "id", "long"), (2, "shipped", "date"))
        ]
    )
    snapshot = F.struct(
        F.col("snapshot_id").alias("snapshot-id"),
        F.col("timestamp_ms").alias("timestamp-ms"),
        F.col("manifest_list").alias("manifest-list"),
        F.map_concat(F.create_map(F.lit("operation"), F.col("operation")), F.col("summary")).alias("summary"),
    )
    document = F.to_json(
        F.struct(
            F.lit(2).alias("format-version"),
            F.concat(F.lit("uuid-"), F.col("table_name")).alias("table-uuid"),
            location.alias("location"),
            F.col("snapshot_id").alias("current-snapshot-id"),
            F.lit(0).alias("current-schema-id"),
            F.lit(0).alias("default-spec-id"),
            F.array(F.struct(F.lit(0).alias("schema-id"), columns.alias("fields"))).alias("schemas"),
            F.array(F.struct(F.lit(0).alias("spec-id"), F.array(field).alias("fields"))).alias("partition-specs"),
            F.create_map(F.lit("owner"), F.col("operation")).alias("properties"),
            F.array(snapshot).alias("snapshots"),
        )
    )
    cut_off = F.expr("substring(document, 1, length(document) div 2)")
    return c.select(
        F.concat(location, F.lit("/metadata/v"), F.col("snapshot_id"), F.lit(".metadata.json")).alias(
            "metadata_location"
        ),
        document.alias("document"),
        (F.size("summary") == 0).alias("broken"),
    ).select("metadata_location", F.when(F.col("broken"), cut_off).otherwise(F.col("document")).alias("document"))


def metadata_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the documents alone, as a listing gives them."""
    return documents(spark, sf_dir).select("metadata_location")


def manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as the JSON text that a manifest scan yields, one manifest per table; months count from 1970.

    Entries of delete files leave out the snapshot id, those of data files the content.
    """
    month = (F.col("partition.part_month").cast("int") - 197000)
    since_1970 = F.floor(month / 100) * 12 + month % 100 - 1
    record = F.to_json(
        F.struct(
            "status",
            F.when(F.col("content") == 0, F.col("snapshot_id")).alias("snapshot_id"),
            F.struct(
                F.when(F.col("content") != 0, F.col("content")).alias("content"),
                "file_path",
                F.lit("PARQUET").alias("file_format"),
                F.struct(
                    F.col("partition.part_status").alias("part_status"), since_1970.cast("int").alias("part_month")
                ).alias("partition"),
                "record_count",
                "file_size_in_bytes",
            ).alias("data_file"),
        )
    )
    source = F.concat(F.lit("file:///lake/"), F.col("table_name"), F.lit("/metadata/m-"), F.col("table_name"), F.lit(".avro"))
    return entries(spark, sf_dir).select(source.alias("manifest_path"), record.alias("record"))


def owned_records(spark: SparkSession, sf_dir: str, manifests: DataFrame) -> DataFrame:
    """Records with the owners of their manifests, as a scan gives them."""
    owners = manifests.groupBy("manifest_path").agg(
        F.collect_list(F.struct("table_name", "spec_id", "added_snapshot_id", "kinds")).alias("tables")
    )
    joined = manifest_records(spark, sf_dir).join(owners, "manifest_path")
    owner = F.struct(F.col("manifest_path").alias("path"), "tables").alias("owner")
    return joined.select(owner, "record", F.lit(None).cast("string").alias("error"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per table, added by the table's current snapshot."""
    kinds = F.create_map(F.lit("part_status"), F.lit("string"), F.lit("part_month"), F.lit("month"))
    lake = F.concat(F.lit("file:///lake/"), F.col("table_name"))
    return (
        tables(spark, sf_dir)
        .where("current_snapshot_id IS NOT NULL")
        .select(
            "table_name",
            F.concat(lake, F.lit("/metadata/m-"), F.col("table_name"), F.lit(".avro")).alias("manifest_path"),
            F.lit(0).alias("spec_id"),
            F.col("current_snapshot_id").alias("added_snapshot_id"),
            kinds.alias("kinds"),
        )
    )
