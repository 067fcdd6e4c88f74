"""Tables by name: a warehouse folder, or the catalogs of the session."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..jvm import map_partitions
from . import storage
from .metadata import database_of, metadata_files, parse_tables, read_tables, table_name_of


def split_name(name: str, database: str = "default") -> tuple[str, str]:
    """(database, table) of ``table``, ``database.table`` or ``catalog.database.table``."""
    parts = name.split(".")
    return (parts[-2], parts[-1]) if len(parts) > 1 else (database, name)


def list_metadata(spark: SparkSession, warehouse: str, database: str = "*", table: str = "*") -> DataFrame:
    """Paths of metadata files under ``warehouse/database/table/metadata``; contents are not read."""
    return metadata_at(spark, f"{warehouse.rstrip('/')}/{database}/{table}/metadata")


def metadata_at(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths of the metadata files that a path or glob names, or that lie in the folders it names.

    Tasks list folders, one level of the pattern after the other, so the driver holds no index of files. A path without a
    wildcard that names a document is taken at its word.
    """
    parts = [_paths(spark, p) for p in spark._jvm.org.apache.hadoop.fs.GlobExpander.expand(pattern)]
    return reduce(DataFrame.union, parts).distinct()


_DOCUMENT = r"\.metadata\.json(\.gz)?$"


def _paths(spark: SparkSession, pattern: str) -> DataFrame:
    parts = pattern.rstrip("/").split("/")
    wild = [i for i, part in enumerate(parts) if re.search(r"[*?\[\]{}\\]", part)]
    last = len(parts) - 1
    if not wild and re.search(_DOCUMENT, parts[last]):
        return spark.range(1).select(F.lit(pattern).alias("metadata_location"))
    start = wild[0] if wild else last + 1
    at = spark.range(1).select(F.lit("").alias("table_name"), F.lit("/".join(parts[:start]) or "/").alias("folder"))
    tasks = spark.sparkContext.defaultParallelism

    def listed(folders: DataFrame) -> DataFrame:
        return map_partitions(folders.repartition(tasks, "folder"), "FolderPages", storage.LEVEL_SCHEMA)

    files = listed(at).where("NOT is_folder") if not wild else None
    for i in range(start, last + 1):
        if i != last and i not in wild:  # only lists what it must
            at = at.select("table_name", F.concat("folder", F.lit(f"/{parts[i]}")).alias("folder"))
            continue
        regex = spark._jvm.org.apache.hadoop.fs.GlobPattern(parts[i]).compiled().pattern()
        name = F.regexp_extract("file_path", "[^/]*$", 0)
        matched = listed(at).where(name.rlike(f"^(?:{regex})$"))
        at = matched.where("is_folder").select("table_name", F.col("file_path").alias("folder"))
        if i == last:
            files = matched.where("NOT is_folder").unionByName(listed(at).where("NOT is_folder"))
    found = files.select(F.col("file_path").alias("metadata_location"))
    return found.where(F.col("metadata_location").rlike(_DOCUMENT))


def newest_metadata(paths: DataFrame) -> DataFrame:
    """The highest version per table, which is the folder above the file's. Versions are the number at the start of the
    file name (``v3.``, ``00003-``)."""
    name = F.element_at(F.split("metadata_location", "/"), -1)
    version = F.coalesce(F.regexp_extract(name, r"^v?(\d+)", 1).try_cast("bigint"), F.lit(-1))
    return (
        paths.select(
            database_of("metadata_location").alias("database"),
            table_name_of("metadata_location").alias("name"),
            F.regexp_extract("metadata_location", r"^(.*)/[^/]*/[^/]*$", 1).alias("__folder"),
            version.alias("version"),
            "metadata_location",
        )
        .groupBy("__folder", "database", "name")
        .agg(F.max(F.struct("version", "metadata_location")).alias("newest"))
        .select("database", "name", F.col("newest.version"), F.col("newest.metadata_location"))
    )


def newest_in(spark: SparkSession, warehouse: str, database: str = "*", table: str = "*") -> DataFrame:
    """``table_name, metadata_location`` of the newest document of each matching table, named ``database.table``."""
    newest = newest_metadata(list_metadata(spark, warehouse, database, table))
    return newest.select(F.concat_ws(".", "database", "name").alias("table_name"), "metadata_location")


def warehouse_documents(spark: SparkSession, warehouse: str, database: str = "*", table: str = "*") -> DataFrame:
    """Newest document of each matching table, without its snapshots; older versions are never opened."""
    read = read_tables(newest_in(spark, warehouse, database, table), strict=False).where("kind <> 'snapshot'")
    text = F.when(F.col("kind") == "table", F.col("text")).otherwise(F.lit(""))
    return read.select("metadata_location", text.alias("document"))


def newest_at(spark: SparkSession, pattern: str) -> DataFrame:
    """``table_name, metadata_location`` of the newest document of each table among the files a path or glob names.

    A table is named after its folder; tables of one name are ``database.table``, or else told apart by their whole folder.
    """
    newest = newest_metadata(metadata_at(spark, pattern)).withColumns(
        {
            "qualified": F.concat_ws(".", "database", "name"),
            "folder": F.regexp_extract("metadata_location", r"^(.*)/[^/]*/[^/]*$", 1),
        }
    )
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    named = newest.withColumns({"one": alone("name"), "one_qualified": alone("qualified")})
    name = F.when(F.col("one"), F.col("name")).when(F.col("one_qualified"), F.col("qualified")).otherwise(F.col("folder"))
    return named.select(name.alias("table_name"), "metadata_location")


INVENTORY_SCHEMA = (
    "database STRING, name STRING, location STRING, properties MAP<STRING, STRING>, "
    "partition_keys ARRAY<STRING>, schema MAP<STRING, STRING>"
)


def session_inventory(spark: SparkSession, database: str, calls: int = 16) -> DataFrame:
    """The same inventory for the tables of a database that the session's catalog knows.

    The catalog answers for one table at a time; ``calls`` of these questions are under way at once.
    """

    def describe(t) -> tuple:
        name = ".".join(f"`{part}`" for part in [*([t.catalog] if t.catalog else []), *t.namespace, t.name])
        # One description holds columns, location and partition fields.
        described = [(r.col_name, r.data_type) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()]
        heads = [i for i, (c, _) in enumerate(described) if not c or c.startswith("#")] or [len(described)]
        parts = [i for i, (c, _) in enumerate(described) if c == "# col_name"]
        keys = []
        for c, _ in described[parts[0] + 1 :] if parts else []:
            if not c or c.startswith("#"):
                break
            keys.append(c)
        properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        location = dict(described[heads[0] :]).get("Location")
        return t.namespace[-1], t.name, location, properties, keys, dict(described[: heads[0]])

    named = [t for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW"]
    with ThreadPoolExecutor(calls) as pool:
        rows = list(pool.map(describe, named))
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)


def list_databases(inventory: DataFrame) -> DataFrame:
    return inventory.select("database").distinct()


def list_tables(inventory: DataFrame, database: str) -> DataFrame:
    return inventory.where(F.col("database") == database).select("database", "name")


def table_location(inventory: DataFrame, database: str, table: str) -> DataFrame:
    return inventory.where((F.col("database") == database) & (F.col("name") == table)).select("location")


def table_properties(inventory: DataFrame, database: str, table: str) -> DataFrame:
    return inventory.where((F.col("database") == database) & (F.col("name") == table)).select("properties")


def _described_location(spark: SparkSession, name: str) -> str | None:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return described.data_type if described else None


def session_relations(
    spark: SparkSession,
    name: str,
    read: Callable[[str], DataFrame] | None = None,
    location: str | None = None,
    open_document: bool = True,
) -> dict[str, DataFrame]:
    """The relations of a table in an Iceberg catalog of the session, from its metadata tables.

    ``referenced`` is everything that the table reaches: data and delete files of all snapshots, their manifests and manifest
    lists, the documents in its log, and what the newest document itself names (statistics). That document is the one file
    that is opened; without ``open_document`` none is, and statistics files are not known. ``location`` is the catalog's
    unless given, or else the folder above that of the newest document.
    """
    if read is None:
        location = location or _described_location(spark, name)
        read = lambda part: spark.table(f"{name}.{part}")
    text = ".".join(name.split(".")[-2:])
    label = F.lit(text).alias("table_name")
    snapshots = read("snapshots").select(
        label,
        "snapshot_id",
        "parent_id",
        "committed_at",
        F.unix_millis("committed_at").alias("timestamp_ms"),
        "operation",
        "manifest_list",
        "summary",
    )

    def files(part: str) -> DataFrame:
        df = read(part)
        partition = F.col("partition") if "partition" in df.columns else F.lit("<unpartitioned>").alias("partition")
        return df.select(
            label, "content", "file_path", "file_format", "spec_id", partition, "record_count", "file_size_in_bytes"
        )

    log = read("metadata_log_entries")
    newest = log.agg(F.max_by("file", "timestamp").alias("metadata_location"))
    # The folder of the documents lies in that of the table.
    above = F.regexp_extract("metadata_location", r"^(.*)/[^/]*/[^/]*$", 1)
    at = F.lit(location) if location else above
    # One row in any case, also for a table without snapshots. A table has a handful of branches and tags.
    named = read("refs")
    kind = F.lower("type") if "type" in named.columns else F.lit("branch")
    keep = F.col("min_snapshots_to_keep") if "min_snapshots_to_keep" in named.columns else F.lit(None)
    branch = F.struct("name", "snapshot_id", keep.cast("int").alias("keep"))
    refs = named.agg(
        F.max(F.when(F.col("name") == "main", F.col("snapshot_id"))).alias("current_snapshot_id"),
        F.collect_list("snapshot_id").alias("ref_snapshot_ids"),
        F.collect_list(F.when(kind == "branch", branch)).alias("branches"),
    )
    one = F.lit(1)
    tables = refs.withColumn("__one", one).join(newest.withColumn("__one", one), "__one")
    reached = [
        files("all_files").select("file_path"),
        read("all_manifests").select(F.col("path").alias("file_path")),
        snapshots.select(F.col("manifest_list").alias("file_path")),
        log.select(F.col("file").alias("file_path")),
    ]
    document = newest.first().metadata_location if open_document else None
    if document:
        file = spark.createDataFrame([(text, document)], "table_name STRING, metadata_location STRING")
        reached.append(metadata_files(parse_tables(read_tables(file))).select("file_path"))
    paths = reduce(DataFrame.union, reached).where("file_path IS NOT NULL")
    return {
        "tables": tables.select(
            label, "metadata_location", at.alias("location"), "current_snapshot_id", "ref_snapshot_ids", "branches"
        ),
        "snapshots": snapshots,
        "files": files("files"),
        "referenced": paths.select(label, "file_path"),
    }
