"""What lies in a table's location."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..jvm import map_partitions
from ..plans.lineage import Kept

LEVEL_SCHEMA = "table_name STRING, file_path STRING, is_folder BOOLEAN, length BIGINT, modified TIMESTAMP"


def storage_listing(
    spark: SparkSession, location: str, table_name: str | None = None, kept: Kept | None = None
) -> DataFrame:
    """All files below ``location`` with length and modification time."""
    start = spark.range(1).select(_name(table_name), F.lit(location).alias("location"))
    return fleet_listing(start, kept)


def fleet_listing(locations: DataFrame, kept: Kept | None = None) -> DataFrame:
    """All files below the locations of ``table_name, location`` rows, each with its table.

    Folders are listed by tasks, one level of all trees per job, and each level is stored, so the driver never holds the
    listing. A task goes through a folder page by page, as its file system hands it out under the session's Hadoop settings,
    and passes rows on as they come: a folder with any number of files needs the memory of a page. One folder is one task's.
    Empty files and names starting with ``_`` or ``.`` are included, which a Spark file scan leaves out; failed writes often
    leave just those. A location that is not there, or is a file, has no files. Any DataFrame with these columns, say a storage
    inventory, can stand in for this.
    """
    kept = kept or Kept()
    tasks = locations.sparkSession.sparkContext.defaultParallelism
    at = locations.where("location IS NOT NULL")
    folders = at.select("table_name", F.rtrim(F.col("location"), F.lit("/")).alias("folder"))
    files = None
    while True:
        level = kept.stored(map_partitions(folders.repartition(tasks, "folder"), "FolderPages", LEVEL_SCHEMA))
        found = level.where("NOT is_folder").drop("is_folder")
        files = found if files is None else files.unionByName(found)
        folders = level.where("is_folder").select("table_name", F.col("file_path").alias("folder"))
        if folders.isEmpty():
            break
    return files.select("table_name", "file_path", "length", "modified")


def indexed_listing(spark: SparkSession, location: str, table_name: str | None = None) -> DataFrame:
    """The same through Spark's file index. The index stays on the driver, and empty and hidden files are left out. Contents are
    never read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
    return listing.select(
        _name(table_name), F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified")
    )


def inventory_listing(
    inventory: DataFrame, path: str, length: str, modified: str | None = None, table_name: str = "table_name"
) -> DataFrame:
    """A listing from a storage inventory that names files, lengths and tables in columns of its own.

    Folder markers, empty objects whose names end in a slash, are no files.
    """
    own = F.col(table_name) if table_name in inventory.columns else F.lit(None).cast("string")
    time = F.col(modified) if modified else F.lit(None)
    marker = (F.col(path).endswith("/")) & (F.coalesce(F.col(length), F.lit(0)) == 0)
    return inventory.where(~marker).select(
        own.alias("table_name"),
        F.col(path).alias("file_path"),
        F.col(length).cast("bigint").alias("length"),
        time.cast("timestamp").alias("modified"),
    )


def _name(table_name: str | None):
    return (F.lit(table_name) if table_name else F.lit(None).cast("string")).alias("table_name")
