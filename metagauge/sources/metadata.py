"""Table metadata documents: one JSON file per version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..jvm import map_partitions
from ..schemas import METADATA_SCHEMA, SNAPSHOT_FIELDS

ERRORS_SCHEMA = "table_name STRING, metadata_location STRING, error STRING"


def table_name_of(metadata_location: Column | str) -> Column:
    """Name of the directory above ``metadata/``."""
    return F.element_at(F.split(metadata_location, "/"), -3)


def database_of(metadata_location: Column | str) -> Column:
    return F.element_at(F.split(metadata_location, "/"), -4)


def qualified_name_of(metadata_location: Column | str) -> Column:
    """``database.table`` of a table in a warehouse folder."""
    return F.concat_ws(".", database_of(metadata_location), table_name_of(metadata_location))


_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def parse_documents(documents: DataFrame, table_name: Column | None = None) -> DataFrame:
    """Documents with their fields under ``m``; a malformed one has ``error`` set to its text and fails no other."""
    name = table_name if table_name is not None else table_name_of("metadata_location")
    return _parsed(documents.select(name.alias("table_name"), "metadata_location", "document", F.lit(None).alias("lost")))


def _parsed(documents: DataFrame) -> DataFrame:
    parsed = F.from_json("document", METADATA_SCHEMA + ", `_corrupt` STRING", _PERMISSIVE)
    # A generated column: the optimizer would copy a plain parser call into every expression that reads its result.
    m = documents.select("table_name", "metadata_location", "document", "lost", F.explode(F.array(parsed)).alias("m"))
    # Text that is JSON but no table (say, an empty object) names no location.
    broken = F.col("m").isNull() | F.col("m._corrupt").isNotNull() | F.col("m.location").isNull()
    error = F.coalesce("lost", F.when(broken, F.coalesce("document", F.lit(""))))
    return m.select("table_name", "metadata_location", "m", error.alias("error"))


def read_tables(files: DataFrame, strict: bool = True) -> DataFrame:
    """``table_name, metadata_location, kind, text``: the documents in ``table_name, metadata_location`` rows, compressed or not,
    each as a row of kind ``table`` without its snapshots and a row of kind ``snapshot`` for each of these, or as one of kind
    ``error``.

    Tasks read token by token with the session's Hadoop settings and hold one snapshot at a time, and the rows are dealt anew,
    so that a document of any length is parsed by as many tasks as others. A file that is not there fails if ``strict``.
    """
    tasks = files.sparkSession.sparkContext.defaultParallelism
    owner = F.struct("table_name", "metadata_location").alias("owner")
    dealt = files.select(F.col("metadata_location").alias("path"), owner).repartition(tasks, "path")
    kinds = "owner struct<table_name: string, metadata_location: string>, kind STRING, text STRING"
    return map_partitions(dealt, "TableDocuments", kinds, strict).select("owner.*", "kind", "text").repartition(tasks)


def parse_tables(read: DataFrame) -> DataFrame:
    """As :func:`parse_documents`, of what :func:`read_tables` gives; snapshots are not among the fields."""
    text = F.when(F.col("kind") == "table", F.col("text")).alias("document")
    lost = F.when(F.col("kind") == "error", F.col("text")).alias("lost")
    return _parsed(read.where("kind <> 'snapshot'").select("table_name", "metadata_location", text, lost))


def parse_snapshots(read: DataFrame) -> DataFrame:
    """``table_name, metadata_location, s, error`` of every snapshot; one that is malformed has its text as the error."""
    parsed = F.from_json("text", SNAPSHOT_FIELDS + ", `_corrupt` STRING", _PERMISSIVE)
    each = read.where("kind = 'snapshot'").select("table_name", "metadata_location", "text", F.explode(F.array(parsed)).alias("s"))
    broken = F.col("s").isNull() | F.col("s._corrupt").isNotNull() | F.col("s.snapshot-id").isNull()
    return each.select("table_name", "metadata_location", "s", F.when(broken, F.col("text")).alias("error"))


def metadata_files(parsed: DataFrame) -> DataFrame:
    """Every file but manifests and data that the documents name, and the documents themselves, by table."""
    t = parsed.where("error IS NULL")

    def paths(items: str, field: str) -> Column:
        return F.coalesce(F.transform(items, lambda x: x[field]), F.array().cast("array<string>"))

    named = F.concat(
        F.array("metadata_location"),
        paths("m.metadata-log", "metadata-file"),
        paths("m.statistics", "statistics-path"),
        paths("m.partition-statistics", "statistics-path"),
        paths("m.snapshots", "manifest-list"),
    )
    return t.select("table_name", F.explode(named).alias("file_path")).where("file_path IS NOT NULL")


def fleet_errors(parsed: DataFrame) -> DataFrame:
    """Documents that could not be read as table metadata."""
    return parsed.where("error IS NOT NULL").select("table_name", "metadata_location", "error")


def _specs() -> Column:
    """Partition specs; an early format keeps the only one in ``partition-spec``."""
    only = F.array(
        F.struct(F.lit(0).alias("spec-id"), F.col("m.partition-spec").alias("fields"))
    )
    return F.coalesce(F.col("m.partition-specs"), F.when(F.col("m.partition-spec").isNotNull(), only))


def _schemas() -> Column:
    only = F.array(
        F.struct(F.coalesce(F.col("m.current-schema-id"), F.lit(0)).alias("schema-id"), F.col("m.schema.fields"))
    )
    return F.coalesce(F.col("m.schemas"), F.when(F.col("m.schema").isNotNull(), only))


def tables(parsed: DataFrame) -> DataFrame:
    """One row per readable document."""
    current = F.col("m.current-snapshot-id")
    return parsed.where("error IS NULL").select(
        "table_name",
        "metadata_location",
        F.col("m.table-uuid").alias("table_uuid"),
        F.col("m.location").alias("location"),
        F.col("m.format-version").alias("format_version"),
        # -1 is how some writers spell "none".
        F.when(current >= 0, current).alias("current_snapshot_id"),
        F.coalesce(F.col("m.default-spec-id"), F.lit(0)).alias("default_spec_id"),
        _specs().alias("partition_specs"),
        F.coalesce(F.col("m.current-schema-id"), F.lit(0)).alias("current_schema_id"),
        _schemas().alias("schemas"),
        F.col("m.properties").alias("properties"),
        F.transform(F.map_values("m.refs"), lambda r: r["snapshot-id"]).alias("ref_snapshot_ids"),
        _branches().alias("branches"),
    )


def _branches() -> Column:
    """Branches with the snapshot they end in and how many of its line they keep, if they say so; without any, the current
    snapshot is the end of one."""
    own = F.try_element_at("m.properties", F.lit("history.expire.min-snapshots-to-keep")).try_cast("int")
    branch = F.filter(F.map_entries("m.refs"), lambda e: F.coalesce(e["value"]["type"], F.lit("branch")) == "branch")
    named = F.transform(
        branch,
        lambda e: F.struct(
            e["key"].alias("name"),
            e["value"]["snapshot-id"].alias("snapshot_id"),
            F.coalesce(e["value"]["min-snapshots-to-keep"], own).alias("keep"),
        ),
    )
    only = F.array(F.struct(F.lit("main").alias("name"), F.col("m.current-snapshot-id").alias("snapshot_id"), own.alias("keep")))
    return F.when(F.size(named) > 0, named).otherwise(F.when(F.col("m.current-snapshot-id") >= 0, only))


def snapshots(parsed: DataFrame) -> DataFrame:
    """One row per snapshot, the operation taken out of its summary; of parsed documents, or of parsed snapshots."""
    good = parsed.where("error IS NULL")
    s = good if "s" in parsed.columns else good.select("table_name", F.explode("m.snapshots").alias("s"))
    summary = F.coalesce(F.col("s.summary"), F.create_map().cast("map<string,string>"))
    return s.select(
        "table_name",
        F.col("s.snapshot-id").alias("snapshot_id"),
        F.col("s.parent-snapshot-id").alias("parent_id"),
        F.timestamp_millis("s.timestamp-ms").alias("committed_at"),
        F.col("s.timestamp-ms").alias("timestamp_ms"),
        F.try_element_at("s.summary", F.lit("operation")).alias("operation"),
        F.col("s.manifest-list").alias("manifest_list"),
        F.col("s.manifests").alias("manifests"),
        F.map_filter(summary, lambda k, v: k != "operation").alias("summary"),
    )


def _fields_of(items: str, id_field: str, wanted: str, path: str) -> Column:
    """Fields of the entry of ``items`` whose id is ``wanted``."""
    chosen = F.filter(items, lambda x: x[id_field] == F.col(wanted))
    return F.transform(F.try_element_at(chosen, F.lit(1))["fields"], lambda f: f[path])


def catalog_inventory(documents: DataFrame) -> DataFrame:
    """What a catalog tells about its tables, from each table's newest document in a warehouse folder."""
    t = tables(parse_documents(documents))
    return t.select(
        database_of("metadata_location").alias("database"),
        F.col("table_name").alias("name"),
        "location",
        "properties",
        F.coalesce(
            _fields_of("partition_specs", "spec-id", "default_spec_id", "name"), F.array().cast("array<string>")
        ).alias("partition_keys"),
        F.map_from_arrays(
            _fields_of("schemas", "schema-id", "current_schema_id", "name"),
            _fields_of("schemas", "schema-id", "current_schema_id", "type"),
        ).alias("schema"),
    )
