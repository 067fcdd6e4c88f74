"""Manifest lists and manifests: Avro files naming the data and delete files of a snapshot.

Files are opened by tasks, with Avro's own reader in the JVM and the session's Hadoop settings; their paths are rows like any
others and never come to the driver. Small files are packed into few tasks, large ones cut into pieces at block borders. Records
become JSON text, so that ``from_json`` with a short schema drops column bounds and sizes before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import utc_text
from ..jvm import map_partitions
from ..plans.lineage import Kept
from ..schemas import ENTRY_SCHEMA, MANIFEST_LIST_SCHEMA, STATUS_DELETED

ENTRIES_SCHEMA = (
    "table_name STRING, snapshot_id BIGINT, status INT, content INT, file_path STRING, file_format STRING, "
    "spec_id INT, partition ARRAY<STRUCT<name: STRING, value: STRING>>, record_count BIGINT, "
    "file_size_in_bytes BIGINT, manifest_path STRING"
)
#: Bytes of files that a task reads, and of the pieces into which larger files are cut.
TASK_BYTES, PIECE_BYTES = 64 * 1024 * 1024, 32 * 1024 * 1024
#: What a file of unknown length counts for; such files are not cut.
USUAL_BYTES = 1024 * 1024
_NO_END = 1 << 62


def avro_records(files: DataFrame, owner: str, strict: bool = True) -> DataFrame:
    """``owner, record, error``: the records of the Avro files in ``path, length`` rows as JSON text, each with the column
    ``owner`` of its file.

    Each row is read, so paths should not repeat; ``length`` may be null. Files are dealt out over as many tasks as their bytes
    need, at least one for each core, so that a scan of many small files has few tasks. Unless strict, a file that can't be
    opened, is shorter than its known length, or in which a block can't be read, ends there with a row that has an ``error``
    and no record.

    Looks at all rows once to see how many bytes there are.
    """
    spark = files.sparkSession
    row = files.agg(F.sum(F.coalesce("length", F.lit(USUAL_BYTES))).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_pieces = row.n + (row.bytes or 0) // PIECE_BYTES
    tasks = max(min(n_pieces, spark.sparkContext.defaultParallelism), -(-(row.bytes or 0) // TASK_BYTES), 1)
    last = F.greatest(F.coalesce("length", F.lit(0)) - 1, F.lit(0)).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), last, F.lit(PIECE_BYTES).cast("bigint"))
    pieces = files.select("path", F.explode(starts).alias("start"), F.coalesce("length", F.lit(0)).cast("bigint").alias("length"), owner)
    end = F.when(F.col("start") + PIECE_BYTES < F.col("length"), F.col("start") + PIECE_BYTES).otherwise(F.lit(_NO_END))
    columns = "path", "start", end.cast("bigint").alias("end"), "length", F.col(owner).alias("owner")
    dealt = pieces.select(*columns).repartition(tasks)
    kind = files.schema[owner].dataType.simpleString()
    return map_partitions(dealt, "AvroRecords", f"owner {kind}, record STRING, error STRING", strict)


def _parsed(records: DataFrame, schema: str) -> DataFrame:
    """``owner``, ``error`` and the record as the columns of ``schema``. Generated, so that each record is parsed once however
    many expressions read it; an error is a row without values."""
    return records.select("owner", "error", F.inline(F.array(F.from_json("record", schema))))


MANIFEST_SCHEMA = (
    "table_name STRING, snapshot_id BIGINT, manifest_path STRING, manifest_length BIGINT, spec_id INT, "
    "added_snapshot_id BIGINT"
)
LOST_SCHEMA = "table_name STRING, path STRING, error STRING"


@dataclass
class Read:
    """Rows that could be read, and ``table_name, path, error`` of the files that could not; strictly, there are none."""

    rows: DataFrame
    lost: DataFrame


def _once(read: DataFrame, kept: Kept | None, path: str) -> tuple[DataFrame, DataFrame]:
    """What was read, stored so that rows and errors come from one reading."""
    whole = (kept or Kept()).stored(read)
    lost = whole.where("error IS NOT NULL").select("table_name", F.col(path).alias("path"), "error").distinct()
    return whole.where("error IS NULL").drop("error"), lost


def manifest_files(snapshots: DataFrame, kept: Kept | None = None, strict: bool = True) -> Read:
    """Manifests of the given snapshots: those in their manifest lists, or named in the metadata itself (early format).

    A list that several tables share, say one table under two names, is read once and its manifests belong to each.
    """
    lists = (
        snapshots.where("manifest_list IS NOT NULL")
        .groupBy("manifest_list", "table_name")
        .agg(F.min("snapshot_id").alias("snapshot_id"))
        .groupBy("manifest_list")
        .agg(F.collect_list(F.struct("table_name", "snapshot_id")).alias("tables"))
    )
    files = (kept or Kept()).stored(
        lists.select(
            F.col("manifest_list").alias("path"),
            F.lit(None).cast("bigint").alias("length"),
            F.struct(F.col("manifest_list").alias("path"), "tables").alias("owner"),
        )
    )
    records = _parsed(avro_records(files, "owner", strict), MANIFEST_LIST_SCHEMA)
    owned = records.select("*", F.col("owner.path").alias("list_path"), F.explode("owner.tables").alias("of"))
    listed, lost = _once(
        owned.select(
            "of.table_name",
            "of.snapshot_id",
            "manifest_path",
            "manifest_length",
            F.coalesce("partition_spec_id", F.lit(0)).alias("spec_id"),
            F.coalesce("added_snapshot_id", F.col("of.snapshot_id")).alias("added_snapshot_id"),
            "list_path",
            "error",
        ),
        kept,
        "list_path",
    )
    listed = listed.drop("list_path")
    if "manifests" not in snapshots.columns:
        return Read(listed, lost)
    embedded = snapshots.where("manifest_list IS NULL").select(
        "table_name",
        "snapshot_id",
        F.explode("manifests").alias("manifest_path"),
        F.lit(None).cast("bigint").alias("manifest_length"),
        F.lit(0).alias("spec_id"),
        F.col("snapshot_id").alias("added_snapshot_id"),
    )
    return Read(listed.unionByName(embedded), lost)


def _bytes_of(value: Column) -> Column:
    """The bytes of a value that the Avro reader wrote as a list of signed numbers, or as text of one character a byte."""
    listed = F.transform(F.from_json(value, "array<int>"), lambda b: F.pmod(b, F.lit(256)))
    text = F.from_json(value, "bytes STRING")["bytes"]
    spelled = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    return F.when(value.startswith("["), listed).when(value.startswith("{"), F.filter(spelled, lambda b: b > 0))


def _hex(data: Column) -> Column:
    return F.array_join(F.transform(data, lambda b: F.lower(F.lpad(F.hex(b.cast("int")), 2, "0"))), "")


def _decimal_text(value: Column, kind: Column) -> Column:
    """An unscaled two's complement number, written with the scale of its type."""
    data = _bytes_of(value)
    wide = "decimal(38,0)"
    whole = F.aggregate(data, F.lit(0).cast(wide), lambda n, b: (n * 256 + b).cast(wide))
    limit = F.aggregate(data, F.lit(1).cast(wide), lambda n, b: (n * 256).cast(wide))
    number = F.when(F.element_at(data, 1) >= 128, (whole - limit).cast(wide)).otherwise(whole)
    scale = F.regexp_extract(kind, r",\s*(\d+)\)", 1).try_cast("int")
    plain = F.abs(number).cast("string")
    padded = F.lpad(plain, F.greatest(F.length(plain), scale + 1), F.lit("0"))
    cut = F.length(padded) - scale
    digits = F.concat(F.substring(padded, F.lit(1), cut), F.lit("."), F.substring(padded, cut + 1, scale))
    return F.concat(F.when(number < 0, "-").otherwise(""), F.when(scale > 0, digits).otherwise(plain))


def _uuid_text(value: Column) -> Column:
    return F.regexp_replace(_hex(_bytes_of(value)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _value_text(value: Column, kind: Column) -> Column:
    """A partition value as text. Times arrive as numbers since 1970 in the unit of their transform, and are written in UTC
    whatever the session's zone."""
    number = value.try_cast("bigint")
    day = F.date_from_unix_date(number.try_cast("int")).cast("string")
    month = F.date_format(F.add_months(F.lit("1970-01-01").cast("date"), number.try_cast("int")), "yyyy-MM")
    hour_day = F.date_from_unix_date(F.floor(number / 24).cast("int")).cast("string")
    hour = F.concat(hour_day, F.lit("-"), F.lpad(F.pmod(number, F.lit(24)).cast("string"), 2, "0"))
    moment = utc_text(number)
    clock = F.substring(utc_text(number), F.lit(12), F.lit(15))
    return (
        F.when(kind.startswith("decimal"), F.coalesce(_decimal_text(value, kind), value))
        .when(kind == "uuid", F.coalesce(_uuid_text(value), value))
        .when((kind == "binary") | kind.startswith("fixed"), F.coalesce(_hex(_bytes_of(value)), value))
        .when(kind == "time", clock)
        .otherwise(_time_or_plain(value, kind, number, day, month, hour, moment))
    )


def _time_or_plain(
    value: Column, kind: Column, number: Column, day: Column, month: Column, hour: Column, moment: Column
) -> Column:
    return (
        F.when(kind.isin("day", "date"), day)
        .when(kind == "month", month)
        .when(kind == "year", (number + 1970).cast("string"))
        .when(kind == "hour", hour)
        .when(kind.isin("timestamp", "timestamptz"), moment)
        .otherwise(value)
    )


def spec_kinds(tables: DataFrame) -> DataFrame:
    """Per table and spec, how each partition field is written: its transform, or the column type for identity."""
    spec = tables.select("table_name", "schemas", F.explode("partition_specs").alias("spec"))
    columns = F.flatten(F.transform("schemas", lambda s: s["fields"]))

    def kind(field: Column) -> Column:
        source = F.filter(columns, lambda c: c["id"] == field["source-id"])
        column_type = F.try_element_at(source, F.lit(1))["type"]
        return F.when(field["transform"] == "identity", column_type).otherwise(field["transform"])

    fields = F.col("spec.fields")
    return spec.select(
        "table_name",
        F.col("spec.spec-id").alias("spec_id"),
        F.map_from_arrays(
            F.transform(fields, lambda f: f["name"]), F.transform(fields, lambda f: F.coalesce(kind(f), F.lit("")))
        ).alias("kinds"),
    )


def _entry_columns(owner: str) -> list[Column]:
    """A parsed manifest record as an entry of the table that ``owner`` tells.

    Entries without a snapshot id inherit the manifest's; the early format has no ``content`` and knows data files only.
    """
    kinds = F.col(f"{owner}.kinds")
    # A list of fields rather than a map: grouping by a map would sort its keys, and the order of the spec would be lost.
    shown = F.transform(
        F.map_entries("data_file.partition"),
        lambda f: F.struct(
            f["key"].alias("name"),
            _value_text(f["value"], F.coalesce(F.try_element_at(kinds, f["key"]), F.lit(""))).alias("value"),
        ),
    )
    partition = F.coalesce(shown, F.array().cast("array<struct<name:string,value:string>>"))
    return [
        F.col(f"{owner}.table_name"),
        F.coalesce("snapshot_id", f"{owner}.added_snapshot_id").alias("snapshot_id"),
        F.col("status"),
        F.coalesce("data_file.content", F.lit(0)).alias("content"),
        F.col("data_file.file_path"),
        F.col("data_file.file_format"),
        F.col(f"{owner}.spec_id"),
        partition.alias("partition"),
        F.col("data_file.record_count"),
        F.col("data_file.file_size_in_bytes"),
    ]


def owned_manifests(manifest_rows: DataFrame, tables: DataFrame) -> DataFrame:
    """``path, length, owner`` of each manifest once; its owner tells the tables that have it, and how each of them writes
    the values of its partition fields."""
    distinct = manifest_rows.groupBy("manifest_path", "table_name").agg(
        F.min("spec_id").alias("spec_id"),
        F.min("added_snapshot_id").alias("added_snapshot_id"),
        F.max("manifest_length").alias("length"),
    )
    known = distinct.join(spec_kinds(tables), ["table_name", "spec_id"], "left")
    return (
        known.groupBy("manifest_path")
        .agg(
            F.max("length").alias("length"),
            F.collect_list(F.struct("table_name", "spec_id", "added_snapshot_id", "kinds")).alias("tables"),
        )
        .select(
            F.col("manifest_path").alias("path"),
            "length",
            F.struct(F.col("manifest_path").alias("path"), "tables").alias("owner"),
        )
    )


def parse_entries(records: DataFrame) -> DataFrame:
    """Manifest records with their ``owner`` and ``error`` as entries, one for each table that has the manifest."""
    return entries_of(_parsed(records, ENTRY_SCHEMA))


def entries_of(parsed: DataFrame) -> DataFrame:
    """The same of records that are parsed already; ``error`` may be missing."""
    each = parsed.select("*", F.explode("owner.tables").alias("of"))
    error = F.col("error") if "error" in parsed.columns else F.lit(None).cast("string").alias("error")
    return each.select(*_entry_columns("of"), F.col("owner.path").alias("manifest_path"), error)


def read_entries(
    manifest_rows: DataFrame, tables: DataFrame, kept: Kept | None = None, strict: bool = True
) -> Read:
    """Entries of all given manifests, for every table that has them; one shared by many snapshots is read once."""
    files = (kept or Kept()).stored(owned_manifests(manifest_rows, tables))
    entries, lost = _once(parse_entries(avro_records(files, "owner", strict)), kept, "manifest_path")
    return Read(entries, lost)


def live_files(entries: DataFrame) -> DataFrame:
    """Entries that are not marked deleted."""
    return entries.where(F.col("status") != STATUS_DELETED)
