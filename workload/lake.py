"""A lake of real files, made from ``lineitem``: metadata documents, manifest lists and manifests, and data files to be listed.

Twenty tables and an empty one, each with a file for every line status and year. The older snapshot added what was shipped
before 1998; the current one adds the rest and deletes what is older than 1996. Files of 2000 are in no manifest. The newest
manifest of each seventh table is no Avro file.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from metagauge.jvm import map_partitions
from metagauge.plans.lineage import shared_folder

_NULLABLE = lambda name, kind: {"name": name, "type": ["null", kind], "default": None}


def _record(name: str, *fields: dict) -> dict:
    return {"type": "record", "name": name, "fields": list(fields)}


_MANIFEST = json.dumps(
    _record(
        "manifest_entry",
        {"name": "status", "type": "int"},
        _NULLABLE("snapshot_id", "long"),
        {
            "name": "data_file",
            "type": _record(
                "r2",
                {"name": "content", "type": "int"},
                {"name": "file_path", "type": "string"},
                {"name": "file_format", "type": "string"},
                {
                    "name": "partition",
                    "type": _record("r102", _NULLABLE("line_status", "string"), _NULLABLE("shipped_year", "int")),
                },
                {"name": "record_count", "type": "long"},
                {"name": "file_size_in_bytes", "type": "long"},
            ),
        },
    )
)
_LIST = json.dumps(
    _record(
        "manifest_file",
        {"name": "manifest_path", "type": "string"},
        {"name": "manifest_length", "type": "long"},
        {"name": "partition_spec_id", "type": "int"},
        {"name": "content", "type": "int"},
        {"name": "added_snapshot_id", "type": "long"},
    )
)
_DAY = 86_400_000


def _file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each file that lies in the lake."""
    number = F.col("l_orderkey") % 20
    grouped = (
        spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
        .groupBy(number.alias("number"), F.col("l_linestatus").alias("line_status"), F.year("l_shipdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("record_count"))
    )
    return grouped.withColumn("size", F.col("record_count") % 97 + 1)


def _folder(root: str) -> Column:
    return F.concat(F.lit(f"{root}/db"), (F.col("number") % 4).cast("string"), F.lit("/t"), F.col("number").cast("string"))


_WRITTEN: dict[tuple[str, str], str] = {}


def lake(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the lake, written once for each application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        _WRITTEN[key] = write_lake(spark, sf_dir)
    return _WRITTEN[key]


def write_lake(spark: SparkSession, sf_dir: str) -> str:
    """Writes the lake into a new folder of the shared one, and tells which."""
    base = shared_folder(spark) or f"file://{tempfile.mkdtemp(prefix='lake-')}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/lake-{uuid.uuid4()}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(target)
    root = system.makeQualified(target).toString()
    files = _file_rows(spark, sf_dir)
    at = _folder(root)
    path = F.concat(at, F.lit("/data/"), "line_status", F.lit("-"), "year", F.lit(".parquet"))
    text = F.lit(None).cast("string").alias("schema")
    contents = files.select(path.alias("path"), text, F.expr("repeat('x', CAST(size AS INT))").alias("line"))

    # Which manifest has a file, and how: 1 is the older snapshot's, 2 and 3 are the current one's.
    old, gone = F.col("year") < 1998, F.col("year") < 1996
    places = F.when(old, F.array(F.struct(F.lit(1), F.lit(1)), F.struct(F.lit(3), F.when(gone, 2).otherwise(0)))).otherwise(
        F.array(F.struct(F.lit(2), F.lit(1)))
    )
    known = files.where("year <> 2000").select("*", F.inline(places).alias("manifest", "status"))
    since_1970 = F.col("year") - 1970
    snapshot = F.when(F.col("status") == 1, F.when(F.col("manifest") == 1, 1).otherwise(2)).cast("bigint")
    entry = F.to_json(
        F.struct(
            "status",
            F.when(snapshot.isNotNull(), F.struct(snapshot.alias("long"))).alias("snapshot_id"),
            F.struct(
                F.lit(0).alias("content"),
                path.alias("file_path"),
                F.lit("PARQUET").alias("file_format"),
                F.struct(
                    F.struct(F.col("line_status").alias("string")).alias("line_status"),
                    F.struct(since_1970.cast("int").alias("int")).alias("shipped_year"),
                ).alias("partition"),
                "record_count",
                F.col("size").alias("file_size_in_bytes"),
            ).alias("data_file"),
        ),
        {"ignoreNullFields": "false"},
    )
    name = lambda n: F.concat(at, F.lit("/metadata/m"), n.cast("string"), F.lit(".avro"))
    broken = (F.col("number") % 7 == 3) & (F.col("manifest") == 2)
    entries = known.select(
        name(F.col("manifest")).alias("path"),
        F.when(~broken, F.lit(_MANIFEST)).alias("schema"),
        F.when(broken, F.lit("broken")).otherwise(entry).alias("line"),
    )

    tables = files.select("number").distinct()
    lists = tables.select("number", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("manifest")).select(
        F.concat(at, F.lit("/metadata/snap-"), F.least("manifest", F.lit(2)), F.lit(".avro")).alias("path"),
        F.lit(_LIST).alias("schema"),
        F.to_json(
            F.struct(
                name(F.col("manifest")).alias("manifest_path"),
                F.lit(1).alias("manifest_length"),
                F.lit(0).alias("partition_spec_id"),
                F.lit(0).alias("content"),
                F.least("manifest", F.lit(2)).alias("added_snapshot_id"),
            )
        ).alias("line"),
    )
    documents = tables.select(
        F.concat(at, F.lit("/metadata/v2.metadata.json")).alias("path"), text, _document(at, True).alias("line")
    )
    empty = tables.agg(F.max("number").alias("number")).select(
        F.lit(f"{root}/db0/t_empty/metadata/v1.metadata.json").alias("path"),
        text,
        _document(F.lit(f"{root}/db0/t_empty"), False).alias("line"),
    )
    every = contents.unionByName(entries).unionByName(lists).unionByName(documents).unionByName(empty)
    ordered = every.repartition("path").sortWithinPartitions("path")
    map_partitions(ordered, "LakeFiles", "path STRING", folder=Path(__file__).parent / "jvm").count()
    return root


def _document(location: Column, filled: bool) -> Column:
    def snapshot(number: int) -> Column:
        return F.struct(
            F.lit(number).alias("snapshot-id"),
            F.lit(number * _DAY).alias("timestamp-ms"),
            F.concat(location, F.lit(f"/metadata/snap-{number}.avro")).alias("manifest-list"),
            F.create_map(F.lit("operation"), F.lit("overwrite")).alias("summary"),
        )

    def field(i: int, name: str, kind: str) -> Column:
        return F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), F.lit(kind).alias("type"))

    def part(name: str, transform: str, source: int) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(transform).alias("transform"), F.lit(source).alias("source-id"))

    columns = F.array(field(1, "line_status", "string"), field(2, "shipped", "date"))
    spec = F.array(part("line_status", "identity", 1), part("shipped_year", "year", 2))
    fields = [
        F.lit(2).alias("format-version"),
        location.alias("location"),
        F.lit(2 if filled else -1).alias("current-snapshot-id"),
        F.array(F.struct(F.lit(0).alias("schema-id"), columns.alias("fields"))).alias("schemas"),
        F.array(F.struct(F.lit(0).alias("spec-id"), spec.alias("fields"))).alias("partition-specs"),
    ]
    if filled:
        fields.append(F.array(snapshot(1), snapshot(2)).alias("snapshots"))
    return F.to_json(F.struct(*fields))
