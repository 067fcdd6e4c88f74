"""Small table trees on disk: metadata JSON, manifest lists and manifests as Avro, and empty data files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

DAY = 86_400_000

MANIFEST_LIST = {
    "type": "record",
    "name": "manifest_file",
    "fields": [
        {"name": "manifest_path", "type": "string"},
        {"name": "manifest_length", "type": "long"},
        {"name": "partition_spec_id", "type": "int"},
        {"name": "content", "type": "int"},
        {"name": "added_snapshot_id", "type": "long"},
    ],
}

COLUMN_BOUNDS = {
    "type": "array",
    "items": {
        "type": "record",
        "name": "bound",
        "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "bytes"}],
    },
}


def entry_schema(partition: list[dict], version: int) -> dict:
    data_file = [
        {"name": "file_path", "type": "string"},
        {"name": "file_format", "type": "string"},
        {"name": "partition", "type": {"type": "record", "name": "r102", "fields": partition}},
        {"name": "record_count", "type": "long"},
        {"name": "file_size_in_bytes", "type": "long"},
        {"name": "lower_bounds", "type": ["null", COLUMN_BOUNDS]},
    ]
    if version > 1:
        data_file.insert(0, {"name": "content", "type": "int"})
    return {
        "type": "record",
        "name": "manifest_entry",
        "fields": [
            {"name": "status", "type": "int"},
            {"name": "snapshot_id", "type": ["null", "long"]},
            {"name": "data_file", "type": {"type": "record", "name": "r2", "fields": data_file}},
        ],
    }


def write_avro(spark: SparkSession, path: Path, schema: dict, records: list[dict]) -> None:
    """Records in Avro's JSON encoding (union values carry their branch) as a deflated file."""
    jvm = spark._jvm
    parsed = jvm.org.apache.avro.Schema.Parser().parse(json.dumps(schema))
    writer = jvm.org.apache.avro.file.DataFileWriter(jvm.org.apache.avro.generic.GenericDatumWriter(parsed))
    writer.setCodec(jvm.org.apache.avro.file.CodecFactory.fromString("deflate"))
    writer.create(parsed, jvm.java.io.File(str(path)))
    reader = jvm.org.apache.avro.generic.GenericDatumReader(parsed)
    for record in records:
        decoder = jvm.org.apache.avro.io.DecoderFactory.get().jsonDecoder(parsed, json.dumps(record))
        writer.append(reader.read(None, decoder))
    writer.close()


class Tree:
    """One table under construction."""

    def __init__(self, spark, root: Path, database: str, name: str, version: int, specs: list, columns: list):
        self.spark, self.version, self.specs, self.columns = spark, version, specs, columns
        self.location = root / database / name
        (self.location / "metadata").mkdir(parents=True)
        (self.location / "data").mkdir()
        self.snapshots: list[dict] = []
        self.manifests: list[dict] = []
        self.live: list[dict] = []

    def path(self, name: str) -> str:
        return f"file://{self.location}/{name}"

    def manifest(self, snapshot_id: int, partition: list[dict], files: list[dict], spec_id: int = 0, content: int = 0):
        """A manifest with ``files``: dicts of path, partition values, records, size, and maybe content/status."""
        name = f"metadata/{len(self.manifests):05d}-m0.avro"
        records = []
        for f in files:
            data_file = {
                "file_path": self.path(f["path"]),
                "file_format": "PARQUET",
                "partition": f.get("partition", {}),
                "record_count": f.get("records", 1),
                "file_size_in_bytes": f.get("size", 1),
                "lower_bounds": {"array": [{"key": 1, "value": "\u0001ÿ"}]},
            }
            if self.version > 1:
                data_file["content"] = f.get("content", 0)
            own = f.get("snapshot_id", snapshot_id)
            records.append(
                {
                    "status": f.get("status", 1),
                    "snapshot_id": None if own is None else {"long": own},
                    "data_file": data_file,
                }
            )
            (self.location / f["path"]).parent.mkdir(parents=True, exist_ok=True)
            (self.location / f["path"]).touch()
        write_avro(self.spark, self.location / name, entry_schema(partition, self.version), records)
        row = {
            "manifest_path": self.path(name),
            "manifest_length": 1,
            "partition_spec_id": spec_id,
            "content": content,
            "added_snapshot_id": snapshot_id,
        }
        self.manifests.append(row)
        return row

    def snapshot(self, snapshot_id: int, timestamp_ms: int, operation: str, manifests: list[dict], **summary):
        name = f"metadata/snap-{snapshot_id}.avro"
        write_avro(self.spark, self.location / name, MANIFEST_LIST, manifests)
        parent = self.snapshots[-1]["snapshot-id"] if self.snapshots else None
        s = {
            "snapshot-id": snapshot_id,
            "timestamp-ms": timestamp_ms,
            "manifest-list": self.path(name),
            "summary": {"operation": operation, **{k.replace("_", "-"): str(v) for k, v in summary.items()}},
        }
        if parent is not None:
            s["parent-snapshot-id"] = parent
        self.snapshots.append(s)

    def metadata(self, file_version: int = 1, **changes) -> str:
        document = {
            "format-version": self.version,
            "table-uuid": f"uuid-{self.location.name}",
            "location": f"file://{self.location}",
            "current-snapshot-id": self.snapshots[-1]["snapshot-id"] if self.snapshots else -1,
            "default-spec-id": self.specs[-1]["spec-id"] if self.specs else 0,
            "partition-specs": self.specs,
            "current-schema-id": 0,
            "schemas": [{"schema-id": 0, "type": "struct", "fields": self.columns}],
            "properties": {"owner": "tests"},
            "snapshots": self.snapshots,
            "sort-orders": [{"order-id": 0, "fields": []}],
        }
        document.update(changes)
        document = {k: v for k, v in document.items() if v is not None}
        target = self.location / "metadata" / f"v{file_version}.metadata.json"
        target.write_text(json.dumps(document, indent=2))
        return str(target)


COLUMNS = [
    {"id": 1, "name": "id", "required": True, "type": "long"},
    {"id": 2, "name": "ts", "required": False, "type": "timestamp"},
    {"id": 3, "name": "region", "required": False, "type": "string"},
    {"id": 4, "name": "tags", "required": False, "type": {"type": "list", "element-id": 5, "element": "string"}},
    {"id": 6, "name": "day", "required": False, "type": "date"},
]


def _spec(spec_id: int, *fields: tuple[str, str, int]) -> dict:
    return {
        "spec-id": spec_id,
        "fields": [
            {"name": n, "transform": t, "source-id": s, "field-id": 1000 + i} for i, (n, t, s) in enumerate(fields)
        ],
    }


def _nullable(name: str, kind: str) -> dict:
    return {"name": name, "type": ["null", kind]}


def build_warehouse(spark: SparkSession, root: Path) -> Path:
    # v2_mor: by day; two appends, a position delete, an equality delete, one file removed, one stray file.
    t = Tree(spark, root, "sales", "v2_mor", 2, [_spec(0, ("ts_day", "day", 2))], COLUMNS)
    by_day = [_nullable("ts_day", "int")]

    def day(n):
        return {"ts_day": None if n is None else {"int": n}}

    m1 = t.manifest(
        11,
        by_day,
        [
            {"path": "data/d0/a 1.parquet", "partition": day(19000), "records": 10, "size": 1000},
            {"path": "data/d0/b%2Bb.parquet", "partition": day(19000), "records": 20, "size": 3000},
            {"path": "data/d1/c+c.parquet", "partition": day(19001), "records": 30, "size": 2000, "snapshot_id": None},
            {"path": "data/none/n.parquet", "partition": day(None), "records": 5, "size": 500},
        ],
    )
    t.snapshot(11, 1_700_000_000_000, "append", [m1], added_data_files=4, added_records=65, total_files_size=6500)
    m2 = t.manifest(
        12, by_day, [{"path": "data/d1/p.parquet", "partition": day(19001), "content": 1, "records": 3, "size": 50}], content=1
    )
    t.snapshot(12, 1_700_000_000_123, "overwrite", [m1, m2], added_delete_files=1)
    m3 = t.manifest(
        13, by_day, [{"path": "data/d0/e.parquet", "partition": day(19000), "content": 2, "records": 2, "size": 70}], content=1
    )
    m4 = t.manifest(
        13,
        by_day,
        [
            {"path": "data/d0/a 1.parquet", "partition": day(19000), "records": 10, "size": 1000, "snapshot_id": 11, "status": 0},
            {"path": "data/d0/b%2Bb.parquet", "partition": day(19000), "records": 20, "size": 3000, "status": 2},
            {"path": "data/d1/c+c.parquet", "partition": day(19001), "records": 30, "size": 2000, "snapshot_id": 11, "status": 0},
            {"path": "data/none/n.parquet", "partition": day(None), "records": 5, "size": 500, "snapshot_id": 11, "status": 0},
        ],
    )
    t.snapshot(13, 1_700_000_000_123 + DAY, "delete", [m4, m2, m3], added_delete_files=1, deleted_data_files=1)
    (t.location / "data/d0/stray x%20y.parquet").touch()
    t.metadata(1, **{"current-snapshot-id": 12, "snapshots": t.snapshots[:2]})
    t.metadata(2)
    log = [{"metadata-file": t.path(f"metadata/v{v}.metadata.json"), "timestamp-ms": v} for v in (1, 2)]
    refs = {"main": {"snapshot-id": 13, "type": "branch"}, "keep": {"snapshot-id": 11, "type": "tag"}}
    t.metadata(10, refs=refs, **{"metadata-log": log})

    # v1_plain: early format, identity partition, old field names.
    t = Tree(spark, root, "sales", "v1_plain", 1, [], COLUMNS)
    by_region = [_nullable("region", "string")]
    m = t.manifest(
        21,
        by_region,
        [
            {"path": "data/eu.parquet", "partition": {"region": {"string": "eu, north"}}, "records": 7, "size": 100},
            {"path": "data/null.parquet", "partition": {"region": None}, "records": 8, "size": 200},
        ],
    )
    t.snapshot(21, 1_600_000_000_000, "append", [m], added_data_files=2)
    t.metadata(
        1,
        **{
            "partition-specs": None,
            "schemas": None,
            "current-schema-id": None,
            "default-spec-id": None,
            "schema": {"type": "struct", "fields": COLUMNS},
            "partition-spec": [{"name": "region", "transform": "identity", "source-id": 3, "field-id": 1000}],
        },
    )

    # empty: no snapshot yet.
    Tree(spark, root, "sales", "empty", 2, [_spec(0)], COLUMNS).metadata(1)

    # unpartitioned: empty spec.
    t = Tree(spark, root, "ops", "unpartitioned", 2, [_spec(0)], COLUMNS)
    m = t.manifest(31, [], [{"path": f"data/u{i}.parquet", "records": i, "size": 10 * i} for i in range(1, 5)])
    t.snapshot(31, 1_650_000_000_000, "append", [m])
    t.metadata(1)

    # evolved: two specs in one table.
    t = Tree(
        spark,
        root,
        "ops",
        "evolved",
        2,
        [_spec(0, ("ts_month", "month", 2)), _spec(1, ("ts_hour", "hour", 2), ("day", "identity", 6))],
        COLUMNS,
    )
    m1 = t.manifest(
        41, [_nullable("ts_month", "int")], [{"path": "data/m.parquet", "partition": {"ts_month": {"int": 600}}, "size": 9}]
    )
    m2 = t.manifest(
        42,
        [_nullable("ts_hour", "int"), _nullable("day", "int")],
        [{"path": "data/h.parquet", "partition": {"ts_hour": {"int": 456_013}, "day": {"int": 19_000}}, "size": 8}],
        spec_id=1,
    )
    t.snapshot(41, 1_650_000_000_000, "append", [m1])
    t.snapshot(42, 1_650_000_001_000, "append", [m1, m2])
    t.metadata(1)

    # big_numbers: sums and summaries past 31 bits.
    t = Tree(spark, root, "ops", "big_numbers", 2, [_spec(0)], COLUMNS)
    m = t.manifest(
        2**60 + 1,
        [],
        [{"path": f"data/b{i}.parquet", "records": 3_000_000_000, "size": 5_000_000_000} for i in range(3)],
    )
    t.snapshot(2**60 + 1, 1_650_000_000_000, "append", [m], added_records=9_000_000_000, total_files_size=15_000_000_000)
    t.metadata(1)

    # broken: a cut-off document.
    broken = root / "ops" / "broken" / "metadata"
    broken.mkdir(parents=True)
    (broken / "v1.metadata.json").write_text('{"format-version": 2, "location": "x", "snap')
    return root
