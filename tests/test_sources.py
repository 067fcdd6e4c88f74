"""End to end over generated table trees."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from metagauge import TableAnalyzer
from metagauge.functions import partition_label
from metagauge.operators import partitions as partition_ops
from metagauge.plans.lineage import Kept
from metagauge.sources import catalog, manifests, metadata, storage


#: Some hundred kilobytes of names, so that a manifest of them has several blocks.
LONG = [f"data/{'x' * 150}{i}.parquet" for i in range(600)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def mor(spark, trees):
    return TableAnalyzer(spark, f"{trees}/sales/v2_mor/metadata/v10.metadata.json")


@pytest.fixture(scope="module")
def fleet(spark, trees):
    return TableAnalyzer(spark, warehouse=str(trees), database="*", strict=False)


def test_single_document_names_table_after_its_folder(mor):
    assert rows(mor.tables, "table_name", "current_snapshot_id", "format_version") == [("v2_mor", 13, 2)]


def test_live_files_are_those_of_the_current_snapshot(mor):
    assert rows(mor.files, "snapshot_id", "content", "record_count", "file_size_in_bytes") == [
        (11, 0, 10, 1000),
        (11, 0, 30, 2000),
        (11, 0, 5, 500),
        (12, 1, 3, 50),
        (13, 2, 2, 70),
    ]


def test_older_version_of_the_same_table(spark, trees):
    old = TableAnalyzer(spark, f"{trees}/sales/v2_mor/metadata/v1.metadata.json")
    assert rows(old.live_table_metrics(), "total_data_files", "total_delete_files", "record_count") == [(4, 1, 62)]


def test_entry_without_snapshot_id_inherits_the_manifest(spark, trees):
    old = TableAnalyzer(spark, f"{trees}/sales/v2_mor/metadata/v1.metadata.json")
    assert {r[0] for r in rows(old.files.where("content = 0"), "snapshot_id")} == {11}


def test_live_metrics_over_the_fleet(fleet):
    got = rows(
        fleet.live_table_metrics(),
        "table_name",
        "total_data_files",
        "total_delete_files",
        "total_files_size",
        "data_file_size",
        "delete_file_size",
        "record_count",
        "total_equality_delete_files",
    )
    assert got == [
        ("ops.big_numbers", 3, 0, 15_000_000_000, 15_000_000_000, 0, 9_000_000_000, 0),
        ("ops.evolved", 2, 0, 17, 17, 0, 2, 0),
        ("ops.unpartitioned", 4, 0, 100, 100, 0, 10, 0),
        ("sales.empty", 0, 0, 0, 0, 0, 0, 0),
        ("sales.v1_plain", 2, 0, 300, 300, 0, 15, 0),
        ("sales.v2_mor", 3, 1, 3620, 3500, 50, 42, 1),
    ]


def test_fleet_result_equals_single_table_result(fleet, mor):
    single = rows(mor.partition_metrics(), "data_file_count", "delete_file_count", "total_data_file_size")
    of_fleet = fleet.partition_metrics().where("table_name = 'sales.v2_mor'")
    assert rows(of_fleet, "data_file_count", "delete_file_count", "total_data_file_size") == single


def test_broken_document_is_reported_and_fails_no_other(fleet):
    assert rows(fleet.errors, "table_name") == [("ops.broken",)]


def test_missing_manifests_leave_out_their_table_only(spark, tmp_path):
    from tests.trees import COLUMNS, Tree

    for name in ("whole", "no_list", "no_manifest"):
        t = Tree(spark, tmp_path, "db", name, 2, [{"spec-id": 0, "fields": []}], COLUMNS)
        t.snapshot(1, 1000, "append", [t.manifest(1, [], [{"path": "data/a.parquet"}])])
        t.metadata(1)
    (tmp_path / "db/no_list/metadata/snap-1.avro").unlink()
    (tmp_path / "db/no_manifest/metadata/00000-m0.avro").unlink()

    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="db", strict=False)
    assert rows(fleet.live_table_metrics(), "table_name", "total_data_files") == [("db.whole", 1)]
    errors = {r.table_name: r.error.rsplit("/", 1)[1] for r in fleet.errors.collect()}
    assert errors == {"db.no_list": "snap-1.avro", "db.no_manifest": "00000-m0.avro"}
    assert fleet.snapshot_metrics().count() == 3  # snapshots are known from the documents
    with pytest.raises(Exception, match="(?i)does not exist"):
        TableAnalyzer(spark, warehouse=str(tmp_path), database="db").live_table_metrics().collect()


def _plain(spark, root, database, name, version=2, files=("data/a.parquet",)):
    from tests.trees import COLUMNS, Tree

    t = Tree(spark, root, database, name, version, [{"spec-id": 0, "fields": []}], COLUMNS)
    t.snapshot(1, 1000, "append", [t.manifest(1, [], [{"path": f} for f in files])])
    return t


def test_old_and_corrupt_manifests_are_isolated(spark, tmp_path):
    for name in ("whole", "old_gone", "corrupt", "cut"):
        t = _plain(spark, tmp_path, "db", name)
        t.snapshot(2, 2000, "append", [t.manifest(2, [], [{"path": "data/b.parquet"}])])
        t.metadata(1)
        (tmp_path / f"db/{name}/data").mkdir(exist_ok=True)
        (tmp_path / f"db/{name}/data/stray.parquet").write_text("x")
    (tmp_path / "db/old_gone/metadata/00000-m0.avro").unlink()
    (tmp_path / "db/corrupt/metadata/00001-m0.avro").write_bytes(b"no avro at all")
    bad = tmp_path / "db/cut/metadata/snap-2.avro"
    bad.write_bytes(b"")

    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="db", strict=False)
    assert rows(fleet.live_table_metrics(), "table_name", "total_data_files") == [("db.old_gone", 1), ("db.whole", 1)]
    assert {r.table_name for r in fleet.errors.collect()} == {"db.old_gone", "db.corrupt", "db.cut"}
    assert {r.table_name for r in fleet.orphan_files(fleet.storage()).collect()} == {"db.whole"}
    assert fleet.snapshot_metrics().count() == 4
    fleet.release()


def test_one_row_per_table_from_any_glob(spark, trees, tmp_path):
    _plain(spark, tmp_path, "a", "orders", files=["data/1.parquet"]).metadata(1)
    _plain(spark, tmp_path, "b", "orders", files=["data/1.parquet", "data/2.parquet"]).metadata(1)
    _plain(spark, tmp_path, "b", "lines").metadata(1)
    some = TableAnalyzer(spark, f"{tmp_path}/*/*/metadata/v1.metadata.json")
    assert rows(some.live_table_metrics(), "table_name", "total_data_files") == [("a.orders", 1), ("b.orders", 2), ("lines", 1)]
    versions = TableAnalyzer(spark, f"{trees}/sales/v2_mor/metadata/*.metadata.json")
    assert rows(versions.tables, "table_name", "current_snapshot_id") == [("v2_mor", 13)]
    assert versions.snapshots.count() == 3 and rows(versions.live_table_metrics(), "total_data_files") == [(3,)]


def test_a_manifest_belongs_to_every_table_that_has_it(spark, tmp_path):
    t = _plain(spark, tmp_path, "a", "one")
    document = (tmp_path / "a/one/metadata" / t.metadata(1).rsplit("/", 1)[1]).read_text()
    other = tmp_path / "a/two/metadata"
    other.mkdir(parents=True)
    (other / "v1.metadata.json").write_text(document)
    both = TableAnalyzer(spark, f"{tmp_path}/a/*/metadata/v1.metadata.json")
    assert rows(both.live_table_metrics(), "table_name", "total_data_files") == [("one", 1), ("two", 1)]


def test_compressed_metadata(spark, tmp_path):
    import gzip

    t = _plain(spark, tmp_path, "a", "packed")
    path = tmp_path / "a/packed/metadata" / t.metadata(1).rsplit("/", 1)[1]
    for name in ("v2.gz.metadata.json", "v3.metadata.json.gz"):
        (path.parent / name).write_bytes(gzip.compress(path.read_bytes()))
        one = TableAnalyzer(spark, f"{path.parent}/{name}")
        assert rows(one.live_table_metrics(), "table_name", "total_data_files") == [("packed", 1)]
    (path.parent / "v4.gz.metadata.json").write_bytes(b"broken")
    assert TableAnalyzer(spark, str(path.parent)).errors.count() == 1


def manifests_of(known):
    """One owner for all records, with the tables of these manifests."""
    tables = F.collect_list(F.struct("table_name", "spec_id", "added_snapshot_id", "kinds")).alias("tables")
    return known.groupBy("manifest_path").agg(tables).select(F.struct(F.col("manifest_path").alias("path"), "tables").alias("owner"))


def test_partition_values_of_every_type(spark):
    kinds = {"d": "decimal(9, 2)", "n": "decimal(9, 2)", "b": "binary", "u": "uuid", "t": "time", "h": "hour", "x": "int"}
    uuid = [18, 52, -85, -51, *range(12)]
    values = {"d": [0, 0, 4, -46], "n": [-1, -1, -1, -1], "u": uuid, "t": 3_661_000_001, "h": 455_941, "x": 7}
    partition = {**values, "b": {"bytes": "\u0001ÿ"}}
    record = json.dumps({"status": 1, "data_file": {"file_path": "f", "partition": partition, "record_count": 1}})
    manifest = "table_name STRING, spec_id INT, added_snapshot_id BIGINT, kinds MAP<STRING,STRING>, manifest_path STRING"
    known = spark.createDataFrame([("t", 0, 1, kinds, "/m")], manifest)
    records = spark.createDataFrame([(record, None)], "record STRING, error STRING")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        owned = manifests_of(known)
        entries = manifests.parse_entries(records.join(owned)).collect()
        got = {f.name: f.value for f in entries[0].partition}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {
        "d": "12.34",
        "n": "-0.01",
        "b": "01ff",
        "u": "1234abcd-0001-0203-0405-060708090a0b",
        "t": "01:01:01.000001",
        "h": "2022-01-05-13",
        "x": "7",
    }


def test_analyzer_over_relations(spark, mor, trees):
    own = TableAnalyzer.of_relations(
        spark, {"tables": mor.tables, "snapshots": mor.snapshots, "files": mor.files, "referenced": mor.references}
    )
    assert rows(own.live_table_metrics(), "*") == rows(mor.live_table_metrics(), "*")
    listing = mor.storage()
    assert rows(own.orphan_files(listing), "file_path") == rows(mor.orphan_files(listing), "file_path")
    assert rows(own.snapshot_metrics(12), "*") == rows(mor.snapshot_metrics(12), "*")
    own.release()


def test_metrics_of_a_given_snapshot(mor):
    assert rows(mor.snapshot_metrics(13), "*") == rows(mor.snapshot_metrics(), "*")
    assert rows(mor.snapshot_metrics(99), "operation", "added_records") == [("", 0)]
    assert {r.operation for r in mor.snapshot_metrics(11).collect()} != {""}


def test_partition_values_are_written_by_their_transform(fleet):
    got = fleet.partitions.where("table_name <> 'ops.big_numbers'")
    assert rows(got, "table_name", "spec_id", partition_label(got)) == [
        ("ops.evolved", 0, "ts_month=2020-01"),
        ("ops.evolved", 1, "ts_hour=2022-01-08-13, day=2022-01-08"),
        ("ops.unpartitioned", 0, "<unpartitioned>"),
        ("sales.v1_plain", 0, "region=None"),
        ("sales.v1_plain", 0, "region=eu, north"),
        ("sales.v2_mor", 0, "ts_day=2022-01-08"),
        ("sales.v2_mor", 0, "ts_day=2022-01-09"),
        ("sales.v2_mor", 0, "ts_day=None"),
    ]


def test_partition_columns_of_one_table(mor):
    flat = partition_ops.partition_flatten(mor.partition_metrics(), names=["ts_day"])
    assert rows(flat, "partition_ts_day", "data_file_count", "delete_file_count") == [
        ("2022-01-08", 1, 1),
        ("2022-01-09", 1, 1),
        (None, 1, 0),
    ]


def test_latest_snapshot_and_empty_table(fleet):
    got = rows(fleet.snapshot_metrics(), "table_name", "added_records", "added_delete_files", "operation")
    assert ("sales.empty", 0, 0, "") in got
    assert ("sales.v2_mor", 0, 1, "delete") in got
    assert ("ops.big_numbers", 9_000_000_000, 0, "append") in got


def test_history_is_newest_first_with_parents(mor):
    got = [(r.snapshot_id, r.parent_id, r.timestamp) for r in mor.historical_snapshots(2).collect()]
    assert got == [
        (13, 12, dt.datetime(2023, 11, 15, 22, 13, 20, 123000)),
        (12, 11, dt.datetime(2023, 11, 14, 22, 13, 20, 123000)),
    ]


def test_summary_has_no_operation(mor):
    assert all("operation" not in r.summary for r in mor.snapshots.collect())


def test_orphans_are_files_no_snapshot_knows(mor, trees):
    listing = mor.storage(f"file://{trees}/sales/v2_mor")
    got = [r.file_path for r in mor.orphan_files(listing).collect()]
    assert [p.rsplit("/", 1)[1] for p in got] == ["stray x%20y.parquet"]


def test_orphans_and_referenced_are_disjoint(mor, trees):
    listing = mor.storage(f"file://{trees}/sales/v2_mor")
    orphans = {r.file_path.rsplit("/", 1)[1] for r in mor.orphan_files(listing).collect()}
    referenced = {r.file_path.rsplit("/", 1)[1] for r in mor.entries.select("file_path").collect()}
    assert not orphans & referenced and len(referenced) == 6


def test_recent_files_are_no_orphans(mor, trees):
    listing = mor.storage(f"file://{trees}/sales/v2_mor")
    assert mor.orphan_files(listing, older_than=dt.datetime(2001, 1, 1)).count() == 0


def test_expiry_is_strict_and_protects_on_request(mor):
    edge = 1_700_000_000_123 + 30 * 86_400_000
    assert rows(mor.expirable_snapshots(edge), "snapshot_id") == [(11,)]
    assert rows(mor.expirable_snapshots(edge + 1), "snapshot_id") == [(11,), (12,)]
    # 11 carries a tag, 13 is current.
    far = edge + 100 * 86_400_000
    assert rows(mor.expirable_snapshots(far), "snapshot_id") == [(11,), (12,), (13,)]
    assert rows(mor.expirable_snapshots(far, protect_current=True), "snapshot_id") == [(12,)]


def test_report_reads_from_one_aggregate(mor):
    report = mor.table_metrics()
    try:
        assert rows(report.live_table_metrics, "total_data_files") == [(3,)]
        assert rows(report.file_metrics, "content", "file_count", "avg_record_count") == [
            (0, 3, 15),
            (1, 1, 3),
            (2, 1, 2),
        ]
        assert report.historical_snapshots.count() == 3
        assert report.partition_metrics.count() == 3
        assert rows(report.snapshot_metrics, "operation") == [("delete",)]
    finally:
        report.release()


def test_health_summary_of_one_table(mor, trees):
    listing = mor.storage(f"file://{trees}/sales/v2_mor")
    with pytest.raises(ValueError):
        mor.health_summary(listing.drop("table_name"), as_of=1)
    with pytest.raises(Exception, match="must tell the table"):
        mor.health_summary(storage.storage_listing(mor.spark, f"{trees}/sales/v2_mor"), as_of=1).collect()
    row = mor.health_summary(listing, as_of=1_800_000_000_000).collect()[0]
    assert (row.total_size_bytes, row.total_files, row.total_partitions) == (3500, 3, 3)
    assert (row.orphan_file_count, row.expirable_snapshot_count) == (1, 3)
    assert row.total_size_text == "3.42 KB"


def test_catalog_takes_the_highest_version(spark, trees):
    newest = catalog.newest_metadata(catalog.list_metadata(spark, str(trees)))
    versions = {(r.database, r.name): r.version for r in newest.collect()}
    assert versions[("sales", "v2_mor")] == 10 and len(versions) == 7


def test_catalog_inventory(spark, trees):
    inventory = metadata.catalog_inventory(catalog.warehouse_documents(spark, str(trees)))
    got = {(r.database, r.name): r for r in inventory.collect()}
    assert got[("ops", "evolved")].partition_keys == ["ts_hour", "day"]
    assert got[("sales", "v1_plain")].partition_keys == ["region"]
    assert got[("ops", "unpartitioned")].partition_keys == []
    assert got[("sales", "v2_mor")].schema["ts"] == "timestamp"
    assert "list" in got[("sales", "v2_mor")].schema["tags"]
    assert got[("sales", "empty")].properties == {"owner": "tests"}
    assert rows(catalog.list_databases(inventory), "database") == [("ops",), ("sales",)]
    assert ("sales", "empty") in rows(catalog.list_tables(inventory, "sales"), "database", "name")
    assert rows(catalog.table_properties(inventory, "sales", "empty"), "properties") == [({"owner": "tests"},)]
    location = catalog.table_location(inventory, "sales", "empty").collect()[0].location
    assert location.endswith("/sales/empty")


def test_session_inventory(spark, tmp_path):
    spark.sql(f"CREATE DATABASE stock LOCATION '{tmp_path}'")
    try:
        spark.sql(
            "CREATE TABLE stock.parts (id BIGINT, day DATE) USING parquet PARTITIONED BY (day) "
            f"TBLPROPERTIES ('team' = 'tests') LOCATION '{tmp_path}/parts'"
        )
        spark.sql("CREATE VIEW stock.shown AS SELECT 1 AS x")
        row = catalog.session_inventory(spark, "stock").collect()
        assert len(row) == 1
        got = row[0].asDict()
        assert got.pop("properties")["team"] == "tests"
        assert got.pop("location").endswith("/parts")
        assert got == {
            "database": "stock",
            "name": "parts",
            "partition_keys": ["day"],
            "schema": {"id": "bigint", "day": "date"},
        }
    finally:
        spark.sql("DROP DATABASE stock CASCADE")


def test_names_with_dots_are_split(spark, trees):
    assert catalog.split_name("cat.sales.empty") == ("sales", "empty")
    assert catalog.split_name("empty") == ("default", "empty")
    one = TableAnalyzer(spark, warehouse=str(trees), table_name="cat.sales.v1_plain")
    assert rows(one.tables, "table_name", "format_version") == [("sales.v1_plain", 1)]


def test_a_source_is_needed(spark):
    with pytest.raises(ValueError):
        TableAnalyzer(spark)


def test_patterns_are_listed_level_by_level(spark, trees):
    def found(pattern):
        return {r[0].split("/sales/")[-1] for r in catalog.metadata_at(spark, f"{trees}/{pattern}").collect()}

    v2 = {f"v2_mor/metadata/v{v}.metadata.json" for v in (1, 2, 10)}
    assert found("sales/v2_mor/metadata") == found("sales/v2_mor/metadata/") == found("sales/v2*/metadata/*.json") == v2
    assert found("sales/{v2_mor,empty}/metadata") == v2 | {"empty/metadata/v1.metadata.json"}
    assert found("s[a-b]les/*/metadata/v[12].metadata.json") == {
        "v2_mor/metadata/v1.metadata.json",
        "v2_mor/metadata/v2.metadata.json",
        "v1_plain/metadata/v1.metadata.json",
        "empty/metadata/v1.metadata.json",
    }
    assert found("sales/v2_mor/metadata/v1.metadata.json") == {"v2_mor/metadata/v1.metadata.json"}
    assert found("no/*/metadata") == found("sales/v2_mor/data") == set()


def test_a_long_document_is_parsed_by_several_tasks(spark, tmp_path):
    t = _plain(spark, tmp_path, "a", "long")
    path = tmp_path / "a/long/metadata" / t.metadata(1).rsplit("/", 1)[1]
    document = json.loads(path.read_text())
    first = document["snapshots"][0]
    many = [first | {"snapshot-id": i, "timestamp-ms": i, "parent-snapshot-id": i - 1} for i in range(1, 5001)]
    text = json.dumps(document | {"snapshots": many, "snapshot-log": [{"timestamp-ms": 1, "snapshot-id": 1}]})
    path.write_text(text)
    own = TableAnalyzer(spark, str(path))
    s = own.snapshots
    assert s.count() == 5000 and s.where("parent_id = snapshot_id - 1 AND operation = 'append'").count() == 5000
    assert s.select(F.spark_partition_id()).distinct().count() > 1
    assert rows(own.tables, "current_snapshot_id", "format_version") == [(1, 2)]
    own.release()

    bad = {"cut": text[: len(text) // 2], "list": "[1, 2]", "none": "", "more": text + "}", "other": "{}"}
    for name, content in bad.items():
        (tmp_path / f"a/{name}/metadata").mkdir(parents=True)
        (tmp_path / f"a/{name}/metadata/v1.metadata.json").write_text(content)
    odd = document | {"snapshots": [first, first | {"snapshot-id": "x"}]}
    (tmp_path / "a/odd/metadata").mkdir(parents=True)
    (tmp_path / "a/odd/metadata/v1.metadata.json").write_text(json.dumps(odd))
    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="a", strict=False)
    assert {r.table_name for r in fleet.errors.collect()} == {f"a.{n}" for n in bad} | {"a.odd"}
    assert rows(fleet.tables, "table_name") == [("a.long",), ("a.odd",)]
    assert fleet.snapshots.groupBy("table_name").count().where("table_name = 'a.odd'").first()["count"] == 1
    fleet.release()
    with pytest.raises(Exception, match="can't be read"):
        TableAnalyzer(spark, str(tmp_path / "a/gone/metadata/v1.metadata.json"))


def test_entries_in_pieces_equal_entries_at_once(spark, tmp_path, monkeypatch):
    t = _plain(spark, tmp_path, "db", "long", files=LONG)
    t.metadata(1)
    path = tmp_path / "db/long/metadata/00000-m0.avro"
    size = path.stat().st_size
    files = spark.createDataFrame([(str(path), size, 7)], "path STRING, length BIGINT, own INT")
    whole = rows(manifests.avro_records(files, "own"), "*")
    assert len(whole) == len(LONG) and {r[0] for r in whole} == {7}
    for piece in (size // 4, 1000):
        monkeypatch.setattr(manifests, "PIECE_BYTES", piece)
        cut = manifests.avro_records(files, "own")
        assert rows(cut, "*") == whole
        each = cut.groupBy(F.spark_partition_id()).count().collect()
        assert len(each) > 1


def test_small_files_are_packed_into_few_tasks(spark, tmp_path):
    from tests.trees import MANIFEST_LIST, write_avro

    record = {"manifest_path": "x", "manifest_length": 1, "partition_spec_id": 0, "content": 0, "added_snapshot_id": 5}
    path = tmp_path / "m.avro"
    write_avro(spark, path, MANIFEST_LIST, [record])
    for i in range(3000):
        (tmp_path / f"m{i}.avro").hardlink_to(path)
    given = spark.range(3000).selectExpr(f"concat('{tmp_path}/m', id, '.avro') path", "CAST(900 AS BIGINT) length", "id")
    found = manifests.avro_records(given.withColumn("length", F.lit(None).cast("bigint")), "id")
    assert found.select("owner").distinct().count() == 3000
    assert manifests.avro_records(given, "id", strict=False).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    # All are shorter than these lengths say.
    lost = manifests.avro_records(given.withColumn("length", F.lit(10**6)), "id", strict=False)
    assert lost.where("error LIKE '%cut off%' AND record IS NULL").count() == 3000


def test_a_broken_block_ends_its_file_only(spark, tmp_path):
    for name in ("whole", "broken"):
        t = _plain(spark, tmp_path, "db", name, files=LONG)
        t.snapshot(2, 2000, "append", [t.manifest(2, [], [{"path": "data/b.parquet"}])])
        t.metadata(1)
    bad = tmp_path / "db/broken/metadata/00001-m0.avro"
    late = tmp_path / "db/broken/metadata/00000-m0.avro"
    data = bytearray(late.read_bytes())
    data[-40:] = bytes(b ^ 255 for b in data[-40:])
    late.write_bytes(bytes(data))

    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="db", strict=False)
    # Its current snapshot does not need the broken manifest.
    assert rows(fleet.live_table_metrics(), "table_name", "total_data_files") == [("db.broken", 1), ("db.whole", 1)]
    errors = fleet.errors.collect()
    assert [(r.table_name, r.error.rsplit("/", 1)[1]) for r in errors] == [("db.broken", late.name)]
    assert fleet.entries.where("table_name = 'db.whole'").count() == len(LONG) + 1
    assert {r.table_name for r in fleet.orphan_files(fleet.storage()).collect()} <= {"db.whole"}
    fleet.release()
    with pytest.raises(Exception, match="can't be read"):
        TableAnalyzer(spark, warehouse=str(tmp_path), database="db").entries.count()

    bad.write_bytes(late.read_bytes())
    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="db", strict=False)
    assert rows(fleet.live_table_metrics(), "table_name", "total_data_files") == [("db.whole", 1)]
    assert fleet.errors.count() == 2
    fleet.release()


def test_each_manifest_is_opened_once(spark, tmp_path, monkeypatch):
    t = _plain(spark, tmp_path, "db", "many")
    for i in range(2, 7):
        t.snapshot(i, 1000 * i, "append", [t.manifest(i, [], [{"path": f"data/{i}.parquet"}])])
    t.metadata(1)
    opened, real = [], manifests.avro_records

    def seen(files, owner, strict=True):
        opened.extend(r.path for r in files.select("path").collect())
        return real(files, owner, strict)

    monkeypatch.setattr(manifests, "avro_records", seen)
    fleet = TableAnalyzer(spark, warehouse=str(tmp_path), database="db", strict=False)
    assert (fleet.files.count(), fleet.errors.count(), fleet.entries.count()) == (1, 0, 6)
    fleet.references.count()
    read = [p for p in opened if "-m0" in p]
    assert len(read) == len(set(read)) == 6
    fleet.release()


def test_entries_are_read_once(spark, mor):
    plan = mor.files._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Exchange" not in plan


def test_what_is_stored_is_released(spark):
    kept = Kept()
    stored, cached = kept.stored(spark.range(5)), kept.cached(spark.range(3))
    assert (stored.count(), cached.count(), cached.is_cached) == (5, 3, True)
    folders = [path for _, path in kept._folders]
    assert folders and all(os.path.isdir(f) for f in folders)
    kept.release()
    assert not any(os.path.exists(f) for f in folders) and not cached.is_cached


def test_no_path_gives_an_empty_relation(spark, trees):
    empty = TableAnalyzer(spark, f"{trees}/sales/empty/metadata/v1.metadata.json")
    assert empty.files.count() == 0
    assert rows(empty.live_table_metrics(), "total_data_files", "record_count") == [(0, 0)]
    assert empty.historical_snapshots().count() == 0


def test_paths_with_special_characters_are_read(spark, tmp_path):
    from tests.trees import MANIFEST_LIST, write_avro

    folder = tmp_path / "a,b {c} [d]*?"
    folder.mkdir()
    record = {
        "manifest_path": "x",
        "manifest_length": 1,
        "partition_spec_id": 0,
        "content": 0,
        "added_snapshot_id": 2**60,
    }
    paths = []
    for i in range(2):
        path = folder / f"m,{i}.avro"
        write_avro(spark, path, MANIFEST_LIST, [record] * (i + 1))
        paths.append(str(path))
    files = spark.createDataFrame([(p, None, i) for i, p in enumerate(paths)], "path STRING, length BIGINT, own INT")
    assert rows(manifests.avro_records(files, "own"), "owner") == [(0,), (1,), (1,)]


def test_listing_finds_empty_and_hidden_files(spark, tmp_path):
    names = {"a.parquet": "", "k=1/b%20 c.parquet": "x", "k=1/n/_d+e.parquet": "yy", "k=1/.hidden": "z"}
    for name, text in names.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "no files").mkdir()
    before = dt.datetime.now() - dt.timedelta(hours=1)
    for location in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        listing = storage.storage_listing(spark, location, "t").collect()
        prefix = location.rstrip("/")
        assert {(r.table_name, r.file_path, r.length) for r in listing} == {
            ("t", f"{prefix}/{n}", len(text)) for n, text in names.items()
        }
        assert all(r.modified > before for r in listing)


def test_listing_of_a_large_flat_folder(spark, tmp_path):
    for i in range(25_000):
        (tmp_path / f"{'_' if i % 3 else ''}{i}").touch()
    got = storage.storage_listing(spark, str(tmp_path), "t")
    assert got.count() == 25_000 and got.where("length = 0").count() == 25_000
    assert got.select("file_path").distinct().count() == 25_000


def test_listing_of_a_store_that_only_hadoop_opens(spark, tmp_path):
    (tmp_path / "lake/a/_b").mkdir(parents=True)
    (tmp_path / "lake/a/_b/.c d%20").write_text("xyz")
    (tmp_path / "lake/e").touch()
    spark.conf.set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    listing = storage.storage_listing(spark, "viewfs://store/in/lake/", "t")
    assert rows(listing.where("file_path NOT LIKE '%.crc'"), "file_path", "length") == [
        ("viewfs://store/in/lake/a/_b/.c d%20", 3),
        ("viewfs://store/in/lake/e", 0),
    ]
    nothing = storage.storage_listing(spark, "viewfs://store/in/no such folder", "t")
    assert nothing.count() == 0 and storage.storage_listing(spark, str(tmp_path / "lake/e"), "t").count() == 0


def test_indexed_listing_reads_no_contents(spark, trees):
    listing = storage.indexed_listing(spark, f"{trees}/sales").select("file_path", "length")
    assert listing.where("length > 0").count() > 0
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


@pytest.fixture
def session_parts(spark, mor, trees):
    """Metadata tables of a session catalog, stood in for by views of the same columns."""
    log = [(i, f"{trees}/sales/v2_mor/metadata/v{v}.metadata.json") for i, v in enumerate((1, 2, 10))]
    paths = mor._history.rows.select(F.col("manifest_path").alias("path"), F.col("manifest_length").alias("length"))
    return {
        "snapshots": mor.snapshots.drop("table_name", "timestamp_ms"),
        "files": mor.files.drop("table_name"),
        "all_files": mor.entries.drop("table_name"),
        "all_manifests": paths,
        "metadata_log_entries": spark.createDataFrame(log, "timestamp BIGINT, file STRING"),
        "refs": spark.createDataFrame([("main", 13), ("keep", 11)], "name STRING, snapshot_id BIGINT"),
    }


def test_session_catalog_relations(spark, mor, session_parts):
    parts = session_parts
    relations = catalog.session_relations(spark, "cat.sales.v2_mor", parts.__getitem__)
    assert rows(relations["tables"], "table_name", "current_snapshot_id") == [("sales.v2_mor", 13)]
    assert relations["snapshots"].where("timestamp_ms = 1700000000123").count() == 1
    stats = partition_ops.partition_stats(relations["files"])
    assert stats.count() == 3

    parts["refs"] = parts["refs"].limit(0)
    nothing = catalog.session_relations(spark, "cat.sales.v2_mor", parts.__getitem__)["tables"]
    assert rows(nothing, "table_name", "current_snapshot_id") == [("sales.v2_mor", None)]


@pytest.mark.parametrize("open_document", [True, False])
def test_session_table_answers_as_by_path(spark, mor, trees, session_parts, open_document):
    location = f"file://{trees}/sales/v2_mor"
    relations = catalog.session_relations(
        spark, "cat.sales.v2_mor", session_parts.__getitem__, open_document=open_document
    )
    assert rows(relations["tables"], "location") == [(f"{trees}/sales/v2_mor",)]
    for strict in (True, False):
        own = TableAnalyzer.of_relations(spark, relations, strict)
        assert own.errors.count() == 0 and own.errors.columns == mor.errors.columns
        listing, by_path = own.storage(), mor.storage(location)
        assert rows(listing, F.regexp_extract("file_path", "[^/]*$", 0), "length") == rows(
            by_path, F.regexp_extract("file_path", "[^/]*$", 0), "length"
        )
        expected = {r.file_path.rsplit("/", 1)[1] for r in mor.orphan_files(by_path).collect()}
        assert expected and {r.file_path.rsplit("/", 1)[1] for r in own.orphan_files(listing).collect()} == expected
        summary = own.health_summary(listing, as_of=1_800_000_000_000).collect()[0]
        assert (summary.orphan_file_count, summary.total_files) == (1, 3)
        own.release()
    bare = TableAnalyzer.of_relations(spark, relations | {"tables": relations["tables"].drop("location")})
    with pytest.raises(ValueError, match="locations"):
        bare.storage()


def test_statistics_of_a_session_table_are_no_orphans(spark, mor, trees, session_parts, tmp_path):
    document = json.loads((trees / "sales/v2_mor/metadata/v10.metadata.json").read_text())
    document["statistics"] = [{"snapshot-id": 13, "statistics-path": f"{tmp_path}/t/metadata/1.stats"}]
    newest = tmp_path / "t/metadata/v11.metadata.json"
    newest.parent.mkdir(parents=True)
    newest.write_text(json.dumps(document))
    (tmp_path / "t/metadata/1.stats").touch()
    (tmp_path / "t/metadata/2.stats").touch()
    log = spark.createDataFrame([(9, str(newest))], "timestamp BIGINT, file STRING")
    session_parts["metadata_log_entries"] = session_parts["metadata_log_entries"].union(log)
    own = TableAnalyzer.of_relations(spark, catalog.session_relations(spark, "v2_mor", session_parts.__getitem__))
    assert [r.file_path.rsplit("/", 1)[1] for r in own.orphan_files(own.storage()).collect()] == ["2.stats"]
    own.release()


def test_a_store_of_manifests_opens_new_ones_only(spark, tmp_path, monkeypatch):
    from metagauge.sources import parsed

    opened, real = [], manifests.avro_records

    def seen(files, owner, strict=True):
        opened.extend(r.path.rsplit("/", 1)[1] for r in files.select("path").collect())
        return real(files, owner, strict)

    monkeypatch.setattr(parsed, "avro_records", seen)
    t = _plain(spark, tmp_path, "db", "kept", files=["data/a.parquet", "data/b.parquet"])
    t.snapshot(2, 2000, "append", [t.manifest(2, [], [{"path": "data/c.parquet"}])])
    t.metadata(1)
    names = "snapshot_id", "status", "file_path", "partition", "record_count", "manifest_path"

    def answers(store):
        own = TableAnalyzer(spark, str(tmp_path / "db/kept/metadata"), strict=False, manifest_store=store)
        out = rows(own.entries, *names), rows(own.live_table_metrics(), "*"), own.errors.count()
        own.release()
        return out

    store = str(tmp_path / "store")
    assert answers(store) == answers(None) and sorted(opened) == ["00000-m0.avro", "00001-m0.avro"]
    opened.clear()
    assert answers(store) == answers(None) and opened == []
    t.snapshot(3, 3000, "append", [t.manifest(3, [], [{"path": "data/d.parquet"}])])
    t.metadata(2)
    bad = tmp_path / "db/kept/metadata/00002-m0.avro"
    whole = bad.read_bytes()
    bad.write_bytes(whole[:-20])
    assert answers(store) == answers(None) and answers(store)[2] == 1  # not kept, so looked at again
    bad.write_bytes(whole)
    opened.clear()
    assert answers(store) == answers(None) and opened == ["00002-m0.avro"]
