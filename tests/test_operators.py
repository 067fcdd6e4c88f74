"""Edge cases of the operators, and invariants on random relations."""

from __future__ import annotations

import datetime as dt
import random
import re
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from metagauge.operators import files as file_ops
from metagauge.operators import health as health_ops
from metagauge.operators import orphans as orphan_ops
from metagauge.operators import partitions as partition_ops
from metagauge.operators import snapshots as snapshot_ops
from metagauge.plans.file_stats import file_stats
from metagauge.plans.running import running_totals
from metagauge.plans.top import top_per_group
from workload import relations as rel

FILES = (
    "table_name STRING, spec_id INT, partition STRUCT<k: STRING>, content INT, record_count BIGINT, "
    "file_size_in_bytes BIGINT"
)
SNAPSHOTS = (
    "table_name STRING, snapshot_id BIGINT, committed_at TIMESTAMP, timestamp_ms BIGINT, parent_id BIGINT, "
    "operation STRING, manifest_list STRING, summary MAP<STRING, STRING>"
)
METRICS = (
    "table_name STRING, partition STRUCT<k: STRING>, data_file_count BIGINT, delete_file_count BIGINT, "
    "total_data_file_size BIGINT, avg_file_size_per_partition DOUBLE"
)


def files(spark, *items):
    return spark.createDataFrame([("t", 0, (k,), c, r, s) for k, c, r, s in items], FILES)


def metrics(spark, sizes, counts=None):
    counts = counts or [1] * len(sizes)
    rows = [("t", (f"p{i}",), n, 0, s, s / n if n else 0.0) for i, (s, n) in enumerate(zip(sizes, counts))]
    return spark.createDataFrame(rows, METRICS)


def snapshot(i, when, summary=None, operation="append", table="t"):
    time = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=when)
    return (table, i, time, when, None, operation, f"m{i}", summary or {})


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


# -- files -------------------------------------------------------------------------------------------------------------


def test_no_delete_files_leaves_all_records(spark):
    got = one(file_ops.live_table_metrics(files(spark, ("a", 0, 10, 100), ("a", 0, 5, 50))))
    assert got["record_count"] == 15 and got["delete_file_size"] == 0 and got["total_delete_files"] == 0


def test_only_delete_files(spark):
    got = one(file_ops.live_table_metrics(files(spark, ("a", 1, 3, 30))))
    assert got["record_count"] == -3 and got["data_file_size"] == 0


def test_equality_deletes_have_columns_of_their_own(spark):
    got = one(file_ops.live_table_metrics(files(spark, ("a", 0, 10, 100), ("a", 2, 4, 7), ("a", 1, 1, 9))))
    assert got["total_files_size"] == 116 and got["delete_file_size"] == 9 and got["record_count"] == 9
    assert got["total_equality_delete_files"] == 1 and got["equality_delete_file_size"] == 7


def test_sizes_beyond_31_bits(spark):
    big = 3 * 2**31
    got = one(file_ops.file_metrics(files(spark, ("a", 0, big, big), ("a", 0, big, big + 2))))
    assert got["avg_file_size"] == big + 1 and got["max_file_size"] == big + 2


def test_both_delete_kinds_share_a_label_and_stay_apart(spark):
    rows = file_ops.file_metrics(files(spark, ("a", 1, 1, 1), ("a", 2, 2, 2), ("a", 0, 3, 3))).collect()
    assert sorted((r.content, r.file_type, r.file_count) for r in rows) == [
        (0, "DATA_FILES", 1),
        (1, "DELETE_FILES", 1),
        (2, "DELETE_FILES", 1),
    ]


def test_share_of_nothing_is_undefined(spark):
    rows = file_ops.live_file_share(file_ops.live_table_metrics(files(spark, ("a", 2, 1, 1)))).collect()
    assert {(r.label, r.file_count, r.share) for r in rows} == {("Data Files", 0, None), ("Delete Files", 0, None)}


def test_comparison_needs_two_types(spark):
    single = file_ops.file_metrics(files(spark, ("a", 0, 1, 1)))
    assert file_ops.file_type_comparison(single).count() == 0


# -- partitions --------------------------------------------------------------------------------------------------------


def test_partition_without_data_files_has_average_zero(spark):
    got = one(partition_ops.partition_metrics(partition_ops.partition_stats(files(spark, ("a", 1, 1, 9), ("a", 2, 1, 9)))))
    assert got["data_file_count"] == 0 and got["delete_file_count"] == 2
    assert got["total_data_file_size"] == 0 and got["avg_file_size_per_partition"] == 0.0


def test_same_partition_under_two_specs(spark):
    stats = "table_name STRING, spec_id INT, partition STRUCT<k: STRING>, record_count BIGINT, file_count BIGINT, "
    stats += "total_data_file_size_in_bytes BIGINT, position_delete_file_count BIGINT, equality_delete_file_count BIGINT"
    rows = [
        ("t", 0, ("a",), 1, 2, 100, 0, 0),
        ("t", 1, ("a",), 1, 2, 300, 0, 0),
        ("t", 2, ("a",), 1, 3, 900, 0, 0),
    ]
    got = partition_ops.partition_metrics(spark.createDataFrame(rows, stats)).collect()
    assert sorted((r.data_file_count, r.total_data_file_size, r.avg_file_size_per_partition) for r in got) == [
        (2, 400, 200.0),
        (3, 900, 300.0),
    ]


def test_many_small_files_come_first(spark):
    ordered = partition_ops.in_report_order(metrics(spark, [100, 900, 40, 40], [1, 3, 3, 1]))
    assert [r.partition.k for r in ordered.collect()] == ["p2", "p1", "p3", "p0"]


def test_single_partition_has_no_sample_skew(spark):
    m = metrics(spark, [1000])
    assert one(partition_ops.partition_skew_sample(m))["skewness"] is None
    assert one(partition_ops.partition_skew_class(partition_ops.partition_skew_sample(m)))["skew_class"] == "balanced"
    assert one(partition_ops.partition_skew_population(m))["skewness"] == 0.0


def test_skew_of_empty_partitions_is_zero(spark):
    m = metrics(spark, [0, 0], [0, 0])
    assert one(partition_ops.partition_skew_sample(m))["skewness"] == 0.0
    assert one(partition_ops.partition_skew_population(m))["skewness"] == 0.0


def test_table_without_partitions_has_population_skew_zero(spark):
    tables = spark.createDataFrame([("nothing",)], "table_name STRING")
    got = one(partition_ops.partition_skew_population(metrics(spark, [1, 2]), tables))
    assert got == {"table_name": "nothing", "skewness": 0.0}


@pytest.mark.parametrize("seed, n, scale", [(1, 1, 10**9), (2, 2, 10**9), (3, 101, 10**12), (4, 400, 10**7), (5, 37, 10**15)])
def test_describe_is_the_exact_one(spark, seed, n, scale):
    rng = random.Random(seed)
    # A third of all partitions share one size.
    sizes = [rng.randrange(scale) if rng.random() < 0.67 else scale // 3 for _ in range(n)]
    got = one(partition_ops.partition_size_describe(metrics(spark, sizes)))
    expected = pd.Series(sizes).apply(lambda s: round(s / 1048576, 2)).describe()
    assert got["count"] == n
    for ours, theirs in (("mean", "mean"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[ours] == pytest.approx(expected[theirs], rel=1e-9)
    assert got["std"] is None if n == 1 else got["std"] == pytest.approx(expected["std"], rel=1e-9)


def test_approximate_quartiles_are_near_in_rank(spark):
    rng = random.Random(8)
    sizes = [rng.randrange(10**12) for _ in range(2000)]
    got = one(partition_ops.partition_size_describe(metrics(spark, sizes), accuracy=100))
    ordered = sorted(round(s / 1048576, 2) for s in sizes)
    for name, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
        assert abs(ordered.index(got[name]) / len(ordered) - q) <= 0.02
    assert (got["count"], got["min"], got["max"]) == (2000, ordered[0], ordered[-1])


def test_distribution_matches_plain_statistics(spark):
    f = files(spark, ("a", 0, 10, 1), ("a", 0, 20, 1), ("b", 0, 5, 1), ("c", 0, 40, 1))
    got = one(partition_ops.partition_distribution(partition_ops.partition_stats(f)))
    records, counts = [30, 5, 40], [2, 1, 1]
    for name, values in (("record_count", records), ("file_count", counts)):
        assert got[f"avg_{name}"] == pytest.approx(statistics.mean(values))
        assert got[f"deviation_{name}"] == pytest.approx(statistics.stdev(values))
        assert got[f"skew_{name}"] == pytest.approx(statistics.stdev(values) / statistics.mean(values))
        assert (got[f"max_{name}"], got[f"min_{name}"]) == (max(values), min(values))


def test_distribution_of_one_partition(spark):
    got = one(partition_ops.partition_distribution(partition_ops.partition_stats(files(spark, ("a", 0, 10, 1)))))
    assert got["deviation_record_count"] == 0.0 and got["skew_file_count"] == 0.0


def test_histogram_closes_the_last_bin(spark):
    rows = partition_ops.partition_file_histogram(metrics(spark, [1] * 41, list(range(41)))).collect()
    assert sum(r.partitions for r in rows) == 41
    assert max(r.bin for r in rows) == 20 and {r.partitions for r in rows} == {2, 3}
    equal = partition_ops.partition_file_histogram(metrics(spark, [1] * 5, [7] * 5))
    assert [(r.bin, r.bin_start, r.bin_end, r.partitions) for r in equal.collect()] == [(1, 7.0, 7.0, 5)]


def test_top_partitions_settle_ties_by_label(spark):
    # All round to the same MB.
    rows = partition_ops.top_partitions_by_size(metrics(spark, [1000 + i for i in range(30)]), 10).collect()
    labels = sorted(f"k=p{i}" for i in range(30))[:10]
    assert [r.partition_label for r in sorted(rows, key=lambda r: r.rank)] == labels


def test_display_texts(spark):
    got = one(partition_ops.partition_display(metrics(spark, [5_000_000_131_072], [3])))
    assert got["total_data_size_mb"] == f"{round(5_000_000_131_072 / 1048576, 2):,.2f} MB" and got["k"] == "p0"


# -- snapshots ---------------------------------------------------------------------------------------------------------


def test_snapshot_id_zero_is_a_snapshot(spark):
    tables = spark.createDataFrame([("t", 0), ("none", None)], "table_name STRING, current_snapshot_id BIGINT")
    s = spark.createDataFrame([snapshot(0, 1, {"added-records": "5"})], SNAPSHOTS)
    rows = {r.table_name: (r.added_records, r.operation) for r in snapshot_ops.latest_snapshot_metrics(tables, s).collect()}
    assert rows == {"t": (5, "append"), "none": (0, "")}


def test_table_pointing_at_a_missing_snapshot(spark):
    tables = spark.createDataFrame([("t", 99)], "table_name STRING, current_snapshot_id BIGINT")
    s = spark.createDataFrame([snapshot(1, 1, {"added-records": "5"})], SNAPSHOTS)
    assert one(snapshot_ops.latest_snapshot_metrics(tables, s))["operation"] == ""


def test_history_settles_equal_times_by_id(spark):
    s = spark.createDataFrame([snapshot(i, 1000) for i in range(40)], SNAPSHOTS)
    history = snapshot_ops.history_in_order(snapshot_ops.historical_snapshots(s, 3))
    assert [r.snapshot_id for r in history.collect()] == [39, 38, 37]


def test_timeline_links_to_the_next_older(spark):
    s = spark.createDataFrame([snapshot(i, i * 1000) for i in (1, 2, 3)], SNAPSHOTS)
    rows = snapshot_ops.snapshot_timeline(snapshot_ops.historical_snapshots(s, 3)).collect()
    links = {r.snapshot_id: r.linked_timestamp and r.linked_timestamp.second for r in rows}
    assert links == {3: 2, 2: 1, 1: None}


def test_trend_keeps_the_history_unchanged(spark):
    s = spark.createDataFrame([snapshot(1, 0, {"total-files-size": "3145728", "added-records": "4"})], SNAPSHOTS)
    history = snapshot_ops.historical_snapshots(s, 3)
    before = history.schema
    assert one(snapshot_ops.snapshot_trends(history))["total_files_size_mb"] == 3.0
    rows = {r.metric_type: r["count"] for r in snapshot_ops.snapshot_record_trend(history).collect()}
    assert rows == {"Added Records": 4, "Deleted Records": 0} and history.schema == before


def test_detail_of_a_given_snapshot(spark):
    s = spark.createDataFrame([snapshot(i, i, {"added-records": str(i)}) for i in (1, 2)], SNAPSHOTS)
    history = snapshot_ops.historical_snapshots(s)
    assert one(snapshot_ops.snapshot_detail(history, 1))["added_records"] == 1
    assert one(snapshot_ops.snapshot_detail(history))["added_records"] == 2


def test_snapshots_without_file_changes_are_left_out(spark):
    s = spark.createDataFrame(
        [snapshot(1, 1, {"added-records": "5"}), snapshot(2, 2, {"removed-delete-files": "1"})], SNAPSHOTS
    )
    kept = snapshot_ops.snapshots_with_file_changes(snapshot_ops.snapshot_summary_metrics(s))
    assert one(kept)["snapshot_id"] == 2


def test_expiry_takes_a_time_or_milliseconds(spark):
    as_of = dt.datetime(2024, 3, 1)
    edge = int((as_of - dt.timedelta(days=30) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    s = spark.createDataFrame([snapshot(1, edge - 1), snapshot(2, edge), snapshot(3, edge + 1)], SNAPSHOTS)
    assert [r.snapshot_id for r in snapshot_ops.expirable_snapshots(s, as_of).collect()] == [1]
    aware = as_of.replace(tzinfo=dt.timezone.utc)
    assert [r.snapshot_id for r in snapshot_ops.expirable_snapshots(s, aware).collect()] == [1]
    assert snapshot_ops.expirable_snapshots(s, edge + 2, days=0).count() == 3


def test_malformed_summaries_are_listed(spark):
    s = spark.createDataFrame(
        [snapshot(1, 1, {"added-records": "many", "engine": "x"}), snapshot(2, 2, {"added-records": "3"})], SNAPSHOTS
    )
    got = one(snapshot_ops.summary_errors(s))
    assert (got["snapshot_id"], got["key"], got["value"]) == (1, "added-records", "many")


# -- orphans and health ------------------------------------------------------------------------------------------------


def test_orphans_ignore_spelling_and_metadata(spark):
    listing = spark.createDataFrame(
        [
            ("file:/lake/t/data/a.parquet",),
            ("file:/lake/t/data/stray.avro",),
            ("file:/lake/t/metadata/v1.metadata.json",),
            ("file:/lake/t/metadata/.v1.metadata.json.crc",),
            ("file:/lake/t/metadata/snap-1.avro",),
            ("file:/lake/t/metadata/.snap-1.avro.crc",),
            ("file:/lake/t/metadata/version-hint.text",),
        ],
        "file_path STRING",
    )
    data = spark.createDataFrame([("file:///lake/t/data/a.parquet",)] * 2, "file_path STRING")
    documents = spark.createDataFrame([("/lake/t/metadata/v1.metadata.json",)], "file_path STRING")
    known = orphan_ops.referenced_files(data, documents)
    found = {r.file_path.rsplit("/", 1)[1] for r in orphan_ops.orphan_files(listing, known).collect()}
    assert found == {"stray.avro", "snap-1.avro", ".snap-1.avro.crc"}
    assert orphan_ops.orphan_files(listing, data).count() == 5


def test_age_of_orphans_does_not_follow_the_session_zone(spark):
    listing = spark.sql("SELECT '/a' file_path, timestamp_seconds(1000000000) modified")
    none = spark.createDataFrame([], "file_path STRING")
    moment = dt.datetime(2001, 9, 9, 1, 46, 40)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        after = moment + dt.timedelta(microseconds=1)
        counts = [orphan_ops.orphan_files(listing, none, m).count() for m in (moment, after)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert counts == [0, 1]


def test_health_of_a_table_without_anything(spark):
    tables = spark.createDataFrame([("nothing",)], "table_name STRING")
    nobody = spark.createDataFrame([], "table_name STRING")
    got = one(health_ops.health_summary(tables, metrics(spark, [1]), nobody, nobody))
    assert got["total_files"] == 0 and got["average_partition_size_bytes"] == 0.0
    assert got["total_size_text"] == "0.00 B" and got["orphan_file_count"] == 0


# -- plans and invariants ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def random_files(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        # Table t0 holds a third of all files.
        table = "t0" if rng.random() < 0.33 else f"t{rng.randrange(1, 8)}"
        key = rng.choice(["a", "b", "c", None, f"k{rng.randrange(50)}"])
        rows.append((table, rng.randrange(2), (key,), rng.choice([0, 0, 0, 1, 2]), rng.randrange(10**6), rng.randrange(10**10)))
    return spark.createDataFrame(rows, FILES).cache()


def same(a, b):
    def plain(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    assert a.columns == b.columns and plain(a) == plain(b)


def test_rollup_equals_direct_aggregation(random_files):
    stats = file_stats(random_files)
    same(file_ops.live_table_metrics(stats), file_ops.live_table_metrics(random_files))
    same(file_ops.file_metrics(stats), file_ops.file_metrics(random_files))
    same(partition_ops.partition_stats(stats), partition_ops.partition_stats(random_files))


def test_partition_totals_agree_with_live_metrics(random_files):
    # Under one spec: equal rows of two specs merge, and the counts with them.
    one_spec = random_files.withColumn("spec_id", F.lit(0))
    m = partition_ops.partition_metrics(partition_ops.partition_stats(one_spec))
    totals = partition_ops.partition_totals(m).select("table_name", "total_data_files", "total_data_size")
    live = file_ops.live_table_metrics(random_files).select(
        "table_name", "total_data_files", F.col("data_file_size").alias("total_data_size")
    )
    same(totals, live)


def test_one_table_alone_gives_its_fleet_result(random_files):
    def describe(f):
        return partition_ops.partition_size_describe(partition_ops.partition_metrics(partition_ops.partition_stats(f)))

    alone = describe(random_files.where("table_name = 't0'")).collect()[0].asDict()
    fleet = describe(random_files).where("table_name = 't0'").collect()[0].asDict()
    # Moments depend on the order of addition in their last digits.
    assert {k: pytest.approx(v, rel=1e-12) if k != "table_name" else v for k, v in fleet.items()} == alone


def test_running_totals_with_and_without_buckets(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(4)}", i // 50, i % 50 // 7, i, rng.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "g STRING, a INT, b INT, i INT, x BIGINT")
    expected, total, last = [], {}, {}
    for g, a, b, i, x in rows:
        total[g] = total.get(g, 0) + x
        expected.append((g, a, b, i, x, total[g], last.get(g)))
        last[g] = i
    for buckets in ([], ["a"], ["a", "b"]):
        got = running_totals(df, ["g"], buckets, "i", {"x": "upto"}, {"i": "before"})
        assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_top_rows_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else "cold", i, {"m": str(i)}) for i in range(900)]
    df = spark.createDataFrame(rows, "g STRING, i INT, m MAP<STRING,STRING>")
    for limit in (1, 40, 2000):
        found = top_per_group(df, "g", [F.desc("i")], limit)
        assert found.columns == df.columns
        expected = []
        for g in ("hot", "cold"):
            expected += sorted([(k, i) for k, i, _ in rows if k == g], key=lambda x: -x[1])[:limit]
        assert sorted(tuple(r) for r in found.select("g", "i").collect()) == sorted(expected)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_cuts_before_the_shuffle(spark):
    s = spark.createDataFrame([snapshot(1, 1)], SNAPSHOTS)
    plan = plan_of(snapshot_ops.historical_snapshots(s, 20))
    assert "row_number(), 20, Partial" in plan and plan.count("Exchange") == 2


def test_no_python_and_no_cross_join_in_any_plan(spark):
    from workload.queries import QUERIES

    for name, query in QUERIES.items():
        plan = plan_of(query(spark, "/root/testdata/sf0.001"))
        for word in ("Python", "MapInArrow", "CartesianProduct", "BroadcastNestedLoop"):
            assert word not in plan, (name, word)


def test_scans_read_only_needed_columns(spark):
    from workload.queries import QUERIES

    plan = plan_of(QUERIES["live_table_metrics"](spark, "/root/testdata/sf0.001"))
    read = plan.split("ReadSchema: ", 1)[1].split(">", 1)[0]
    assert "l_quantity" in read and "l_tax" not in read and "l_linestatus" not in read


def test_ancestry_protects_what_branches_keep(spark):
    import random

    from metagauge.operators import snapshots as ops

    rnd = random.Random(3)
    parents = {}
    for t in range(4):
        for i in range(1, 120):
            # A tree: mostly a line, with forks, several roots, and parents that are gone.
            parents[t, i] = None if i % 50 == 1 else (999 if i % 47 == 0 else max(1, i - rnd.choice([1, 1, 1, 2, 9])))
    heads = [(t, rnd.randrange(60, 120), rnd.choice([1, 2, 7, 8, 33, 500])) for t in range(4) for _ in range(3)] + [(0, 777, 5)]
    expected = set()
    for t, head, keep in heads:
        at = head
        while keep and (t, at) in parents:
            expected.add((f"t{t}", at))
            at, keep = parents[t, at], keep - 1
    chain = spark.createDataFrame(
        [(f"t{t}", i, p) for (t, i), p in parents.items()], "table_name STRING, snapshot_id BIGINT, parent_id BIGINT"
    )
    ends = spark.createDataFrame([(f"t{t}", h, k) for t, h, k in heads], "table_name STRING, snapshot_id BIGINT, keep INT")
    found = [tuple(r) for r in ops.ancestors_within(chain, ends).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert ops.ancestors_within(chain, ends.limit(0)).count() == 0


def test_a_branch_without_a_number_keeps_the_default(spark):
    from metagauge.operators import snapshots as ops

    branches = "table_name STRING, branches ARRAY<STRUCT<name: STRING, snapshot_id: BIGINT, keep: INT>>"
    tables = spark.createDataFrame([("a", [("main", 3, None), ("dev", 2, 9), ("gone", None, 4)]), ("b", None)], branches)
    assert sorted(tuple(r) for r in ops.branch_heads(tables, 5).collect()) == [("a", 2, 9), ("a", 3, 5)]


def test_changes_of_an_order_group_by_order_not_by_month(spark, tmp_path):
    days = [f"{y}-{m:02}-15" for y in range(1985, 2002) for m in range(1, 13)]  # 204 months, of three spans
    days += ["1969-12-31", "1970-01-01", "1970-01-31", "1980-08-31", "1980-09-01", "0001-01-01", "9999-12-31", None, None]
    lines = [(1, i % 7 + 1, "R" if i % 2 else "A", 2.0, 0.25, d) for i, d in enumerate(days)]
    lines += [(2, 1, "N", 1.0, 1.5, "1975-04-30"), (2, 2, "N", 1.0, 1.5, "1975-05-01"), (2, 6, "N", 1.0, 1.5, "1975-05-31")]
    lines += [(3, 1, "N", 4.0, 2.0, None)]
    columns = "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, l_quantity DOUBLE, l_extendedprice DOUBLE, d STRING"
    df = spark.createDataFrame(lines, columns)
    df.withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")

    changes = rel.order_changes(spark, str(tmp_path))
    names = ("added_data_files", "deleted_data_files", "added_records", "bytes", "changed_partition_count")
    got = {r.l_orderkey: tuple(r[n] for n in names) for r in changes.collect()}
    one = [x for x in lines if x[0] == 1]
    months = 204 + 7 - 1 + 1  # 1970-01 twice; no date is one more
    assert got[1] == (sum(x[1] <= 5 for x in one), sum(x[2] == "R" for x in one), 2 * len(one), 25 * len(one), months)
    assert got[2][4] == 2 and got[3] == (1, 0, 4, 200, 1)
    # Of 213 lines two meet in the first step by order and month; by spans of 128 months they are a few rows.
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and " AS month" in plan and "bit_or(" in plan


def test_lines_are_dealt_out_by_the_size_of_their_file(spark, tmp_path, monkeypatch):
    spark.range(10_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rel._parts(spark, str(tmp_path), "lineitem") == spark.sparkContext.defaultParallelism
    size = sum(f.stat().st_size for f in (tmp_path / "lineitem.parquet").glob("*") if f.is_file())
    monkeypatch.setattr(rel, "_PART_BYTES", 1_000)
    assert size // 1_000 <= rel._parts(spark, str(tmp_path), "lineitem") <= size // 1_000 + 20


def test_tasks_of_commits_follow_the_size_of_the_file_not_the_session(spark, tmp_path, monkeypatch):
    # Order 1 has 2,005 lines of halves in four spans of months, the same months in every task; others have one line.
    days = ("1965-03-01", "1975-03-01", "1985-03-01", "1999-03-01", "1999-04-01")
    hot = [(1, i % 7 + 1, "R" if i % 2 else "N", 0.5, 0.01 * i, days[i % 5]) for i in range(2_005)]
    lines = hot + [(k, 1, "N", 1.0, 2.0, days[k % 5]) for k in range(2, 500)]
    columns = "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, l_quantity DOUBLE, l_extendedprice DOUBLE, d STRING"
    df = spark.createDataFrame(lines, columns)
    df.withColumn("l_shipdate", F.col("d").cast("timestamp_ntz")).drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(1, 600).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "TIMESTAMP_NTZ '1999-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(rel, "_PART_BYTES", 500)
    parts = rel._parts(spark, str(tmp_path), "lineitem")
    assert parts > 20

    commits = rel.commits(spark, str(tmp_path))
    dealt = re.findall(r"hashpartitioning\(.*, (\d+)\)", commits._jdf.queryExecution().executedPlan().toString())
    assert len(dealt) == 3 and {int(n) for n in dealt} == {parts}
    got = {r.snapshot_id: r.summary for r in commits.collect()}
    assert len(got) == 599 and got[550] == {}
    assert got[2]["added-records"] == "1" and got[2]["changed-partition-count"] == "1"
    one = {"added-records": "1002", "deleted-records": "501", "changed-partition-count": "5", "deleted-data-files": "1002"}
    assert {k: got[1][k] for k in one} == one
    # Halves of different spans are added up before they are cut to whole numbers.
    changes = rel.order_changes(spark, str(tmp_path)).where("l_orderkey = 1").first()
    assert (changes.added_data_files, changes.bytes) == (sum(x[1] <= 5 for x in hot), sum(range(2_005)))


def test_tasks_of_commits_follow_the_rows_of_a_file_that_repeats_its_values(spark, tmp_path, monkeypatch):
    # 12,000 orders of five equal lines: a few bytes each.
    lines = spark.range(60_000).selectExpr(
        "id DIV 5 AS l_orderkey", "CAST(id % 5 + 1 AS INT) AS l_linenumber", "'R' AS l_returnflag", "2D AS l_quantity",
        "0.25D AS l_extendedprice", "TIMESTAMP_NTZ '1999-03-01' AS l_shipdate",
    )
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.range(12_000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "TIMESTAMP_NTZ '1999-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(rel, "_PART_ROWS", 1_500, raising=False)
    assert rel._parts(spark, str(tmp_path), "lineitem") == 40
    commits = rel.commits(spark, str(tmp_path))
    dealt = re.findall(r"hashpartitioning\(.*, (\d+)\)", commits._jdf.queryExecution().executedPlan().toString())
    assert dealt == ["40"] * 3
    got = commits.selectExpr("summary['added-records'] AS n", "summary['deleted-data-files'] AS d").groupBy("n", "d").count()
    assert [tuple(r) for r in got.collect()] == [("10", "5", 12_000)]

    # Few tasks group more rows each, up to the most.
    monkeypatch.setattr(rel, "_FEW_PARTS", 20)
    assert rel._parts(spark, str(tmp_path), "lineitem") == 20
    monkeypatch.setattr(rel, "_MOST_ROWS", 2_000)
    assert rel._parts(spark, str(tmp_path), "lineitem") == 30
