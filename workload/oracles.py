"""SQL twins of the registered queries, for DuckDB over the benchmark tables."""

from __future__ import annotations

# The derived relations, each built on the ones before it.
RELATIONS = {
    "fx_entries": """
        SELECT concat('data/', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '.parquet') AS file_path,
               concat('t', CAST(l_orderkey % 20 AS VARCHAR)) AS table_name,
               CASE WHEN min(year(l_shipdate) * 100 + month(l_shipdate)) >= 200110 OR l_linenumber = 6 THEN 1
                    WHEN l_linenumber = 7 THEN 2 ELSE 0 END AS content,
               CASE WHEN l_orderkey % 17 = 0 THEN 2 ELSE 1 END AS status,
               l_orderkey AS snapshot_id,
               min(l_linestatus) AS part_status,
               CAST(min(year(l_shipdate) * 100 + month(l_shipdate)) AS INT) AS part_month,
               CAST(sum(l_quantity) AS BIGINT) AS record_count,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS file_size_in_bytes
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_files": "SELECT * FROM fx_entries WHERE status <> 2",
    "fx_lake": """
        SELECT *, concat('db', CAST(number % 4 AS VARCHAR), '.t', CAST(number AS VARCHAR)) AS table_name,
               concat(line_status, '-', CAST(year AS VARCHAR), '.parquet') AS file_name, number % 7 = 3 AS broken,
               year >= 1996 AND year <> 2000 AS live, record_count % 97 + 1 AS length
        FROM (SELECT l_orderkey % 20 AS number, l_linestatus AS line_status,
                     year(l_shipdate) AS year, count(*) AS record_count FROM lineitem GROUP BY ALL)""",
    "fx_partitions": """
        SELECT table_name, part_status, part_month,
               count(*) FILTER (WHERE content = 0) AS file_count,
               count(*) FILTER (WHERE content = 1) AS position_delete_file_count,
               count(*) FILTER (WHERE content = 2) AS equality_delete_file_count,
               CAST(sum(CASE WHEN content = 0 THEN record_count ELSE 0 END) AS BIGINT) AS record_count,
               CAST(sum(CASE WHEN content = 0 THEN file_size_in_bytes ELSE 0 END) AS BIGINT)
                   AS total_data_file_size_in_bytes
        FROM fx_files GROUP BY table_name, part_status, part_month""",
    "fx_partition_metrics": """
        SELECT *, CASE WHEN data_file_count > 0 THEN total_data_file_size / data_file_count ELSE 0.0 END
                      AS avg_file_size_per_partition
        FROM (SELECT table_name, part_status, part_month, file_count AS data_file_count,
                     position_delete_file_count + equality_delete_file_count AS delete_file_count,
                     CAST(sum(total_data_file_size_in_bytes) AS BIGINT) AS total_data_file_size
              FROM fx_partitions GROUP BY ALL)""",
    "fx_order_changes": """
        SELECT l_orderkey,
               count(*) FILTER (WHERE l_linenumber <= 5) AS added_data_files,
               count(*) FILTER (WHERE l_returnflag = 'R') AS deleted_data_files,
               count(*) FILTER (WHERE l_linenumber >= 6) AS added_delete_files,
               count(*) FILTER (WHERE l_linenumber >= 6 AND l_returnflag = 'A') AS removed_delete_files,
               CAST(sum(l_quantity) AS BIGINT) AS added_records,
               CAST(sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS deleted_records,
               count(DISTINCT year(l_shipdate) * 100 + month(l_shipdate)) AS changed_partition_count,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS bytes
        FROM lineitem GROUP BY l_orderkey""",
    "fx_snapshots": """
        SELECT concat('t', CAST(o_custkey % 20 AS VARCHAR)) AS table_name,
               o_orderkey AS snapshot_id, o_orderdate AS committed_at,
               lag(o_orderkey) OVER w AS parent_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'append' WHEN '2-HIGH' THEN 'overwrite'
                    WHEN '3-MEDIUM' THEN 'replace' WHEN '4-NOT SPECIFIED' THEN 'delete' ELSE 'rewrite' END AS operation,
               added_data_files, deleted_data_files, added_delete_files, removed_delete_files,
               concat('metadata/snap-', CAST(o_orderkey AS VARCHAR), '.avro') AS manifest_list,
               added_records, deleted_records, changed_partition_count,
               CAST(sum(added_data_files) OVER w AS BIGINT) AS total_data_files,
               CAST(sum(added_delete_files) OVER w AS BIGINT) AS total_delete_files,
               CAST(sum(bytes) OVER w * 100 AS BIGINT) AS total_files_size
        FROM orders LEFT JOIN fx_order_changes ON l_orderkey = o_orderkey
        WINDOW w AS (PARTITION BY o_custkey % 20 ORDER BY o_orderdate, o_orderkey)""",
    "fx_metrics": """
        SELECT table_name, snapshot_id, committed_at, parent_id, operation, added_data_files IS NULL AS no_metrics,
               coalesce(added_data_files, 0) AS added_data_files,
               coalesce(deleted_data_files, 0) AS deleted_data_files,
               coalesce(added_delete_files, 0) AS added_delete_files,
               coalesce(removed_delete_files, 0) AS removed_delete_files,
               coalesce(added_records, 0) AS added_records,
               coalesce(deleted_records, 0) AS deleted_records,
               coalesce(changed_partition_count, 0) AS changed_partition_count,
               coalesce(total_data_files, 0) AS total_data_files,
               coalesce(total_delete_files, 0) AS total_delete_files,
               coalesce(total_files_size, 0) AS total_files_size,
               row_number() OVER (PARTITION BY table_name ORDER BY committed_at DESC, snapshot_id DESC) AS age
        FROM fx_snapshots""",
    "fx_history": "SELECT * FROM fx_metrics WHERE age <= 20",
    "fx_tables": """
        SELECT table_name, snapshot_id AS current_snapshot_id FROM fx_metrics WHERE age = 1
        UNION ALL SELECT 't_empty', CAST(NULL AS BIGINT)""",
    "fx_storage": """
        SELECT table_name, file_path, file_size_in_bytes FROM fx_entries
        UNION ALL
        SELECT concat('t', CAST(c_custkey % 20 AS VARCHAR)), concat('data/stray-', CAST(c_custkey AS VARCHAR), '.parquet'),
               CAST(c_custkey AS BIGINT)
        FROM customer""",
    "fx_referenced": "SELECT DISTINCT file_path FROM fx_entries WHERE part_month >= 199503",
    "fx_live": """
        SELECT table_name,
               count(*) FILTER (WHERE content = 0) AS total_data_files,
               count(*) FILTER (WHERE content = 1) AS total_delete_files,
               CAST(sum(file_size_in_bytes) AS BIGINT) AS total_files_size,
               CAST(coalesce(sum(file_size_in_bytes) FILTER (WHERE content = 0), 0) AS BIGINT) AS data_file_size,
               CAST(coalesce(sum(file_size_in_bytes) FILTER (WHERE content = 1), 0) AS BIGINT) AS delete_file_size,
               CAST(coalesce(sum(record_count) FILTER (WHERE content = 0), 0)
                    - coalesce(sum(record_count) FILTER (WHERE content = 1), 0) AS BIGINT) AS record_count,
               count(*) FILTER (WHERE content = 2) AS total_equality_delete_files,
               CAST(coalesce(sum(file_size_in_bytes) FILTER (WHERE content = 2), 0) AS BIGINT)
                   AS equality_delete_file_size
        FROM fx_files GROUP BY table_name""",
    "fx_file_metrics": """
        SELECT table_name, content,
               CASE WHEN content = 0 THEN 'DATA_FILES' ELSE 'DELETE_FILES' END AS file_type,
               count(*) AS file_count,
               CAST(avg(record_count) AS BIGINT) AS avg_record_count,
               max(record_count) AS max_record_count, min(record_count) AS min_record_count,
               CAST(avg(file_size_in_bytes) AS BIGINT) AS avg_file_size,
               max(file_size_in_bytes) AS max_file_size, min(file_size_in_bytes) AS min_file_size
        FROM fx_files GROUP BY table_name, content""",
    "fx_placed": """
        SELECT table_name, snapshot_id,
               row_number() OVER (PARTITION BY table_name ORDER BY committed_at, snapshot_id) AS place
        FROM fx_snapshots""",
    "fx_expirable": """
        SELECT table_name, snapshot_id, epoch_ms(committed_at) AS timestamp_ms, committed_at, manifest_list
        FROM fx_snapshots
        WHERE epoch_ms(committed_at) < epoch_ms(TIMESTAMP '2001-08-01 00:00:00') - CAST(30 AS BIGINT) * 86400000""",
}

MB = "1048576"
_LABEL = "concat('part_status=', part_status, ', part_month=', CAST(part_month AS VARCHAR))"
_CLASS = "CASE WHEN operation IN ('append', 'replace', 'overwrite', 'delete') THEN operation ELSE 'other' END"
_COLOUR = (
    "CASE operation WHEN 'append' THEN '#2ca02c' WHEN 'replace' THEN '#d62728' WHEN 'overwrite' THEN '#ff7f0e' "
    "WHEN 'delete' THEN '#9467bd' ELSE '#1f77b4' END"
)
_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_CHANGES = (
    "added_data_files, deleted_data_files, added_delete_files, removed_delete_files, "
    "added_records, deleted_records, changed_partition_count"
)
_DATABASE = "concat('db', CAST(CAST(substr(table_name, 2) AS INT) % 4 AS VARCHAR))"
_LOCATION = f"concat('/lake/', {_DATABASE}, '/', table_name)"
_DOCUMENT = f"concat({_LOCATION}, '/metadata/v', CAST(snapshot_id AS VARCHAR), '.metadata.json')"


def _bytes_text(size: str) -> str:
    cases = []
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        scaled = f"{size} / {1024.0 ** power}"
        cases.append(f"WHEN {scaled} < 1024 THEN printf('%.2f {unit}', CAST({scaled} AS DOUBLE))")
    return f"CASE {' '.join(cases)} ELSE printf('%.2f PB', {size} / {1024.0 ** 5}) END"


def _mb(size: str) -> str:
    return f"round_even({size} / {MB}, 2)"


def _grouped(value: str) -> str:
    return f"format('{{:,.2f}}', CAST({value} AS DOUBLE))"


def _spread(column: str) -> str:
    return f"""
        round(avg({column}), 6) AS avg_{column}, max({column}) AS max_{column}, min({column}) AS min_{column},
        round(coalesce(stddev_samp({column}), 0), 6) AS deviation_{column},
        round(CASE WHEN avg({column}) <> 0 THEN coalesce(stddev_samp({column}), 0) / avg({column}) ELSE 0 END, 9)
            AS skew_{column}"""


_SKEW = "round(CASE WHEN avg(total_data_file_size) > 0 THEN {0}(total_data_file_size) / avg(total_data_file_size) ELSE 0 END, 9)"
_SKEW_SAMPLE = f"SELECT table_name, {_SKEW.format('stddev_samp')} AS skewness FROM fx_partition_metrics GROUP BY table_name"
_SKEW_POPULATION = f"SELECT table_name, {_SKEW.format('stddev_pop')} AS skewness FROM fx_partition_metrics GROUP BY table_name"

_DESCRIBE = f"""
    SELECT table_name, count(*) AS count, avg(mb) AS mean, stddev_samp(mb) AS std, min(mb) AS min,
           quantile_cont(mb, 0.25) AS p25, quantile_cont(mb, 0.5) AS p50, quantile_cont(mb, 0.75) AS p75, max(mb) AS max
    FROM (SELECT table_name, {_mb('total_data_file_size')} AS mb FROM fx_partition_metrics) GROUP BY table_name"""

# Quartiles by hand, from the nearer neighbour: as texts they show the last digit.
_SORTED = f"""
    SELECT table_name, count(*) AS count, avg(mb) AS mean, stddev_samp(mb) AS std, min(mb) AS min, max(mb) AS max,
           list(mb ORDER BY mb) AS mbs
    FROM (SELECT table_name, {_mb('total_data_file_size')} AS mb FROM fx_partition_metrics) GROUP BY table_name"""


def _quartile(q: float) -> str:
    position = f"((count - 1) * CAST({q} AS DOUBLE))"
    low, high = f"mbs[CAST(floor{position} AS BIGINT) + 1]", f"mbs[CAST(ceil{position} AS BIGINT) + 1]"
    part = f"({position} - floor{position})"
    return f"""CASE WHEN {part} < 0.5 THEN {low} + ({high} - {low}) * {part}
                    ELSE {high} - ({high} - {low}) * (1 - {part}) END"""


_BODIES = {
    # sources
    "src_files_live": """
        SELECT table_name,
               snapshot_id,
               status, content, file_path, 'PARQUET' AS file_format, 0 AS spec_id, part_status,
               concat(substr(CAST(part_month AS VARCHAR), 1, 4), '-', substr(CAST(part_month AS VARCHAR), 5, 2))
                   AS part_month,
               record_count, file_size_in_bytes
        FROM (SELECT f.* REPLACE (CASE WHEN content <> 0 THEN current_snapshot_id ELSE snapshot_id END
                                  AS snapshot_id)
              FROM fx_files f JOIN fx_tables USING (table_name))""",
    "src_snapshots": f"""
        SELECT table_name, snapshot_id, parent_id, committed_at, epoch_ms(committed_at) AS timestamp_ms, operation,
               manifest_list, {_CHANGES}
        FROM (SELECT m.* REPLACE (CAST(NULL AS BIGINT) AS parent_id), s.manifest_list
              FROM fx_metrics m JOIN fx_snapshots s USING (snapshot_id)) WHERE NOT no_metrics""",
    "src_metadata_json": f"""
        SELECT table_name, {_DOCUMENT} AS metadata_location, concat('uuid-', table_name) AS table_uuid,
               {_LOCATION} AS location, 2 AS format_version, snapshot_id AS current_snapshot_id
        FROM fx_metrics WHERE NOT no_metrics""",
    "src_catalog_load": f"""
        SELECT {_DATABASE} AS database, table_name AS name, max(snapshot_id) AS version,
               concat('/lake/', {_DATABASE}, '/', table_name, '/metadata/v', CAST(max(snapshot_id) AS VARCHAR),
                      '.metadata.json') AS metadata_location
        FROM fx_metrics GROUP BY table_name""",
    "catalog_inventory": f"""
        SELECT {_DATABASE} AS database, table_name AS name, {_LOCATION} AS location, operation AS owner,
               'part_month' AS partition_keys, 'id long, shipped date' AS schema
        FROM fx_metrics WHERE NOT no_metrics""",
    "fleet_errors": f"""
        SELECT table_name, {_DOCUMENT} AS metadata_location FROM fx_metrics WHERE no_metrics""",
    "src_partitions": "SELECT * FROM fx_partitions",
    "src_referenced_files": "SELECT file_path FROM fx_referenced",
    "fleet_newest_metrics": """
        SELECT table_name, added_data_files, deleted_data_files, added_delete_files, removed_delete_files, added_records,
               deleted_records, changed_partition_count, operation
        FROM fx_metrics m WHERE NOT no_metrics
          AND snapshot_id = (SELECT max(snapshot_id) FROM fx_metrics s WHERE s.table_name = m.table_name)""",
    "src_shared_manifests": """
        SELECT concat(prefix, e.table_name) AS table_name, spec_id, count(*) AS entry_count,
               CAST(sum(record_count) AS BIGINT) AS record_count
        FROM fx_entries e JOIN fx_tables t ON t.table_name = e.table_name AND current_snapshot_id IS NOT NULL
        CROSS JOIN (SELECT '' AS prefix, 0 AS spec_id UNION ALL SELECT 'copy_of_', 1)
        GROUP BY ALL""",
    "src_storage_listing": "SELECT file_path, file_size_in_bytes AS length FROM fx_storage",
    "current_snapshot": """
        SELECT t.table_name, current_snapshot_id, s.snapshot_id, s.committed_at, s.operation, s.manifest_list
        FROM fx_tables t LEFT JOIN fx_snapshots s ON s.table_name = t.table_name AND snapshot_id = current_snapshot_id""",
    # files
    "live_table_metrics": "SELECT * FROM fx_live",
    "fleet_live_metrics": """
        SELECT table_name, coalesce(total_data_files, 0) AS total_data_files,
               coalesce(total_delete_files, 0) AS total_delete_files,
               coalesce(total_files_size, 0) AS total_files_size, coalesce(data_file_size, 0) AS data_file_size,
               coalesce(delete_file_size, 0) AS delete_file_size, coalesce(record_count, 0) AS record_count,
               coalesce(total_equality_delete_files, 0) AS total_equality_delete_files,
               coalesce(equality_delete_file_size, 0) AS equality_delete_file_size
        FROM fx_tables LEFT JOIN fx_live USING (table_name)""",
    "lake_live_metrics": """
        SELECT table_name, count(*) FILTER (WHERE live) AS total_data_files, CAST(0 AS BIGINT) AS total_delete_files,
               CAST(coalesce(sum(length) FILTER (WHERE live), 0) AS BIGINT) AS total_files_size,
               CAST(coalesce(sum(length) FILTER (WHERE live), 0) AS BIGINT) AS data_file_size,
               CAST(0 AS BIGINT) AS delete_file_size,
               CAST(coalesce(sum(record_count) FILTER (WHERE live), 0) AS BIGINT) AS record_count,
               CAST(0 AS BIGINT) AS total_equality_delete_files, CAST(0 AS BIGINT) AS equality_delete_file_size
        FROM fx_lake WHERE NOT broken GROUP BY table_name
        UNION ALL SELECT 'db0.t_empty', 0, 0, 0, 0, 0, 0, 0, 0""",
    "lake_partition_metrics": """
        SELECT table_name, concat('line_status=', line_status, ', shipped_year=', CAST(year AS VARCHAR))
                   AS partition_label,
               CAST(1 AS BIGINT) AS data_file_count, length AS total_data_file_size
        FROM fx_lake WHERE live AND NOT broken""",
    "lake_listing": "SELECT table_name, file_name, length FROM fx_lake",
    "lake_orphans": "SELECT table_name, file_name, length FROM fx_lake WHERE year = 2000 AND NOT broken",
    "lake_errors": "SELECT DISTINCT table_name, 'm2.avro' AS file_name FROM fx_lake WHERE broken",
    "live_size_mb": f"""
        SELECT table_name, total_files_size / {MB} AS total_files_mb, data_file_size / {MB} AS data_file_mb,
               delete_file_size / {MB} AS delete_file_mb FROM fx_live""",
    "live_file_share": """
        SELECT table_name, label, file_count,
               CASE WHEN both_kinds > 0 THEN file_count / both_kinds END AS share
        FROM (SELECT table_name, 'Data Files' AS label, total_data_files AS file_count,
                     total_data_files + total_delete_files AS both_kinds FROM fx_live
              UNION ALL
              SELECT table_name, 'Delete Files', total_delete_files, total_data_files + total_delete_files FROM fx_live)""",
    "file_metrics": "SELECT * FROM fx_file_metrics",
    "live_display": f"""
        SELECT table_name, total_data_files, total_delete_files,
               printf('%.2f MB', total_files_size / {MB}) AS total_files_size,
               printf('%.2f MB', data_file_size / {MB}) AS data_file_size,
               printf('%.2f MB', delete_file_size / {MB}) AS delete_file_size,
               format('{{:,}}', record_count) AS record_count FROM fx_live""",
    "file_metrics_display": f"""
        SELECT table_name, content, file_type, format('{{:,}}', file_count) AS file_count,
               format('{{:,}}', max_record_count) AS max_record_count,
               format('{{:,}}', min_record_count) AS min_record_count,
               {_grouped('avg_record_count')} AS avg_record_count,
               printf('%.2f MB', avg_file_size / {MB}) AS avg_file_size,
               printf('%.2f MB', max_file_size / {MB}) AS max_file_size,
               printf('%.2f MB', min_file_size / {MB}) AS min_file_size FROM fx_file_metrics""",
    "file_type_comparison": f"""
        SELECT table_name, content, file_type, file_count, avg_record_count, avg_file_size / {MB} AS avg_file_size_mb
        FROM fx_file_metrics QUALIFY count(*) OVER (PARTITION BY table_name) > 1""",
    "bytes_to_mb": f"SELECT file_path, {_mb('file_size_in_bytes')} AS size_mb FROM fx_files",
    # partitions
    "partition_metrics": "SELECT * FROM fx_partition_metrics",
    "partition_flatten": """
        SELECT table_name, part_status AS partition_part_status, part_month AS partition_part_month, data_file_count,
               delete_file_count, total_data_file_size, avg_file_size_per_partition FROM fx_partition_metrics""",
    "partition_display": f"""
        SELECT table_name, part_status, part_month, data_file_count, delete_file_count,
               concat({_grouped(f'total_data_file_size / {MB}')}, ' MB') AS total_data_size_mb,
               concat({_grouped(f'avg_file_size_per_partition / {MB}')}, ' MB') AS avg_file_size_mb
        FROM fx_partition_metrics""",
    "partition_totals": f"""
        SELECT *, {_mb('total_data_size')} AS total_data_size_mb
        FROM (SELECT table_name, count(*) AS total_partitions, CAST(sum(data_file_count) AS BIGINT) AS total_data_files,
                     CAST(sum(delete_file_count) AS BIGINT) AS total_delete_files,
                     CAST(sum(total_data_file_size) AS BIGINT) AS total_data_size
              FROM fx_partition_metrics GROUP BY table_name)""",
    "partition_totals_display": f"""
        SELECT table_name, format('{{:,}}', total_partitions) AS total_partitions,
               format('{{:,}}', total_data_files) AS total_data_files,
               format('{{:,}}', total_delete_files) AS total_delete_files,
               concat({_grouped(f'total_data_size / {MB}')}, ' MB') AS total_data_size
        FROM (SELECT table_name, count(*) AS total_partitions, CAST(sum(data_file_count) AS BIGINT) AS total_data_files,
                     CAST(sum(delete_file_count) AS BIGINT) AS total_delete_files,
                     CAST(sum(total_data_file_size) AS BIGINT) AS total_data_size
              FROM fx_partition_metrics GROUP BY table_name)""",
    "partition_size_describe": f"""
        SELECT table_name, count, round(mean, 6) AS mean, round(std, 6) AS std, min, round(p25, 6) AS p25,
               round(p50, 6) AS p50, round(p75, 6) AS p75, max FROM ({_DESCRIBE})""",
    "partition_size_statistics": f"""
        SELECT table_name, statistic, {_grouped('value')} AS value_mb
        FROM (SELECT table_name, unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic,
                     unnest([CAST(count AS DOUBLE), mean, std, min, {_quartile(0.25)}, {_quartile(0.5)},
                             {_quartile(0.75)}, max]) AS value FROM ({_SORTED}))""",
    "partition_skew_sample": _SKEW_SAMPLE,
    "partition_skew_population": _SKEW_POPULATION,
    "partition_skew_class": f"""
        SELECT *, CASE WHEN skewness > 0.5 THEN 'skewed' WHEN skewness > 0.3 THEN 'moderate' ELSE 'balanced' END
                      AS skew_class FROM ({_SKEW_SAMPLE})""",
    "skew_gauge_band": f"""
        SELECT *, CASE WHEN skewness < 0.3 THEN 'low' WHEN skewness < 0.7 THEN 'medium' ELSE 'high' END AS band
        FROM ({_SKEW_POPULATION})""",
    "partition_distribution": f"""
        SELECT table_name, {_spread('record_count')}, {_spread('file_count')} FROM fx_partitions GROUP BY table_name""",
    "partition_file_histogram": """
        SELECT table_name, bin, round(lo + (hi - lo) / 20.0 * (bin - 1), 6) AS bin_start,
               round(lo + (hi - lo) / 20.0 * bin, 6) AS bin_end, count(*) AS partitions
        FROM (SELECT table_name, lo, hi,
                     CASE WHEN hi > lo THEN least(CAST(floor((n - lo) * 20 / (hi - lo)) AS INT) + 1, 20) ELSE 1 END AS bin
              FROM (SELECT table_name, data_file_count AS n, min(data_file_count) OVER (PARTITION BY table_name) AS lo,
                           max(data_file_count) OVER (PARTITION BY table_name) AS hi FROM fx_partition_metrics))
        GROUP BY table_name, bin, lo, hi""",
    "partition_size_vs_files": f"""
        SELECT table_name, part_status AS partition_part_status, part_month AS partition_part_month, data_file_count,
               delete_file_count, avg_file_size_per_partition, {_mb('total_data_file_size')} AS total_data_size_mb
        FROM fx_partition_metrics""",
    "top_partitions_by_size": f"""
        SELECT * FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY table_name
                          ORDER BY total_data_size_mb DESC, partition_label, data_file_count DESC,
                                   delete_file_count DESC) AS INT) AS rank
            FROM (SELECT table_name, {_LABEL} AS partition_label, {_mb('total_data_file_size')} AS total_data_size_mb,
                         data_file_count, delete_file_count FROM fx_partition_metrics)) WHERE rank <= 10""",
    # snapshots
    "snapshot_summary_metrics": f"SELECT table_name, snapshot_id, operation, {_CHANGES} FROM fx_metrics",
    "snapshot_iso_time": """
        SELECT table_name, snapshot_id,
               CASE WHEN microsecond(committed_at) % 1000000 = 0 THEN strftime(committed_at, '%Y-%m-%dT%H:%M:%S')
                    ELSE strftime(committed_at, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp
        FROM fx_metrics""",
    "latest_snapshot_metrics": """
        SELECT t.table_name, coalesce(added_data_files, 0) AS added_data_files,
               coalesce(deleted_data_files, 0) AS deleted_data_files,
               coalesce(added_delete_files, 0) AS added_delete_files,
               coalesce(removed_delete_files, 0) AS removed_delete_files, coalesce(added_records, 0) AS added_records,
               coalesce(deleted_records, 0) AS deleted_records,
               coalesce(changed_partition_count, 0) AS changed_partition_count, coalesce(operation, '') AS operation
        FROM fx_tables t LEFT JOIN fx_metrics m ON m.table_name = t.table_name AND snapshot_id = current_snapshot_id""",
    "snapshot_metrics_by_id": """
        SELECT t.table_name, coalesce(added_data_files, 0) AS added_data_files,
               coalesce(deleted_data_files, 0) AS deleted_data_files,
               coalesce(added_delete_files, 0) AS added_delete_files,
               coalesce(removed_delete_files, 0) AS removed_delete_files, coalesce(added_records, 0) AS added_records,
               coalesce(deleted_records, 0) AS deleted_records,
               coalesce(changed_partition_count, 0) AS changed_partition_count, coalesce(operation, '') AS operation,
               wanted
        FROM fx_tables t CROSS JOIN (SELECT 7 AS wanted UNION ALL SELECT -1)
        LEFT JOIN fx_metrics m ON m.table_name = t.table_name AND snapshot_id = wanted""",
    "historical_snapshots": f"""
        SELECT table_name, snapshot_id, committed_at AS timestamp, parent_id, operation, {_CHANGES},
               total_data_files, total_delete_files, total_files_size FROM fx_history""",
    "snapshot_detail": f"""
        SELECT table_name, snapshot_id, parent_id, {_TIME.format('committed_at')} AS formatted_time, operation, {_CHANGES}
        FROM fx_metrics WHERE age = 1""",
    "snapshot_option_text": f"""
        SELECT table_name, snapshot_id,
               concat('Snapshot ', CAST(snapshot_id AS VARCHAR), ' - ', {_TIME.format('committed_at')}, ' (', operation,
                      ')') AS display_option FROM fx_metrics""",
    "operation_class": f"""
        SELECT table_name, snapshot_id, operation, {_CLASS} AS operation_class, {_COLOUR} AS colour FROM fx_metrics""",
    "snapshot_timeline": f"""
        SELECT table_name, snapshot_id, committed_at AS timestamp, {_TIME.format('committed_at')} AS formatted_time,
               operation, {_CLASS} AS operation_class, {_COLOUR} AS colour, added_data_files, deleted_data_files,
               added_records, deleted_records,
               lead(committed_at) OVER (PARTITION BY table_name ORDER BY committed_at DESC, snapshot_id DESC)
                   AS linked_timestamp
        FROM fx_history""",
    "snapshot_trends": f"""
        SELECT table_name, committed_at AS timestamp, snapshot_id, operation, total_data_files, total_delete_files,
               total_files_size / {MB} AS total_files_size_mb FROM fx_history""",
    "snapshot_record_trend": """
        SELECT table_name, committed_at AS timestamp, snapshot_id, operation, 'Added Records' AS metric_type,
               added_records AS count FROM fx_history
        UNION ALL
        SELECT table_name, committed_at, snapshot_id, operation, 'Deleted Records', deleted_records FROM fx_history""",
    "snapshot_change_breakdown": """
        SELECT table_name, snapshot_id,
               unnest(['Added Data Files', 'Deleted Data Files', 'Added Delete Files', 'Removed Delete Files',
                       'Added Records', 'Deleted Records']) AS change,
               unnest([added_data_files, deleted_data_files, added_delete_files, removed_delete_files, added_records,
                       deleted_records]) AS value
        FROM fx_metrics""",
    "snapshots_with_file_changes": f"""
        SELECT table_name, snapshot_id, operation, {_CHANGES} FROM fx_metrics
        WHERE greatest(added_data_files, deleted_data_files, added_delete_files, removed_delete_files) > 0""",
    "expirable_snapshots": """
        SELECT table_name, snapshot_id, timestamp_ms, committed_at AS timestamp, manifest_list FROM fx_expirable""",
    "expirable_unprotected_snapshots": """
        SELECT table_name, snapshot_id, timestamp_ms, committed_at AS timestamp, manifest_list FROM fx_expirable
        WHERE snapshot_id NOT IN (SELECT current_snapshot_id FROM fx_tables WHERE current_snapshot_id IS NOT NULL)""",
    "expirable_by_ancestry": """
        SELECT table_name, snapshot_id, timestamp_ms, manifest_list FROM fx_expirable
        WHERE snapshot_id NOT IN (
            SELECT p.snapshot_id FROM fx_placed p JOIN (
                SELECT table_name, place, 5 AS keep FROM fx_placed WHERE snapshot_id % 500 = 0
                UNION ALL SELECT p.table_name, place, 20
                FROM fx_placed p JOIN fx_tables t ON t.table_name = p.table_name AND current_snapshot_id = snapshot_id
            ) h ON p.table_name = h.table_name AND p.place <= h.place AND p.place > h.place - h.keep)""",
    "short_table_name": """
        SELECT c_custkey, string_split(concat('lake.', lower(c_mktsegment), '.', c_name), '.')[-1] AS short_name
        FROM customer""",
    # orphans and composites
    "orphan_files": """
        SELECT file_path, file_size_in_bytes FROM fx_storage
        WHERE file_path NOT IN (SELECT file_path FROM fx_referenced)""",
    "format_bytes": f"SELECT file_path, {_bytes_text('file_size_in_bytes')} AS size_text FROM fx_files",
    "health_files_per_partition": f"""
        SELECT table_name, {_LABEL} AS partition_label, CAST(sum(data_file_count) AS BIGINT) AS file_count
        FROM fx_partition_metrics GROUP BY table_name, part_status, part_month""",
    "health_partition_sizes": f"""
        SELECT table_name, {_LABEL} AS partition_label, CAST(sum(total_data_file_size) AS BIGINT) AS size_bytes,
               {_bytes_text('sum(total_data_file_size)')} AS size_text
        FROM fx_partition_metrics GROUP BY table_name, part_status, part_month""",
    "health_summary": f"""
        SELECT t.table_name, coalesce(size_bytes, 0) AS total_size_bytes,
               {_bytes_text('coalesce(size_bytes, 0)')} AS total_size_text,
               coalesce(files, 0) AS total_files, coalesce(partitions, 0) AS total_partitions,
               round(CASE WHEN partitions > 0 THEN size_bytes / partitions ELSE 0 END, 6) AS average_partition_size_bytes,
               coalesce(skewness, 0) AS partition_skewness, coalesce(orphans, 0) AS orphan_file_count,
               coalesce(expirable, 0) AS expirable_snapshot_count
        FROM fx_tables t
        LEFT JOIN (SELECT table_name, CAST(sum(total_data_file_size) AS BIGINT) AS size_bytes,
                          CAST(sum(data_file_count) AS BIGINT) AS files, count(*) AS partitions
                   FROM fx_partition_metrics GROUP BY table_name) p ON p.table_name = t.table_name
        LEFT JOIN ({_SKEW_POPULATION}) k ON k.table_name = t.table_name
        LEFT JOIN (SELECT table_name, count(*) AS orphans FROM fx_storage
                   WHERE file_path NOT IN (SELECT file_path FROM fx_referenced) GROUP BY table_name) o
               ON o.table_name = t.table_name
        LEFT JOIN (SELECT table_name, count(*) AS expirable FROM fx_expirable GROUP BY table_name) e
               ON e.table_name = t.table_name""",
    "table_metrics_report": f"""
        SELECT t.table_name,
               coalesce(added_data_files, 0) AS added_data_files, coalesce(deleted_data_files, 0) AS deleted_data_files,
               coalesce(added_delete_files, 0) AS added_delete_files,
               coalesce(removed_delete_files, 0) AS removed_delete_files, coalesce(added_records, 0) AS added_records,
               coalesce(deleted_records, 0) AS deleted_records,
               coalesce(changed_partition_count, 0) AS changed_partition_count, coalesce(operation, '') AS operation,
               coalesce(total_data_files, 0) AS total_data_files, coalesce(total_delete_files, 0) AS total_delete_files,
               coalesce(total_files_size, 0) AS total_files_size, coalesce(data_file_size, 0) AS data_file_size,
               coalesce(delete_file_size, 0) AS delete_file_size, coalesce(l.record_count, 0) AS live_record_count,
               coalesce(total_equality_delete_files, 0) AS total_equality_delete_files,
               coalesce(equality_delete_file_size, 0) AS equality_delete_file_size,
               coalesce(partition_count, 0) AS partition_count, coalesce(file_type_count, 0) AS file_type_count,
               coalesce(history_length, 0) AS history_length
        FROM fx_tables t
        LEFT JOIN (SELECT table_name, snapshot_id, operation, {_CHANGES} FROM fx_metrics) m
               ON m.table_name = t.table_name AND snapshot_id = current_snapshot_id
        LEFT JOIN fx_live l ON l.table_name = t.table_name
        LEFT JOIN (SELECT table_name, count(*) AS partition_count FROM fx_partition_metrics GROUP BY table_name) p
               ON p.table_name = t.table_name
        LEFT JOIN (SELECT table_name, count(DISTINCT content) AS file_type_count FROM fx_files GROUP BY table_name) c
               ON c.table_name = t.table_name
        LEFT JOIN (SELECT table_name, count(*) AS history_length FROM fx_history GROUP BY table_name) h
               ON h.table_name = t.table_name""",
}


def _needed(text: str) -> list[str]:
    """Relations that a statement uses, directly or through others, in definition order."""
    names: set[str] = set()
    queue = [text]
    while queue:
        current = queue.pop()
        for name, body in RELATIONS.items():
            if name not in names and _mentions(current, name):
                names.add(name)
                queue.append(body)
    return [n for n in RELATIONS if n in names]


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def _statement(body: str) -> str:
    relations = [f"{n} AS ({RELATIONS[n]})" for n in _needed(body)]
    return (f"WITH {', '.join(relations)} " if relations else "") + body.strip()


SQL = {name: _statement(body) for name, body in _BODIES.items()}
