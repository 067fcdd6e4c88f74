"""Schemas of the metadata documents and of the relations every operator works on.

Only the fields that some operator reads are listed, so the JSON parser skips everything else (column bounds,
encryption keys, sort orders) instead of materialising it.
"""

from __future__ import annotations

# Table metadata document.
SNAPSHOT_FIELDS = (
    "`snapshot-id` BIGINT, `parent-snapshot-id` BIGINT, `timestamp-ms` BIGINT, "
    "`manifest-list` STRING, `manifests` ARRAY<STRING>, `summary` MAP<STRING, STRING>"
)
SPEC_FIELDS = "ARRAY<STRUCT<`name`: STRING, `transform`: STRING, `source-id`: INT>>"
SCHEMA_FIELDS = "ARRAY<STRUCT<`id`: INT, `name`: STRING, `type`: STRING>>"

METADATA_SCHEMA = (
    "`format-version` INT, `table-uuid` STRING, `location` STRING, "
    "`current-snapshot-id` BIGINT, `current-schema-id` INT, `default-spec-id` INT, "
    f"`schemas` ARRAY<STRUCT<`schema-id`: INT, `fields`: {SCHEMA_FIELDS}>>, "
    f"`schema` STRUCT<`fields`: {SCHEMA_FIELDS}>, "
    f"`partition-specs` ARRAY<STRUCT<`spec-id`: INT, `fields`: {SPEC_FIELDS}>>, "
    f"`partition-spec` {SPEC_FIELDS}, "
    "`properties` MAP<STRING, STRING>, "
    "`refs` MAP<STRING, STRUCT<`snapshot-id`: BIGINT, `type`: STRING, `min-snapshots-to-keep`: INT>>, "
    f"`snapshots` ARRAY<STRUCT<{SNAPSHOT_FIELDS.replace('` ', '`: ')}>>, "
    "`metadata-log` ARRAY<STRUCT<`metadata-file`: STRING>>, "
    "`statistics` ARRAY<STRUCT<`statistics-path`: STRING>>, "
    "`partition-statistics` ARRAY<STRUCT<`statistics-path`: STRING>>"
)

# One record of a manifest list and of a manifest. Partition tuples differ from spec to spec; read as a map, one schema
# fits every table of a fleet.
MANIFEST_LIST_SCHEMA = (
    "manifest_path STRING, manifest_length BIGINT, partition_spec_id INT, content INT, added_snapshot_id BIGINT"
)
ENTRY_SCHEMA = (
    "status INT, snapshot_id BIGINT, data_file STRUCT<"
    "content: INT, file_path: STRING, file_format: STRING, partition: MAP<STRING, STRING>, "
    "record_count: BIGINT, file_size_in_bytes: BIGINT>"
)

# Codes of the public table format.
CONTENT_DATA, CONTENT_POSITION_DELETES, CONTENT_EQUALITY_DELETES = 0, 1, 2
STATUS_DELETED = 2

# Snapshot summary keys, in report order.
CHANGE_KEYS = (
    "added-data-files",
    "deleted-data-files",
    "added-delete-files",
    "removed-delete-files",
    "added-records",
    "deleted-records",
    "changed-partition-count",
)
TOTAL_KEYS = (
    "total-data-files",
    "total-delete-files",
    "total-files-size",
)


def column_of(key: str) -> str:
    """Column name of a summary key."""
    return key.replace("-", "_")


CHANGE_COLUMNS = tuple(column_of(k) for k in CHANGE_KEYS)
TOTAL_COLUMNS = tuple(column_of(k) for k in TOTAL_KEYS)
FILE_CHANGE_COLUMNS = CHANGE_COLUMNS[:4]
RECORD_CHANGE_COLUMNS = CHANGE_COLUMNS[4:6]
