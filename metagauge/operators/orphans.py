"""Files that lie in a table's location and that no snapshot references."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions import normal_path

# Written by catalogs that keep no other state; no document names it.
_VERSION_HINT = r"/metadata/version-hint\.text$"
# A checksum beside a file, which belongs to it.
_CHECKSUM = r"/\.([^/]+)\.crc$"


def referenced_files(entries: DataFrame, metadata_files: DataFrame | None = None) -> DataFrame:
    """Distinct paths that some snapshot's manifests mention; with ``metadata_files``, those of the metadata itself too."""
    paths = entries.select("file_path")
    return (paths if metadata_files is None else paths.union(metadata_files.select("file_path"))).distinct()


def orphan_files(
    storage: DataFrame,
    referenced: DataFrame,
    older_than: dt.datetime | None = None,
) -> DataFrame:
    """Listed files without a reference.

    ``referenced`` names data files, and metadata files where the listing has those. A checksum file counts as the file it is
    of. ``older_than``, in UTC if it has no zone, leaves out files modified since, which a running commit may be about to
    reference. Paths are compared in one spelling (see :func:`metagauge.functions.normal_path`). The anti join needs no
    distinct reference, so ``referenced`` may be raw entries; paths hardly repeat, so neither side has a hot key.
    """
    listed = storage.where(~F.col("file_path").rlike(_VERSION_HINT))
    if older_than is not None:
        moment = older_than if older_than.tzinfo else older_than.replace(tzinfo=dt.timezone.utc)
        micros = (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
        listed = listed.where(F.unix_micros("modified") < micros)

    def keyed(files: DataFrame) -> DataFrame:
        # Paths of a table share a long start, which makes them slow to sort; their hashes do not.
        path = F.regexp_replace(normal_path("file_path"), _CHECKSUM, "/$1")
        return files.withColumns({"__hash": F.xxhash64(path), "__path": path})

    keys = ["__hash", "__path"]
    return keyed(listed).join(keyed(referenced).select(*keys), keys, "left_anti").drop(*keys)
