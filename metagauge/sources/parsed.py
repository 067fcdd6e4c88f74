"""Parsed manifests that are kept between runs.

A manifest never changes, so what was read of it once holds for good. A store is a folder of two datasets, the records of
manifests and the list of manifests that were read to their ends. Each run adds a folder of its own to both, a batch, first the records and
then the list; a batch without a list, as a run broke off, counts for nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.lineage import Kept
from ..schemas import ENTRY_SCHEMA
from .manifests import Read, avro_records, entries_of, owned_manifests

_LISTED = "manifest_path STRING, batch STRING"


class ManifestStore:
    """Manifests by path, in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        fields = spark._jvm.org.apache.spark.sql.types.StructType.fromDDL(ENTRY_SCHEMA).toDDL()
        self._schema = f"manifest_path STRING, {fields}, batch STRING"

    def _batches(self) -> list[str]:
        """The batches of runs that came to their ends."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
        return sorted(s.getPath().getParent().getName() for s in found or [])

    def _read(self, name: str, schema: str) -> DataFrame:
        # Batch by batch: two readings of one folder, before and after files were added, pass for the same within a plan.
        paths = [f"{self.folder}/{name}/{batch}" for batch in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def listed(self) -> DataFrame:
        """``manifest_path, batch`` of the manifests that need not be opened any more."""
        return self._read("manifests", _LISTED).groupBy("manifest_path").agg(F.min("batch").alias("batch"))

    def _add(self, files: DataFrame, strict: bool, kept: Kept) -> DataFrame:
        """Reads files into a batch; the errors are those of files that were not read to their ends and are not listed."""
        batch = uuid.uuid4().hex
        given = files.select("path", "length", F.col("path").alias("own"))
        parsed = avro_records(given, "own", strict).select(
            F.col("owner").alias("manifest_path"), "error", F.inline(F.array(F.from_json("record", ENTRY_SCHEMA)))
        )
        read = kept.stored(parsed)
        lost = kept.stored(read.where("error IS NOT NULL").groupBy("manifest_path").agg(F.min("error").alias("error")))
        whole = read.where("error IS NULL").drop("error").join(lost, "manifest_path", "left_anti")
        whole.withColumn("batch", F.lit(batch)).write.parquet(f"{self.folder}/records/{batch}")
        done = files.select(F.col("path").alias("manifest_path")).join(lost, "manifest_path", "left_anti")
        done.withColumn("batch", F.lit(batch)).coalesce(1).write.parquet(f"{self.folder}/manifests/{batch}")
        return lost

    def read_entries(self, manifest_rows: DataFrame, tables: DataFrame, kept: Kept | None = None, strict: bool = True) -> Read:
        """As :func:`metagauge.sources.manifests.read_entries`; only manifests that are not in the store are opened."""
        kept = kept or Kept()
        files = kept.stored(owned_manifests(manifest_rows, tables))
        listed = self.listed.select(F.col("manifest_path").alias("path"))
        new = kept.stored(files.join(listed, "path", "left_anti"))
        lost = self.spark.createDataFrame([], "manifest_path STRING, error STRING")
        if not new.isEmpty():
            lost = self._add(new, strict, kept)
        wanted = files.join(self.listed, F.col("path") == F.col("manifest_path")).select("manifest_path", "batch", "owner")
        records = self._read("records", self._schema).join(wanted, ["manifest_path", "batch"])
        owners = files.select(F.col("path").alias("manifest_path"), F.explode("owner.tables").alias("of"))
        told = lost.join(owners, "manifest_path").select("of.table_name", F.col("manifest_path").alias("path"), "error")
        return Read(entries_of(records).drop("error"), told)
