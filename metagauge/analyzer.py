"""One object for a table or a fleet: where its metadata comes from, and every operator over it."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import files as file_ops
from .operators import health as health_ops
from .operators import orphans as orphan_ops
from .operators import partitions as partition_ops
from .operators import snapshots as snapshot_ops
from .functions import normal_path
from .plans.lineage import Kept
from .plans.report import TableReport, table_report
from .sources import catalog, manifests, metadata, storage
from .sources.parsed import ManifestStore


class TableAnalyzer:
    """Lazy relations and operators over the tables named by some metadata documents.

    A metadata path (or glob) wins over a name; a name is looked up in a warehouse folder. Of each table the newest document
    named is used, and every table has a name of its own. ``strict=False`` is for fleets in which one bad table must not fail
    the rest: a table whose current manifests can't be read has no file metrics, one whose older manifests can't be read has no
    orphans, all such files are listed in ``errors``, and malformed summary numbers count as 0.

    Manifests are read once, when a relation is first asked for, and kept until :meth:`release`. With ``manifest_store``, a
    folder, they are kept for later runs too, which then open only those that are new.
    """

    def __init__(
        self,
        spark: SparkSession,
        metadata_path: str | None = None,
        *,
        warehouse: str | None = None,
        database: str = "default",
        table_name: str = "",
        strict: bool = True,
        manifest_store: str | None = None,
    ):
        self.spark = spark
        self.strict = strict
        self._store = ManifestStore(spark, manifest_store) if manifest_store else manifests
        self._kept = Kept()
        if metadata_path:
            documents = catalog.newest_at(spark, metadata_path)
        elif warehouse:
            if table_name:
                database, table_name = catalog.split_name(table_name, database)
            documents = catalog.newest_in(spark, warehouse, database, table_name or "*")
        else:
            raise ValueError("a metadata path or a warehouse is needed")
        read = self._kept.stored(metadata.read_tables(documents, strict))
        # Tables, snapshots and errors all read what was parsed.
        self._parsed = self._kept.cached(metadata.parse_tables(read))
        self._parsed_snapshots = self._kept.cached(metadata.parse_snapshots(read))

    @classmethod
    def of_relations(cls, spark: SparkSession, relations: dict[str, DataFrame], strict: bool = True) -> TableAnalyzer:
        """Over relations from elsewhere: ``tables``, ``snapshots``, ``files``, and for orphans ``referenced`` paths.
        Tables that have a ``location`` can be listed."""
        own = cls.__new__(cls)
        own.spark, own.strict, own._kept, own._parsed = spark, strict, Kept(), None
        given = dict(relations)
        referenced = given.pop("referenced", None)
        if referenced is not None:
            given["references"] = given["entries"] = referenced
        # A cached property that is in the instance's dictionary is not computed.
        vars(own).update(given)
        return own

    @classmethod
    def of_session_table(cls, spark: SparkSession, name: str, strict: bool = True) -> TableAnalyzer:
        """Over a table of an Iceberg catalog that the session knows."""
        return cls.of_relations(spark, catalog.session_relations(spark, name), strict)

    def release(self) -> None:
        """Drops what is cached and what was stored; the relations can't be used any more."""
        self._kept.release()

    # -- relations -----------------------------------------------------------------------------------------------------

    @cached_property
    def tables(self) -> DataFrame:
        return metadata.tables(self._parsed)

    @cached_property
    def errors(self) -> DataFrame:
        """What could not be read: documents, and unless strict, manifest lists and manifests. Known from the reading itself,
        which this starts if nothing has before."""
        if self._parsed is None:  # whoever made the relations has read the files
            return self.spark.createDataFrame([], metadata.ERRORS_SCHEMA)
        broken = metadata.fleet_errors(self._parsed).unionByName(metadata.fleet_errors(self._parsed_snapshots))
        if self.strict:
            return broken
        documents = self.tables.select("table_name", "metadata_location")
        told = self._lost.select("table_name", F.concat("error", F.lit(": "), "path").alias("error"))
        return broken.unionByName(told.join(documents, "table_name").select(*broken.columns))

    @cached_property
    def snapshots(self) -> DataFrame:
        return metadata.snapshots(self._parsed_snapshots)

    def _manifests(self, snapshots: DataFrame) -> manifests.Read:
        return manifests.manifest_files(snapshots, self._kept, self.strict)

    @cached_property
    def _current(self) -> manifests.Read:
        """Manifests of the current snapshots."""
        return self._manifests(snapshot_ops.current_snapshot(self.tables, self.snapshots).where("snapshot_id IS NOT NULL"))

    @cached_property
    def _current_entries(self) -> manifests.Read:
        return self._store.read_entries(self._current.rows, self.tables, self._kept, self.strict)

    @cached_property
    def _history(self) -> manifests.Read:
        """Manifests of all snapshots."""
        return self._manifests(self.snapshots)

    @cached_property
    def _older_entries(self) -> manifests.Read:
        """Entries of the manifests that no current snapshot has, so that each manifest is read once."""
        keys = ["table_name", "manifest_path"]
        older = self._history.rows.join(self._current.rows.select(*keys).distinct(), keys, "left_anti")
        return self._store.read_entries(older, self.tables, self._kept, self.strict)

    @cached_property
    def _lost_now(self) -> DataFrame:
        """Files of current snapshots that could not be read."""
        return self._current.lost.unionByName(self._current_entries.lost)

    @cached_property
    def _lost(self) -> DataFrame:
        """Files of any snapshot that could not be read."""
        lost = self._lost_now.unionByName(self._history.lost).unionByName(self._older_entries.lost)
        return lost.groupBy("table_name", "path").agg(F.min("error").alias("error"))

    def _without(self, rows: DataFrame, lost: DataFrame) -> DataFrame:
        return rows.join(lost.select("table_name").distinct(), "table_name", "left_anti")

    @cached_property
    def files(self) -> DataFrame:
        """Live files: only the manifests of current snapshots are opened."""
        found = manifests.live_files(self._current_entries.rows)
        return found if self.strict else self._without(found, self._lost_now)

    @cached_property
    def _with_files(self) -> DataFrame:
        """The tables whose live files are known."""
        return self.tables if self.strict or self._parsed is None else self._without(self.tables, self._lost_now)

    @cached_property
    def entries(self) -> DataFrame:
        """Entries of every manifest that any snapshot reaches."""
        return self._current_entries.rows.unionByName(self._older_entries.rows)

    @cached_property
    def references(self) -> DataFrame:
        """Every file that the tables know, ``table_name, file_path``: data, manifests, lists, documents, statistics."""
        own = self._history.rows.select("table_name", F.col("manifest_path").alias("file_path"))
        lists = self.snapshots.where("manifest_list IS NOT NULL").select("table_name", F.col("manifest_list").alias("file_path"))
        named = own.union(lists).union(metadata.metadata_files(self._parsed))
        return self.entries.select("table_name", "file_path").union(named)

    @cached_property
    def partitions(self) -> DataFrame:
        return partition_ops.partition_stats(self.files)

    def storage(self, location: str | None = None) -> DataFrame:
        """What lies in the tables' locations, or in those below ``location``, each file with its table."""
        if "location" not in self.tables.columns:
            raise ValueError("the locations of these tables are not known; make a listing with sources.storage")
        at = self.tables.select("table_name", "location")
        if location is not None:
            given = F.rtrim(normal_path(F.lit(location)), F.lit("/"))
            own = F.rtrim(normal_path("location"), F.lit("/"))
            at = at.where((own == given) | own.startswith(F.concat(given, F.lit("/"))))
        return storage.fleet_listing(at, self._kept)

    # -- operators -----------------------------------------------------------------------------------------------------

    def table_metrics(self, history: int = 20) -> TableReport:
        return table_report(self._with_files, self.snapshots, self.files, history, self.strict, self.tables)

    def live_table_metrics(self) -> DataFrame:
        return file_ops.live_table_metrics(self.files, self._with_files)

    def file_metrics(self) -> DataFrame:
        return file_ops.file_metrics(self.files)

    def snapshot_metrics(self, snapshot_id: int | None = None) -> DataFrame:
        """Of the current snapshots, or of the one with the given id."""
        if snapshot_id is not None:
            return snapshot_ops.snapshot_metrics(self.tables, self.snapshots, snapshot_id, self.strict)
        return snapshot_ops.latest_snapshot_metrics(self.tables, self.snapshots, self.strict)

    def historical_snapshots(self, limit: int = 10) -> DataFrame:
        return snapshot_ops.history_in_order(
            snapshot_ops.historical_snapshots(self.snapshots, limit, self.strict)
        )

    def partition_metrics(self) -> DataFrame:
        return partition_ops.in_report_order(partition_ops.partition_metrics(self.partitions))

    def partition_skewness(self) -> DataFrame:
        return partition_ops.partition_skew_population(
            partition_ops.partition_metrics(self.partitions), self.tables
        )

    def orphan_files(self, listing: DataFrame, older_than: dt.datetime | None = None) -> DataFrame:
        """Listed files that nothing references. Where not all manifests could be read (see ``errors``) nobody knows, and a
        table has no orphans."""
        if not self.strict and self._parsed is not None:
            listing = self._without(listing, self._lost)
        return orphan_ops.orphan_files(listing, self.references, older_than)

    def expirable_snapshots(
        self, as_of: dt.datetime | int, days: int = 30, protect_current: bool = False
    ) -> DataFrame:
        protected = snapshot_ops.protected_snapshots(self.tables) if protect_current else None
        return snapshot_ops.expirable_snapshots(self.snapshots, as_of, days, protected)

    def expirable_by_ancestry(self, as_of: dt.datetime | int, days: int = 30, keep: int = 1) -> DataFrame:
        """As :meth:`expirable_snapshots`, but what the branches keep of their lines and what tags name stays."""
        return snapshot_ops.expirable_by_ancestry(self.snapshots, self.tables, as_of, days, keep, self._kept)

    def health_summary(self, listing: DataFrame, as_of: dt.datetime | int, days: int = 30) -> DataFrame:
        """Totals, skew, orphan and expiry counts; ``listing`` carries the table each file belongs to, as :meth:`storage`'s
        does."""
        if "table_name" not in listing.columns:
            raise ValueError("the listing must tell the table of each file")
        return health_ops.health_summary(
            self._with_files,
            partition_ops.partition_metrics(self.partitions),
            self.orphan_files(listing),
            self.expirable_snapshots(as_of, days),
        )
