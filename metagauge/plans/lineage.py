"""Results that are computed once and read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


class Kept:
    """What some results keep, to be dropped together."""

    def __init__(self):
        self._frames: list[DataFrame] = []
        self._folders: list[tuple[SparkSession, str]] = []

    def cached(self, df: DataFrame) -> DataFrame:
        """``df`` cached when it is first computed; for small results that plans made before any job are built on."""
        self._frames.append(df.persist())
        return df

    def stored(self, df: DataFrame) -> DataFrame:
        """``df`` computed once for everything built on it.

        Written to the shared folder now, it cuts the lineage, survives lost executors, and lets each reader take only the
        columns it needs. A session without such a folder caches it instead, which a lost executor makes Spark compute anew.
        """
        spark = df.sparkSession
        folder = shared_folder(spark)
        if folder is None:
            return self.cached(df)
        path = f"{folder}/stored-{uuid.uuid4()}"
        df.write.parquet(path)
        self._folders.append((spark, path))
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        # For results that nobody releases.
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self._frames:
            self._frames.pop().unpersist()
        while self._folders:
            spark, path = self._folders.pop()
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` kept for as long as the shared folder, or the cache, keeps it; see :meth:`Kept.stored`."""
    return Kept().stored(df)
