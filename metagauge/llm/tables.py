"""Reading the given tables, storing intermediate results in the shared folder, and cutting a table into ordered ranges."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts before every id; stands for a null id where rows are ordered.
FIRST_KEY = -(2**63)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, whatever path they were started with."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The URI of a new folder below ``spark.checkpoint.dir``; a session that names none, as in tests, gets a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='llm-')}"
        context.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}")
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", whole)


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: computed once, and kept when an executor is lost. The files
    go when the application ends."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame, *but: str) -> Column:
    """All columns but some as one struct, so that names of ours don't meet theirs."""
    left_out = {c.lower() for c in but}
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in left_out])


def order_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(FIRST_KEY))


def text_digest() -> Column:
    """A number for ``text``, the same wherever it is computed; with the key it tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def range_of(df: DataFrame, key: str, parts: int) -> Column:
    """The number of the key's range, from 0 on in ascending order, with about as many rows in each of ``parts`` ranges.

    The borders are quantiles of the key, so only they come to the driver, and the number depends on the key alone. They are
    looked up in two steps, among the first of each run of borders and then in that run.
    """
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("b")).first().b if at else []
    borders = sorted(set(found or []))
    if not borders:
        return F.lit(0)
    width = max(1, int(len(borders) ** 0.5))
    runs = [borders[i : i + width] for i in range(0, len(borders), width)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col(key)))
    run = F.greatest(below(longs([r[0] for r in runs])) - 1, F.lit(0))
    return (run * width + below(F.element_at(F.array(*map(longs, runs)), run + 1))).cast("int")
