"""Functions for tasks that need the JVM: file systems of the session's Hadoop settings, and Avro files read block by block.

They are Java classes, kept as source and compiled once per application by the compiler that Spark brings for its own generated
code. What is compiled is added to the session as a jar, so that executors have it.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).parent
#: By application, the compiled classes and the loader that knows all of them.
_COMPILED: dict[str, tuple[dict[Path, object], object]] = {}


def _class(spark: SparkSession, source: Path):
    """The class of a source file, which may use those compiled before."""
    jvm, application = spark._jvm, spark.sparkContext.applicationId
    known, loader = _COMPILED.get(application) or ({}, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    if source not in known:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(loader)
        compiler.cook(source.read_text())
        jar = Path(tempfile.mkdtemp(prefix="jvm-")) / f"{source.stem}.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for entry in compiler.getBytecodes().entrySet():
                out.writestr(f"{entry.getKey().replace('.', '/')}.class", bytes(entry.getValue()))
        # Spark sends the jar to the executors.
        spark.sql(f"ADD JAR '{jar.as_uri()}'").collect()
        loader = compiler.getClassLoader()
        known = known | {source: jvm.java.lang.Class.forName(f"metagauge.{source.stem}", True, loader)}
        _COMPILED[application] = known, loader
    return known[source]


def hadoop_settings(spark: SparkSession):
    """The session's settings of Hadoop, as a map that can travel to tasks."""
    settings = spark._jvm.java.util.HashMap()
    for entry in spark._jsparkSession.sessionState().newHadoopConf().iterator():
        settings.put(entry.getKey(), entry.getValue())
    return settings


def map_partitions(rows: DataFrame, name: str, schema: str, *arguments, folder: Path = _HERE) -> DataFrame:
    """Rows that an object of the class ``name`` makes, partition by partition, of these rows."""
    spark = rows.sparkSession
    jvm = spark._jvm
    _class(spark, _HERE / "Hadoop.java")
    made = _class(spark, folder / f"{name}.java").getConstructors()[0]
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(arguments) + 1)
    for i, argument in enumerate((hadoop_settings(spark), *arguments)):
        given[i] = argument
    kind = jvm.org.apache.spark.sql.types.StructType.fromDDL(schema)
    encoder = jvm.org.apache.spark.sql.Encoders.row(kind)
    return DataFrame(rows._jdf.mapPartitions(made.newInstance(given), encoder), spark)
