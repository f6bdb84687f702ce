"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ARCHIVE = "maskwell-modules.zip"
_shipped: set[str] = set()
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or the SQL warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's folder, which goes when its driver ends."""
    run = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    where, files = _file_system(spark, run)
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors. Column names must
    be unique, as in any Parquet table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def path_of(table: DataFrame) -> str:
    """Where a table of :func:`materialize` lies, for streams that read it."""
    return _paths[table]


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads, nor anything lazily built on them."""
    for table in tables:
        path = _paths.pop(table, None)
        if path is not None:
            where, files = _file_system(table.sparkSession, path)
            files.delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed on the nodes.

    Sends its modules as a zip file by Spark's own file server, once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="maskwell-"), _ARCHIVE)
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
