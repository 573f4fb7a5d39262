"""Durable intermediate tables.

Iterative operators cut their lineage by writing a Parquet table into the shared folder the
cluster names in ``spark.checkpoint.dir`` and reading it back: a lost executor then costs a
re-read, never a recomputation of the whole loop. Only a local master, which is one machine, may do without
the setting; a temporary folder of that machine is used then.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def stage_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/") + "/corvane"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="corvane-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once, in folders of the columns ``by`` if given, and return the written table. Void columns
    aren't supported."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made = made.select(*df.columns) if by else made  # the folders' columns come last
    made._staged_path = path
    return made


def open_shared(path: str) -> object:
    """A file of the shared folder, opened for reading by a Python worker: through pyarrow under the names that Hadoop
    gives its file systems, or through fsspec where pyarrow doesn't know one."""
    from pyarrow.fs import FileSystem, FSSpecHandler, PyFileSystem

    scheme, _, name = path.partition(":")
    if scheme == "dbfs":
        path = "/dbfs/" + name.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3:" + name
    try:
        files, name = FileSystem.from_uri(path)
    except ValueError:
        import fsspec

        files, name = PyFileSystem(FSSpecHandler(fsspec.filesystem(scheme))), path
    return files.open_input_file(name)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``stage`` that nothing will read again, such as a loop's superseded ones."""
    for table in tables:
        _delete(table.sparkSession, table._staged_path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that read them must be written before."""
    _delete(spark, stage_root(spark))
