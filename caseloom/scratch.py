"""Written intermediate tables in the folder that driver and executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only when
that is unset, as in tests on one machine, a temporary folder takes its place.
Tables written there cut lineage and survive the loss of executors.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_user = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_user.isDefined():
            root = set_by_user.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="caseloom-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        root = f"file://{_local_root}"
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}" if root.startswith("/") else root
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/caseloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


#: Whether Spark deletes shuffle files when the execution that made them ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile leaves no shuffle files behind."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back; its shuffle files go at once."""
    return save_all([df], name, compression)


def save_all(frames: Iterable[DataFrame], name: str, compression: str = "zstd") -> DataFrame:
    """Writes frames of one schema, one after the other, and reads them back as one table."""
    path = None
    for df in frames:
        if path is None:
            spark, schema, path = df.sparkSession, df.schema, new_path(df.sparkSession, name)
        with _cleaning(spark):
            df.write.mode("append").option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that `save` has written, for those who need it no more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/caseloom/{spark.sparkContext.applicationId}/" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes what this application has written; results read from there become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/caseloom/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
