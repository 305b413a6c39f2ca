"""Tables in the folder that driver and executors share: they cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, removed when the JVM ends.

    Only a local master may leave that setting unset (tests): all of its tasks see the driver's disk. Elsewhere
    that is an error, since each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="concord-")
        folder = _LOCAL[context.applicationId]
    own = f"{folder.rstrip('/')}/concord-{context.applicationId}"
    path, files = _files(spark, own)
    files.deleteOnExit(path)
    return own


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it back; the table survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the table behind a result of ``stored`` that nothing reads any more."""
    path, files = _files(df.sparkSession, df.scratch_path)
    files.delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables of this application: no result that reads them may still be in use."""
    path, files = _files(spark, shared_dir(spark))
    files.delete(path, True)
