"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`, which all executors share.

    Where the session has none, local mode (tests) uses a temporary folder; elsewhere each
    executor would write to a disk of its own, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _OWN_DIR[app]


def _at(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again, which cuts its lineage.

    The table survives the loss of executors; it goes by discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm_path, files = _at(spark, path)
    files.deleteOnExit(jvm_path)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that keep() returned, once nothing will read it any more."""
    jvm_path, files = _at(df.sparkSession, df._kept_at)
    files.delete(jvm_path, True)
