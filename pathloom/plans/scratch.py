"""Intermediate tables in the folder that the driver and every executor share.

Writing a table cuts lineage and survives the loss of an executor, unlike cached
blocks or local checkpoints.  The folder is the session's ``spark.checkpoint.dir``;
only where that is unset and the master is local (tests, a laptop) a temporary folder is
made instead.  On a cluster an unset folder is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or one of our own where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="pathloom-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/pathloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


#: Rows up to which a table of few numbers a row may be sent to every executor.
FEW = 1 << 18


def unless_many(df: DataFrame) -> DataFrame:
    """``df``, which is read from files, to be joined by moving both sides if it has more than ``FEW`` rows.

    The optimizer knows such a table by the bytes of its files.  Packed numbers take a byte or
    two a row there and fifty once they are sent, through the driver, to all executors.
    """
    return df.hint("merge") if df.count() > FEW else df


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize`; the frame can't be read afterwards."""
    path = getattr(df, "_pathloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
