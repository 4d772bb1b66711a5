"""Session settings for local runs and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows of the largest table for each partition of a shuffle: a task that sorts them several times takes some hundred MB.
ROWS_A_PARTITION = 1 << 18
#: Bytes of small partitions that adaptive execution may join to one. Rows of few numbers take twenty there, and hundreds once they are sorted.
JOINED_BYTES = "8m"


def session_for(spark: SparkSession, rows: int) -> SparkSession:
    """``spark``, or for very many rows a session beside it, with its settings but more partitions in a shuffle.

    The settings of ``spark`` stay as they are.  Where one of them can't be given to another
    session, ``spark`` itself is returned.
    """
    n = -(-rows // ROWS_A_PARTITION)
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    own = spark.newSession()
    known = own.conf.getAll
    try:
        for key, value in spark.conf.getAll.items():
            if known.get(key) != value:
                own.conf.set(key, value)
    except PySparkException:
        return spark
    own.conf.set("spark.sql.shuffle.partitions", str(n))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", JOINED_BYTES)
    # Steps lie by path: a join on the path and more does not move them again.
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors unless their PYTHONPATH already has it."""
    sc = spark.sparkContext
    known = f"{sc._jvm.System.getenv('PYTHONPATH') or ''}{os.pathsep}{sc.environment.get('PYTHONPATH', '')}"
    if ROOT in known.split(os.pathsep) or getattr(sc, "_pathloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="pathloom-src-"), "pathloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(os.path.join(ROOT, "pathloom")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(target)
    sc._pathloom_shipped = True
