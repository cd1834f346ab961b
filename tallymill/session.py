"""Sessions, and the shared folder in which lineage is cut.

Intermediate results that several jobs reuse are written as Parquet tables below the folder that the
cluster names in ``spark.checkpoint.dir``. A table in a shared folder outlives any executor, is
columnar and compressed, and can be read in part; an RDD checkpoint is none of these three.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A session for one machine: tests, benchmarks, trials."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tallymill").config("spark.driver.memory", memory)
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    if partitions is None:
        partitions = 8 if cores == "*" else int(cores)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, as in tests, one of our own.

    A folder of this machine serves a local session only; other machines could not read it.
    """
    set_already = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if set_already:
        return set_already.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tallymill-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    _own[spark.sparkContext.applicationId] = f"file://{own}"
    return f"file://{own}"


_own: dict[str, str] = {}  # by application
_tables: dict[str, Any] = {}  # written and not removed yet: the path, and the settings of its file system


def cut(df: DataFrame, name: str = "t", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts anew from that table.

    ``replaces`` is an earlier such table that nothing reads any more; it is removed at once. All
    others are removed when the driver's Python ends, on whatever file system they lie.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(remove_all)
    _tables[path] = spark
    if replaces is not None:
        remove(replaces)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallymill_path = path
    return out


def remove(table: DataFrame | str) -> None:
    """Remove a table of ``cut``; of any other frame, nothing."""
    path = table if isinstance(table, str) else getattr(table, "_tallymill_path", None)
    spark = _tables.pop(path, None)
    if spark is None:
        return
    if path.startswith("file://"):
        shutil.rmtree(path[len("file://") :], ignore_errors=True)
        return
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session's JVM has ended: the cluster's own clean-up has to do it
        return


def remove_all() -> None:
    for path in list(_tables):
        remove(path)


def cores_of(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)
