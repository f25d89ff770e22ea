"""Tables that several jobs read, written once to the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
#: Whether a query's shuffle files go when it ends, instead of when the driver collects its garbage.
_ENDS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A folder of this application in ``spark.checkpoint.dir``, deleted when the driver
    ends; a local session without that setting gets one of its own."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        top = context.getConf().get("spark.checkpoint.dir", None)
        if not top and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = f"{top.rstrip('/')}/depsift-counts-{app}" if top else f"file://{tempfile.mkdtemp(prefix='depsift-')}"
        atexit.register(_clear, *_place(spark, _folders[app]))
    return _folders[app]


def _place(spark: SparkSession, path: str) -> tuple:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _clear(files, path) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        files.delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back; its shuffles end with the write."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_ENDS, "false")
    spark.conf.set(_ENDS, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ENDS, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and no later plan reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        files, place = _place(df.sparkSession, path)
        files.delete(place, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)
