"""Pieces that several corpus operators use: word pattern, tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder of this application for intermediate tables, deleted when the driver ends.

    It lies in what ``spark.checkpoint.dir`` names.  Only a local session may do
    without that setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _folders:
        top = context.getConf().get("spark.checkpoint.dir", None)
        if not top and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = f"{top.rstrip('/')}/depsift-{app}" if top else f"file://{tempfile.mkdtemp(prefix='depsift-')}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[app])
        atexit.register(_clear, path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
    return _folders[app]


def _clear(files, path) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended first
        files.delete(path, True)


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once and read it back: later jobs neither recompute it nor see
    other values, whichever executors are lost."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to; it
    does so after the driver has collected its garbage.  References from Python go
    first, those that they held in the JVM in a later turn."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it, once a session."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="depsift-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))


def drop_kept(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote and no later plan reads."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  For texts of ASCII only, ``lower`` does
    the same and is far cheaper than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))
