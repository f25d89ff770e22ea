"""Counts that follow a stream: contingency tables are sums, so they can be maintained.

The stream side keeps a count for each pattern and right side; scores stay batch jobs
over the maintained table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_contingency(stream: DataFrame, lhs: Sequence[str], rhs: str, *, event_time: str | None = None, window: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """(window), lhs..., rhs, k over a stream.  With an event time and a window, state is
    dropped once the watermark has passed a window; without, it grows with the patterns."""
    rows = stream
    for c in lhs:
        rows = rows.where(F.col(c).isNotNull())
    by = [*(F.col(c) for c in lhs), F.col(rhs).alias("rhs")]
    if event_time and window:
        rows = rows.withWatermark(event_time, lateness)
        by.insert(0, F.window(event_time, window).alias("window"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))


def start(counts: DataFrame, folder: str, *, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Write every state of the counts below ``folder``, as a table of its own for each
    batch, by the executors; ``current`` reads the newest that is whole."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")

    writer = counts.writeStream.foreachBatch(write).outputMode(mode)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest finished table of ``start``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()) for s in files.listStatus(top) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{folder}/{max(done)}")
