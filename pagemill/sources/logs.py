"""The event log: JSON lines, one folder a UTC day."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import FIELDS


def append_events(events: DataFrame, path: str) -> None:
    """Add events (with t) to the log; each lands in the folder of its day."""
    events.withColumn("day", F.to_date("t")).write.partitionBy("day").mode("append").json(path)


def _day_bytes(spark: SparkSession, path: str, batch: int) -> dict[str, int]:
    """Bytes of each day's files, without those of one batch."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, int] = {}
    for status in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")) or []:
        where = status.getPath()
        if where.getParent().getName() != f"batch={batch}":
            out[where.getName()[4:]] = out.get(where.getName()[4:], 0) + fs.getContentSummary(where).getLength()
    return out


def append_batch(events: DataFrame, path: str, batch: int, most_bytes: int = 25 << 20) -> None:
    """Add a batch of events to the log, once: a batch that is written again replaces itself.

    Days whose files have passed most_bytes take no more, so that a flood cannot fill the volume.
    """
    full = [day for day, size in _day_bytes(events.sparkSession, path, batch).items() if size > most_bytes]
    rows = events.withColumn("day", F.to_date("t")).filter(F.col("day").isNotNull())
    rows.filter(~F.col("day").cast("string").isin(full)).write.partitionBy("day").mode("overwrite").json(f"{path}/batch={batch}")


def append_stream_once(events: DataFrame, path: str, checkpoint: str, most_bytes: int = 25 << 20):
    """The same log as a stream's sink: batches that a restart replays add nothing."""
    return events.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, path, batch, most_bytes)).option("checkpointLocation", checkpoint).start()


def read_events(spark: SparkSession, path: str, today: date, days: int, most: int | None = None) -> DataFrame:
    """Events of the last `days` days; only their folders are listed, blank and broken lines are skipped.

    most: the newest so many events only (a bound of the report, not of the log).
    """
    schema = ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", day date, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.filter(F.col("day").between(today - timedelta(days=days - 1), today)).filter("_broken IS NULL AND t IS NOT NULL").drop("_broken")
    return rows if most is None else rows.orderBy(F.desc("t")).limit(most)


def drop_old_days(spark: SparkSession, path: str, today: date, keep: int = 90) -> list[str]:
    """Remove the folders of days more than `keep` days back; returns the days."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < str(today - timedelta(days=keep)):
            fs.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def append_stream(events: DataFrame, path: str, checkpoint: str):
    """The same log as a stream's sink."""
    return events.withColumn("day", F.to_date("t")).writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).start()
