"""Runs of a stream that take what has arrived and stop; the next run goes on from the checkpoint."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import latest

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, so that it needn't fit in memory. The given session's settings stay as they are."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


def arriving(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """Rows of the Parquet files that arrive in a folder, so many files a batch at most; each file is read once over all runs."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def drain(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes everything that has arrived into the table at `folder` and stops. A run that is cut off leaves nothing that readers see twice: Spark's file sink lists the files of whole batches only."""
    query = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def micros(when: datetime.datetime) -> int:
    """A row's time as a number: states keep times as numbers, as rows and states may or may not name the zone."""
    return round(when.timestamp() * 1_000_000)


def moment(us: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(us / 1_000_000)


def last_rows(log: DataFrame, key: list[str]) -> DataFrame:
    """The last row of each key in a log whose rows are numbered by `n`."""
    return latest(log, key, ["n"])
