"""What several operators share: lineage cuts, size-checked broadcasts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch going back to Spark holds at most (a single longer row stands alone).
BATCH_ROWS, BATCH_BYTES = 4096, 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only in local mode, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") and not context._jsc.sc().getCheckpointDir().isDefined():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="calspar-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder, so that losing an executor recomputes nothing above it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Tables of a loop, written into a folder of their own in the shared one and read again.

    A checkpoint carries its plan's estimated size on. Joins multiply these sizes, so in a loop of joins over checkpoints
    the estimate's digits double from turn to turn, until the driver is full of them; a table that is read has the size of its files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.made = spark, f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """df computed into a checkpoint; all tables are deleted."""
        out = cut(df)
        deleted(self.spark, self.folder)
        return out


#: A side is broadcast only when its counted rows times its row width stay below this.
BROADCAST_BYTES = 32 << 20


def sized(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`small` (cheap to count: a checkpoint) with a broadcast hint if its counted size allows it, else as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that stays a shuffled one however small its sides: loops of many small joins would build each right side in the driver."""
    return left.join(right.hint("merge"), on, how)


def deleted(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of a store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_rows(work: Callable[..., Iterable[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: work(*columns of one row) gives output rows; batches are bounded in rows and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            columns = batch.columns
            for i in range(batch.num_rows):
                for row in work(*(c[i].as_py() for c in columns)):
                    rows.append(row)
                    held += sum(len(v) for v in row if isinstance(v, (bytes, str)))
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield as_batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield as_batch(rows, schema)

    return run


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def slices(batch: pa.RecordBatch, column: int, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose binary column holds about `limit` bytes each (one longer row stands alone)."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)
