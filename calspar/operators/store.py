"""Tables without MERGE: upserts as joins, replacement by partition, versions behind a pointer."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one only in local mode."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="calspar-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder that nothing else uses, in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df computed once into the checkpoint folder that the cluster names, for plans that read it in several places."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_files(df: DataFrame) -> DataFrame:
    """df computed once into a table of its own in the shared folder: unlike a checkpoint's, its size is that of its files, so that a small one is broadcast and a large table that it is joined with isn't shuffled."""
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def same_key(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality, so that a null in a key doesn't make every run add its row again."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def latest(source: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order."""
    rest = [c for c in source.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else None
    return source.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source, and those of target whose key source lacks. source must hold each key once."""
    return target.join(source.select(keys), same_key(target, source, keys), "left_anti").unionByName(source)


def upsert_groups(target: DataFrame, source: DataFrame, now: Column) -> DataFrame:
    """Groups by id: a new one is added; a known one takes the new dates, and loses its sync time, only if its pattern differs."""
    old, new = target.alias("o"), source.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    changed = F.col("n.id").isNotNull() & (F.col("o.id").isNull() | ~F.col("o.dates_hash").eqNullSafe(F.col("n.dates_hash")))
    taken = ["waste_type", "kaimai_hash", "dates", "dates_hash", "first_date", "last_date", "date_count"]
    return joined.select(
        F.coalesce("o.id", "n.id").alias("id"),
        *[F.when(changed, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in taken],
        F.when(~changed, F.col("o.calendar_synced_at")).alias("calendar_synced_at"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(changed, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def surrogate_ids(rows: DataFrame, keys: list[str], first: int = 1) -> DataFrame:
    """Dense ids in key order, found in two passes: counts of range partitions, then numbers within each.

    The partition's number is written down once, in a checkpoint, as both passes must see the same one.
    """
    spread = rows.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_p", F.spark_partition_id())
    spread = written(spread)
    counts = spread.groupBy("_p").agg(F.count("*").alias("_n"))
    bases = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = spread.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    return numbered.join(F.broadcast(bases), "_p").withColumn("id", F.col("_base") + F.col("_k") + (first - 1)).drop("_p", "_n", "_k", "_base")


def replace_partition(rows: DataFrame, path: str, column: str = "source_file") -> None:
    """Writes rows so that each value of the column that occurs replaces what the table held for it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def set_value(table: DataFrame, key: str, value, **changes: Column) -> tuple[DataFrame, bool]:
    """The table with columns changed in the row of a key, and whether there is such a row."""
    hit = F.col(key) == value
    out = table.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])
    return out, not table.filter(hit).limit(1).isEmpty()


class Conflict(RuntimeError):
    """Another writer has committed since the tables were read."""


class Versions:
    """Several tables that change together: each commit writes a folder of its own, then a small file COMMITTED-<number> that names it.

    A reader sees the folder that the highest number names. Such a file is made by one writer only and never overwritten,
    and no two commits share a folder: a commit that fails, loses or is cut off at any point leaves what readers see as it
    was. A file without a name in it, left by a writer that was cut off just then, counts for nothing but its number.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        return sorted((int(n.removeprefix("COMMITTED-")) for n in self.names() if n.startswith("COMMITTED-")), reverse=True)

    def _folder(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{self.root}/COMMITTED-{number}"))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def holds(self, path: str) -> bool:
        """Whether a file or folder of the same store is there."""
        return self._fs.exists(self._path(path))

    def names(self) -> list[str]:
        """What lies directly under root."""
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))] if self.holds(self.root) else []

    def current(self) -> int:
        """The version that readers see; 0 before the first commit."""
        return next((n for n in self._numbers() if self._folder(n)), 0)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._folder(version or self.current())}/{name}")

    def commit(self, tables: dict[str, DataFrame], check: Callable[[str], None] | None = None, base: int | None = None) -> int:
        """Writes all tables, runs `check` on their folder, then commits it; if anything fails the folder goes.

        base: the version that the tables were made from. Conflict: another one was committed since.
        """
        folder = f"v-{uuid.uuid4().hex}"
        base = self.current() if base is None else base
        try:
            for name, table in tables.items():
                table.write.parquet(f"{self.root}/{folder}/{name}")
            if check:
                check(f"{self.root}/{folder}")
            version = max(self._numbers(), default=0) + 1
            if self.current() != base:
                raise Conflict(f"version {self.current()} was committed since version {base} was read")
            if not self._claimed(version, folder):
                raise Conflict(f"version {version} was committed by another writer")
        except BaseException:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        return version

    def _claimed(self, version: int, folder: str) -> bool:
        """Makes the file of a version, unless another writer has."""
        path = self._path(f"{self.root}/COMMITTED-{version}")
        try:
            out = self._fs.create(path, False)
        except Exception:
            if self._fs.exists(path):
                return False
            raise
        try:
            out.write(bytearray(folder.encode()))
        finally:
            out.close()
        return True


def month_export(rows: DataFrame, keys: list[str], month: str = "month", days: str = "days") -> DataFrame:
    """One line per key with a column of day lists ("2 d., 16 d.") for each of twelve months: the CSV export."""
    from ..functions.dates import MONTHS, day_list

    listed = rows.withColumn("_text", day_list(F.array_sort(F.array_distinct(days))))
    return listed.groupBy(*keys).pivot(month, MONTHS).agg(F.first("_text"))
