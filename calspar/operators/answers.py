"""A cache of answers that is only ever added to: entries, and a log of when each was last used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store


class AnswerCache:
    """Entries (key columns, parsed_result, tokens_used, created_at) and touches (key columns, used_at) in two folders under root.

    A later entry of a key takes the place of an earlier one. A read adds a touch for each key that it finds and rewrites
    nothing, so readers and writers don't hinder each other.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys

    def _read(self, name: str, rest: str) -> DataFrame:
        schema = ", ".join([f"{k} string" for k in self.keys] + [rest])
        versions = store.Versions(self.spark, self.root)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if versions.holds(f"{self.root}/{name}") else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, now: Column) -> None:
        """rows (key columns, parsed_result, tokens_used): the last of several rows of a key counts, by parsed_result."""
        once = store.latest(rows.select(*self.keys, "parsed_result", F.col("tokens_used").cast("long").alias("tokens_used")), self.keys, ["parsed_result", "tokens_used"])
        store.append(once.withColumn("created_at", now.cast("timestamp")), f"{self.root}/entries")

    def entries(self) -> DataFrame:
        """One row per key with its present answer and `last_used_at`, no earlier than its entry."""
        entries = self._read("entries", "parsed_result string, tokens_used long, created_at timestamp")
        touches = self._read("touches", "used_at timestamp").groupBy(*self.keys).agg(F.max("used_at").alias("used_at"), F.count("*").alias("reads"))
        last = store.latest(entries, self.keys, ["created_at", "parsed_result"])
        joined = last.join(touches, self.keys, "left")
        return joined.select(*self.keys, "parsed_result", "tokens_used", "created_at", F.greatest("created_at", F.coalesce("used_at", "created_at")).alias("last_used_at"), F.coalesce("reads", F.lit(0)).alias("reads"))

    def get(self, wanted: DataFrame, now: Column) -> DataFrame:
        """The answers (key columns, parsed_result) of the wanted keys that are there, each once; they count as used now."""
        last = store.latest(self._read("entries", "parsed_result string, tokens_used long, created_at timestamp"), self.keys, ["created_at", "parsed_result"])
        found = store.written(last.select(*self.keys, "parsed_result").join(wanted.select(*self.keys).distinct(), self.keys, "left_semi"))
        store.append(found.select(*self.keys, now.cast("timestamp").alias("used_at")), f"{self.root}/touches")
        return found
