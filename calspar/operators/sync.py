"""Sync of calendars as a plan of actions: a set difference of desired and existing dates per stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plan(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(stream, d, action): delete what isn't desired, add what isn't there, retry desired dates in error. A stream without desired dates gets no actions."""
    wanted = desired.select("stream", "d").distinct().withColumn("want", F.lit(True))
    both = wanted.join(existing.select("stream", "d", "status"), ["stream", "d"], "full_outer")
    action = F.when(F.col("want").isNull(), "delete").when(F.col("status").isNull(), "add").when(F.col("status") == "error", "retry")
    live = wanted.select("stream").distinct()
    return both.select("stream", "d", action.alias("action")).filter("action is not null").join(live, "stream", "left_semi")


def counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("stream").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("delete", "add", "retry")])


def apply_results(existing: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Event rows after the actions: results (stream, d, action, ok, event_id, error_message). Deletes go whether they worked or not."""
    kept = existing.join(results.select("stream", "d"), ["stream", "d"], "left_anti")
    done = results.filter("action <> 'delete'").select(
        "stream", "d", F.when(F.col("ok"), "created").otherwise("error").alias("status"), F.when(F.col("ok"), F.col("event_id")).alias("event_id"), F.when(~F.col("ok"), F.col("error_message")).alias("error_message")
    )
    return kept.unionByName(done, allowMissingColumns=True).withColumn("updated_at", now)
