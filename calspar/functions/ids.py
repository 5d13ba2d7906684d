"""Stable identities: content hashes of locations, date patterns, groups and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_hash(value: Column, n: int) -> Column:
    return F.substring(F.sha2(value, 256), 1, n)


def location_hash(raw: Column) -> Column:
    return F.concat(F.lit("k1_"), short_hash(raw, 12))


def group_id(waste_type: Column, location: Column) -> Column:
    """Never depends on dates, so a group keeps its id when its dates change."""
    return F.concat(F.lit("sg_"), short_hash(F.concat_ws(":", waste_type, location), 12))


def iso_dates(dates: Column) -> Column:
    """Sorted ISO strings; repeated dates stay."""
    return F.transform(F.array_sort(dates), lambda d: F.date_format(d, "yyyy-MM-dd"))


def dates_hash(dates: Column) -> Column:
    return F.when(F.coalesce(F.size(dates), F.lit(0)) <= 0, "").otherwise(short_hash(F.array_join(iso_dates(dates), ","), 16))


def stream_id(waste_type: Column, pattern: Column, generation: Column) -> Column:
    """Deterministic, so that a retried task gives the same id."""
    return F.concat(F.lit("cs_"), short_hash(F.concat_ws("|", waste_type, pattern, generation.cast("string")), 12))


def parser_cache_key(raw: Column) -> Column:
    return short_hash(raw, 16)
