"""Mapping of names to the canonical ones, from a table of known mappings, and repair against the locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["seniunija", "village", "street"]


def apply(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """rows with mapped_<category> (the name itself where no mapping is known) and mapping_method of the village."""
    for c in CATEGORIES:
        own = mappings.filter(F.col("category") == c).select(F.col("source_value").alias(c), F.col("target_value").alias("_to"), F.col("mapping_method").alias("_how"))
        rows = rows.join(own, c, "left").withColumn(f"mapped_{c}", F.coalesce("_to", c))
        if c == "village":
            rows = rows.withColumn("mapping_method", F.coalesce("_how", F.lit("none")))
        rows = rows.drop("_to", "_how")
    return rows


def canonical_only(proposed: DataFrame, canonical: DataFrame) -> DataFrame:
    """Proposed mappings (category, source_value, target_value, ...) whose target isn't a canonical (category, value) get a null target."""
    known = canonical.select("category", F.col("value").alias("target_value"), F.lit(True).alias("_known")).distinct()
    joined = proposed.join(known, ["category", "target_value"], "left")
    return joined.withColumn("target_value", F.when(F.col("_known"), F.col("target_value"))).select(proposed.columns)


def unmapped(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """Distinct (category, source_value) that no mapping, not even an empty one, names."""
    values = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("source_value")) for c in CATEGORIES])).alias("x")).select("x.*")
    values = values.filter("source_value is not null and source_value <> ''").distinct()
    return values.join(mappings.select("category", "source_value"), ["category", "source_value"], "left_anti")


def fix_villages(rows: DataFrame, locations: DataFrame) -> DataFrame:
    """Where a row's place isn't a location, but exactly one village of the district has its street, that village replaces it."""
    place = locations.select(F.col("seniunija").alias("mapped_seniunija"), F.col("village").alias("mapped_village"), F.col("street").alias("mapped_street")).distinct()
    single = place.groupBy("mapped_seniunija", "mapped_street").agg(F.count_distinct("mapped_village").alias("n"), F.min("mapped_village").alias("_only")).filter("n = 1").drop("n")
    out = rows.join(place.withColumn("_known", F.lit(True)), ["mapped_seniunija", "mapped_village", "mapped_street"], "left").join(single, ["mapped_seniunija", "mapped_street"], "left")
    fix = F.col("_known").isNull() & F.col("_only").isNotNull()
    out = out.withColumn("mapped_village", F.when(fix, F.col("_only")).otherwise(F.col("mapped_village")))
    return out.withColumn("mapping_method", F.when(fix, F.concat("mapping_method", F.lit("+db_fixup"))).otherwise(F.col("mapping_method"))).select(rows.columns)
