"""Tables whose schema has a history: numbered steps, applied to older files when they are read.

A table's files lie in a folder for each version of its schema (`schema_version=<n>`). Rows are written in the present
version only; what was written before stays as it is, and is brought up to the present by the steps in between, as
column expressions that Spark plans with the rest of the query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import ids
from . import store


@dataclass(frozen=True)
class Step:
    """From one version of a schema to the next: what it does, in words, and how."""

    said: str
    apply: Callable[[DataFrame], DataFrame]


def add(name: str, kind: str, value: Callable[[], Column] | None = None) -> Step:
    """A new column, null or of a value made from the others. A file that has it already keeps its own."""

    def apply(df: DataFrame) -> DataFrame:
        return df if name in df.columns else df.withColumn(name, (value() if value else F.lit(None)).cast(kind))

    return Step(f"add {name} {kind}", apply)


def rename(old: str, new: str) -> Step:
    return Step(f"rename {old} to {new}", lambda df: df.withColumnRenamed(old, new))


def retype(name: str, kind: str, value: Callable[[], Column]) -> Step:
    """A column of another type, made from what it was."""
    return Step(f"make {name} {kind}", lambda df: df.withColumn(name, value().cast(kind)))


@dataclass(frozen=True)
class History:
    """A table's first schema and the steps since; version 1 is the first."""

    name: str
    first: str
    steps: tuple[Step, ...] = ()

    @property
    def version(self) -> int:
        return 1 + len(self.steps)

    def upgraded(self, rows: DataFrame, version: int) -> DataFrame:
        """Rows of a version as the present one has them."""
        for step in self.steps[version - 1 :]:
            rows = step.apply(rows)
        return rows

    def schema_of(self, spark: SparkSession, version: int) -> StructType:
        """The schema of a version, as the steps up to it give it."""
        rows = spark.createDataFrame([], _parse_datatype_string(self.first))
        for step in self.steps[: version - 1]:
            rows = step.apply(rows)
        return rows.schema


class Table:
    """A table of a history at a folder; readers see the present schema whatever the age of the files."""

    def __init__(self, spark: SparkSession, root: str, history: History):
        self.spark, self.root, self.history = spark, root.rstrip("/"), history
        self._store = store.Versions(spark, root)

    def folder(self, version: int) -> str:
        return f"{self.root}/schema_version={version}"

    def append(self, rows: DataFrame, version: int | None = None) -> None:
        """Adds rows in the present version, or, as a writer that wasn't brought up to date would, in an older one. Columns that rows lack are null; others don't count."""
        version = version or self.history.version
        schema = self.history.schema_of(self.spark, version)
        store.append(rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]), self.folder(version))

    def versions(self) -> list[int]:
        """The versions that files are there of. Newer ones than the present: this code is too old to read the table."""
        found = sorted(int(n.removeprefix("schema_version=")) for n in self._store.names() if n.startswith("schema_version="))
        if found and found[-1] > self.history.version:
            raise ValueError(f"{self.history.name} has files of version {found[-1]}; version {self.history.version} is the last that is known here")
        return found

    def read(self) -> DataFrame:
        present = self.history.schema_of(self.spark, self.history.version)
        out = self.spark.createDataFrame([], present)
        for version in self.versions():
            rows = self.spark.read.schema(self.history.schema_of(self.spark, version)).parquet(self.folder(version))
            out = out.unionByName(self.history.upgraded(rows, version).select(present.names))
        return out


def json_dates(name: str) -> Column:
    return F.from_json(F.col(name), "array<date>")


#: The tables of the model. Lists of dates were JSON texts once; the rows of files got their later columns one by one.
MODEL = {
    h.name: h
    for h in (
        History("locations", "id long, seniunija string, village string, street string, house_numbers string, kaimai_hash string, created_at timestamp, updated_at timestamp"),
        History(
            "groups", "id string, waste_type string, kaimai_hash string, first_date date, last_date date, date_count int, dates string, dates_hash string, created_at timestamp, updated_at timestamp",
            (add("calendar_synced_at", "timestamp"), retype("dates", "array<date>", lambda: json_dates("dates")), retype("date_count", "bigint", lambda: F.size("dates"))),
        ),
        History("streams", "id string, waste_type string, dates_hash string, dates array<date>, first_date date, last_date date, date_count long, calendar_id string, calendar_synced_at timestamp, pending_clean_started_at timestamp, pending_clean_until timestamp, pending_clean_notice_sent_at timestamp, created_at timestamp, updated_at timestamp"),
        History("links", "schedule_group_id string, calendar_stream_id string, created_at timestamp, updated_at timestamp"),
        History("events", "stream string, d date, event_id string, status string, error_message string, created_at timestamp, updated_at timestamp"),
        History("fetches", "kind string, source_url string, etag string, last_modified string, content_length long, content_hash string, status string, created_at timestamp"),
        History(
            "pdf_rows", "id long, source_file string, waste_type string, kaimai_hash string, kaimai_str string, village string, street string, house_numbers string, dates_json string",
            (
                add("exclude_streets", "array<struct<street:string,house_numbers:string>>", lambda: F.array()), add("source_year", "int"), add("seniunija", "string"), add("mapped_seniunija", "string"), add("mapped_village", "string"), add("mapped_street", "string"),
                add("mapping_method", "string", lambda: F.lit("none")), rename("dates_json", "dates"), retype("dates", "array<date>", lambda: json_dates("dates")),
                add("dates_hash", "string", lambda: ids.dates_hash(F.col("dates"))),
            ),
        ),
        History("mappings", "category string, source_value string, target_value string, mapping_method string, created_at timestamp, updated_at timestamp"),
        History("answers", "kaimai_hash string, waste_type string, parsed_result string, tokens_used long, created_at timestamp"),
    )
}


def open_model(spark: SparkSession, root: str) -> dict[str, Table]:
    """The model's tables under a folder; those without files are empty."""
    return {name: Table(spark, f"{root.rstrip('/')}/{name}", history) for name, history in MODEL.items()}
