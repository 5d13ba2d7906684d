"""A streaming source of files that have changed: unchanged ones are told by their metadata and not opened.

An offset of the source names a listing: the tags (time of change and size) of all files of a folder. A batch reads the files
whose tags differ between two listings, so a run after nothing has changed reads nothing. Listings are kept in a folder of
their own under the hash of what they say; offsets stay small however many files there are.

The folder may lie in any store that pyarrow reads by its address. A file that has changed is read whole by one task.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "name string, tag string, content_hash string, content binary"
#: Files are read in groups of so many bytes at most; a larger one stands alone.
GROUP_BYTES = 64 << 20


def opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if ":/" in address else f"file://{address}")


def listing(folder: str, pattern: str = "*") -> dict[str, list]:
    """name -> [tag, size] of the files under a folder whose last part fits the pattern; those with a part that begins with a dot or an underscore don't count."""
    store, root = opened(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    named = [(f.path[len(root) :].lstrip("/"), f) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)]
    return {name: [f"{f.mtime_ns}-{f.size}", f.size] for name, f in named if not any(part.startswith((".", "_")) for part in name.split("/"))}


@dataclass
class Files(InputPartition):
    """Names of files, with the tags under which they were listed."""

    names: list[tuple[str, str]]


class ChangedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.state, self.pattern = options["path"], options["state"], options.get("pattern", "*")

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        said = json.dumps(listing(self.folder, self.pattern), sort_keys=True).encode()
        name = hashlib.sha256(said).hexdigest()
        store, root = opened(self.state)
        path = f"{root}/{name}.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{path}.part") as out:
                out.write(said)
            store.move(f"{path}.part", path)  # a listing is there as a whole or not at all
        return {"listing": name}

    def said(self, offset: dict) -> dict[str, list]:
        if not offset["listing"]:
            return {}
        store, root = opened(self.state)
        with store.open_input_file(f"{root}/{offset['listing']}.json") as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> list[Files]:
        before = self.said(start)
        changed = sorted((name, *row) for name, row in self.said(end).items() if row[0] != before.get(name, [None])[0])
        groups: list[Files] = []
        held = 0
        for name, tag, size in changed:
            if not groups or held + size > GROUP_BYTES:
                groups.append(Files([]))
                held = 0
            groups[-1].names.append((name, tag))
            held += size
        return groups

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = opened(self.folder)
        for name, tag in partition.names:
            try:
                with store.open_input_stream(f"{root}/{name}") as f:
                    content = f.read()
            except FileNotFoundError:
                continue  # gone since it was listed: the next listing says so
            yield name, tag, hashlib.sha256(content).hexdigest(), content


class ChangedFiles(DataSource):
    """format("changed_files") with the options path, state (a folder that only this stream uses) and pattern."""

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangedReader:
        return ChangedReader(dict(self.options))


def changed_files(spark: SparkSession, folder: str, state: str, pattern: str = "*") -> DataFrame:
    """(name, tag, content_hash, content) of each file when it is new or its tag has changed."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("path", folder).option("state", state).option("pattern", pattern).load()


def fetches(files: DataFrame) -> DataFrame:
    """files with `seen`, the number of times that the same content of the same file was read before: only rows where it is 0 need parsing. Moves the content of what has changed once."""
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)

    def count(key: tuple, tables: Iterator, state) -> Iterator:
        n = state.get[0] if state.exists else 0
        for table in tables:
            table["seen"] = range(n, n + len(table))
            n += len(table)
            yield table
        state.update((n,))

    return files.groupBy("name", "content_hash").applyInPandasWithState(count, f"{kind}, seen long", "n long", "append", "NoTimeout")


def write_files(rows: DataFrame, folder: str) -> None:
    """Writes each row (name string, content binary) as a file of its own, whole or not at all, in place of one of that name."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                path = f"{root}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden) as out:
                    out.write(content.as_py() or b"")
                store.move(hidden, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()
