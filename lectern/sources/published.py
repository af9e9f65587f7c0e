"""Published artefacts: a data source whose writes are seen whole or not at all.

A folder holds parts and manifests. Tasks write their parts below a hidden folder of the write; when all have succeeded the folder
gets its name, and one new manifest, written beside and renamed, names the parts, the schema and the provenance.
Readers take the newest manifest, so until that rename they see what was there before, and afterwards all
of the new. A failed write removes its folder; parts of attempts that were not committed are in no manifest. What tasks that outlive a failed
write still leave is hidden, and goes with a later write once it is ``STALE`` seconds old.

``spark.dataSource.register(Published)`` makes it ``format("published")``. Options: ``path``, a folder that every executor and
the driver reach (a path, or any location that Arrow opens); ``provenance``, a JSON object that says what the figures come from, without
which nothing is written; ``keep``, how many manifests stay with their parts (2 at least).
"""

from __future__ import annotations

import itertools
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA_VERSION = 1
MANIFEST = "manifest-"
STALE = 86_400


def _located(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _names(files: pafs.FileSystem, folder: str) -> list[str]:
    return sorted(f.base_name for f in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)))


def _manifests(files: pafs.FileSystem, folder: str) -> list[str]:
    return [n for n in _names(files, folder) if n.startswith(MANIFEST)]


def _manifest(files: pafs.FileSystem, folder: str, name: str) -> dict:
    with files.open_input_stream(f"{folder}/{name}") as f:
        return json.loads(f.read())


def manifest(path: str) -> dict | None:
    """The newest manifest of a folder; None where nothing was published."""
    files, folder = _located(path)
    found = _manifests(files, folder)
    return _manifest(files, folder, found[-1]) if found else None


@dataclass
class Part(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def _newest(self) -> dict:
        found = manifest(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.options['path']}")
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"artefact of schema version {found['schema_version']}, not {SCHEMA_VERSION}")
        return found

    def schema(self) -> StructType:
        return StructType.fromJson(self._newest()["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PublishedReader(self.options["path"], [p["name"] for p in self._newest()["parts"]], schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        told = json.loads(self.options.get("provenance") or "null")
        if not isinstance(told, dict) or not told:
            raise ValueError("an artefact without provenance is not written: give the option provenance, a JSON object")
        return PublishedWriter(self.options["path"], schema.jsonValue(), told, overwrite, max(2, int(self.options.get("keep", "2"))))


class PublishedReader(DataSourceReader):
    def __init__(self, path: str, parts: list[str], names: list[str]) -> None:
        self.path, self.parts, self.names = path, parts, names

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.parts]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition is None or not self.parts:
            return
        files, folder = _located(self.path)
        with files.open_input_file(f"{folder}/{partition.name}") as f:
            yield from pq.ParquetFile(f).iter_batches(columns=self.names)


class PublishedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: dict, provenance: dict, overwrite: bool, keep: int) -> None:
        self.path, self.schema, self.provenance, self.overwrite, self.keep = path, schema, provenance, overwrite, keep
        self.write_id = uuid.uuid4().hex
        if not overwrite:
            had = manifest(path)
            if had is not None and had["schema"] != schema:
                raise ValueError("rows of another schema cannot be added to an artefact")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _located(self.path)
        task = TaskContext.get()
        name, rows = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet", 0
        first = next(iterator, None)
        if first is None:
            return Written("", 0)
        files.create_dir(f"{folder}/.{self.write_id}", recursive=True)
        with files.open_output_stream(f"{folder}/.{self.write_id}/{name}") as sink, pq.ParquetWriter(sink, first.schema) as out:
            for batch in itertools.chain((first,), iterator):
                out.write_batch(batch)
                rows += batch.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = _located(self.path)
        files.create_dir(f"{folder}/.{self.write_id}", recursive=True)
        files.move(f"{folder}/.{self.write_id}", f"{folder}/{self.write_id}")
        parts = [{"name": f"{self.write_id}/{m.name}", "rows": m.rows} for m in messages if m is not None and m.name]
        found = _manifests(files, folder)
        had = _manifest(files, folder, found[-1]) if found else None
        if had and not self.overwrite:
            parts = had["parts"] + parts
        number = int(found[-1].removeprefix(MANIFEST).split("-")[0]) + 1 if found else 1
        made = {"schema_version": SCHEMA_VERSION, "provenance": self.provenance, "rows": sum(p["rows"] for p in parts), "parts": parts, "schema": self.schema}
        name = f"{MANIFEST}{number:012d}-{self.write_id}.json"
        with files.open_output_stream(f"{folder}/.{name}") as f:
            f.write(json.dumps(made).encode())
        files.move(f"{folder}/.{name}", f"{folder}/{name}")
        self._tidy(files, folder)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = _located(self.path)
        if files.get_file_info(f"{folder}/.{self.write_id}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{folder}/.{self.write_id}")

    def _tidy(self, files: pafs.FileSystem, folder: str) -> None:
        """Delete manifests before the last ``keep``, and parts that no manifest left names."""
        found = _manifests(files, folder)
        for name in found[: -self.keep]:
            files.delete_file(f"{folder}/{name}")
        named = {p["name"].split("/")[0] for name in found[-self.keep :] for p in _manifest(files, folder, name)["parts"]}
        for f in files.get_file_info(pafs.FileSelector(folder)):
            spent = not f.base_name.startswith((".", MANIFEST)) and f.base_name not in named
            stale = f.base_name.startswith(".") and f.mtime is not None and time.time() - f.mtime.timestamp() > STALE
            if f.type == pafs.FileType.Directory and (spent or stale):
                files.delete_dir(f.path)


def publish(rows: DataFrame, path: str, provenance: dict, violations: DataFrame | None = None, append: bool = False) -> None:
    """Write ``rows`` as the artefact in ``path``; nothing is written while ``violations`` has rows."""
    if violations is not None and (told := violations.limit(5).collect()):
        raise ValueError("not published: " + "; ".join(str(r.asDict()) for r in told))
    rows.sparkSession.dataSource.register(Published)
    rows.write.format("published").mode("append" if append else "overwrite").option("path", path).option("provenance", json.dumps(provenance)).save()
