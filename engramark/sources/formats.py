"""Spark data sources for workload files and run artifacts: ``spark.read.format("workload")`` and ``df.write.format("artifacts")``.

register() makes them known to a session. Files are reached through Arrow's file
systems, by URI or local path; folders must be reachable by the driver and all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMS = "seq long, source_id string, input string, oracle string"
ARTIFACTS = "name string, body string"
#: Entries of a file that one partition reads.
ENTRIES = 5000


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _read(path: str) -> dict:
    system, where = _at(path)
    with system.open_input_stream(where) as f:
        return json.loads(f.read())


def _properties(entry: dict) -> Iterator[tuple]:
    yield from (("default", form, entry["label"]) for form in [entry["label"], *(entry.get("aliases") or [])])


def _surfaces(entry: dict) -> Iterator[tuple]:
    for c in entry["candidates"]:
        label = [c["actual_label"]] if c["actual_label"].lower() != entry["surface"].lower() else []
        yield from ((c["domain"], form, c["actual_label"]) for form in [entry["surface"], *label, *(c.get("aliases") or [])])


def _tags(entry: dict) -> Iterator[tuple]:
    yield from ((entry["source"], t, t) for t in entry.get("related_tags") or [])
    yield from ((entry["source"], a, b) for a, b in entry.get("synonyms") or [])


#: By kind of file: the name of its list of entries, and the (source, form, canonical) of one.
KINDS = {"properties": ("properties", _properties), "surfaces": ("surfaces", _surfaces), "tags": ("by_source", _tags)}


class Slice(InputPartition):
    """Entries first to last of a file, whose forms are numbered from ``seq``."""

    def __init__(self, first: int, last: int, seq: int) -> None:
        self.first, self.last, self.seq = first, last, seq


class WorkloadReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "properties")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}, got {self.kind!r}")

    def partitions(self) -> list[Slice]:
        name, forms = KINDS[self.kind]
        entries, out, seq = _read(self.path)[name], [], 0
        for first in range(0, len(entries), ENTRIES):
            out.append(Slice(first, min(first + ENTRIES, len(entries)), seq))
            seq += sum(1 for e in entries[first : first + ENTRIES] for _ in forms(e))
        return out or [Slice(0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        name, forms = KINDS[self.kind]
        rows = (row for e in _read(self.path)[name][partition.first : partition.last] for row in forms(e))
        for k, row in enumerate(rows, partition.seq):
            yield (k, *row)


class Workload(DataSource):
    """A workload file in JSON as (seq, source_id, input, oracle); option ``kind`` says which, ``path`` where."""

    @classmethod
    def name(cls) -> str:
        return "workload"

    def schema(self) -> str:
        return FORMS

    def reader(self, schema) -> WorkloadReader:
        return WorkloadReader(self.options)


class Written(WriterCommitMessage):
    """Files that a task has staged."""

    def __init__(self, files: list[str]) -> None:
        self.files = files


class ArtifactWriter(DataSourceWriter):
    """Tasks write a file for each row into a folder of the run's own; commit moves them to their names, and then the list of them, which readers go by."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def _staged(self) -> tuple[fs.FileSystem, str]:
        system, where = _at(self.path)
        return system, f"{where}/_staged-{self.run}"

    def write(self, rows: Iterator) -> Written:
        system, staged = self._staged()
        system.create_dir(staged, recursive=True)
        files = []
        for row in rows:
            name = f"{uuid.uuid4().hex}-{row['name']}.json"
            with system.open_output_stream(f"{staged}/{name}") as f:
                f.write((row["body"] or "").encode())
            files.append(name)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, staged = self._staged()
        _, where = _at(self.path)
        # Only what the tasks that succeeded report: leftovers of failed attempts stay behind and go.
        files = [name for m in messages if m for name in m.files]
        before = [] if self.overwrite else _committed(self.path)
        system.create_dir(f"{where}/run-{self.run}", recursive=True)
        for name in files:
            system.move(f"{staged}/{name}", f"{where}/run-{self.run}/{name}")
        with system.open_output_stream(f"{where}/_list-{self.run}") as f:
            f.write(json.dumps(before + [f"run-{self.run}/{name}" for name in files]).encode())
        # The one step after which readers see the run, whole.
        system.move(f"{where}/_list-{self.run}", f"{where}/_list")
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)

    def abort(self, messages: list[Written | None]) -> None:
        system, staged = self._staged()
        if system.get_file_info(staged).type != fs.FileType.NotFound:
            system.delete_dir(staged)


def _committed(path: str) -> list[str]:
    system, where = _at(path)
    if system.get_file_info(f"{where}/_list").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{where}/_list") as f:
        return json.loads(f.read())


class ArtifactReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        files = _committed(self.path)
        return [InputPartition(files[k : k + ENTRIES]) for k in range(0, len(files), ENTRIES)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, where = _at(self.path)
        for name in partition.value:
            with system.open_input_stream(f"{where}/{name}") as f:
                # A file's name begins with 32 hexadecimal digits and a hyphen.
                yield name.rpartition("/")[2][33:].removesuffix(".json"), f.read().decode()


class Artifacts(DataSource):
    """JSON documents (name, body) of runs below a folder; a run that wasn't committed isn't there, however far it came."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return ARTIFACTS

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    for source in (Workload, Artifacts):
        spark.dataSource.register(source)
