"""Payload files with a commit protocol, as a data source: ``format("payload_files")``.

Rows are (name, page, body). A writing task puts each payload into a file of its own in a folder of the
job that readers don't look at; when all tasks are done, the driver writes the job's manifest, which names
the files, by one rename. A task that fails, or runs twice, leaves files that no manifest names. Readers
go through the manifests that are there: a job's payloads are all seen, or none. Paths are opened by
Arrow's file systems, so every worker must reach ``path``.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, page int, body string"
#: Files that a reading task opens.
FILES = 200


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, where = pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)
    return fs, where.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str | None, int, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, where = _opened(self.path)
        files = []
        for row in iterator:
            label = urllib.parse.quote(row["name"] or "", safe="")[:100]
            name = f"{self.job}/{label}-{row['page']}-{uuid.uuid4().hex}.json"
            fs.create_dir(f"{where}/data/{self.job}", recursive=True)
            with fs.open_output_stream(f"{where}/data/{name}", compression=None) as out:
                out.write((row["body"] or "").encode("utf-8"))
            files.append((row["name"], row["page"], name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = _opened(self.path)
        fs.create_dir(f"{where}/manifests", recursive=True)
        old = fs.get_file_info(pyarrow.fs.FileSelector(f"{where}/manifests")) if self.overwrite else []
        pending = f"{where}/manifests/.{self.job}"
        with fs.open_output_stream(pending, compression=None) as out:
            for message in messages:
                for entry in message.files if message else []:
                    out.write(json.dumps(entry).encode() + b"\n")
        fs.move(pending, f"{where}/manifests/{self.job}.jsonl")
        for info in old:
            fs.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = _opened(self.path)
        if fs.get_file_info(f"{where}/data/{self.job}").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{where}/data/{self.job}")


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str | None, int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        fs, where = _opened(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(f"{where}/manifests", allow_not_found=True))
        files = []
        for info in sorted(found, key=lambda i: i.path):
            if info.base_name.endswith(".jsonl"):
                with fs.open_input_stream(info.path, compression=None) as lines:
                    files += [tuple(json.loads(line)) for line in lines.read().splitlines()]
        return [_Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        fs, where = _opened(self.path)
        for name, page, file in partition.files:
            with fs.open_input_stream(f"{where}/data/{file}", compression=None) as data:
                yield name, page, data.read().decode("utf-8")


class PayloadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
