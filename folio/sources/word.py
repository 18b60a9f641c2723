"""Folders of Word documents as a Spark data source, for tables and for streams.

`register(spark)`, then `spark.read.format("word").load(path)` or
`spark.readStream.format("word").option("log", folder).load(path)`: the rows are those of `docx.decode`.

The driver lists the folder once and packs files into partitions of about `partitionBytes`; tasks open the
files themselves, so no content passes through a shuffle or the JVM. Stores are those of pyarrow.fs (local, HDFS, S3, GCS).
Equalities and prefixes on `path` and `filename` prune files before any task starts; Spark needs
spark.sql.python.filterPushdown.enabled for that, which `register` sets.

A stream keeps a log beside its checkpoint: entry k names the files that belong to batch k, and an offset is the number
of the last entry. An entry is written before Spark learns of its number and never changes, so a restart
plans the same files for the same offsets, and a file that is in the log is never listed as new again.
Files count as new by path: publish them by a rename, and never write one in place. Names that begin with `.` or `_` are not read."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, fields

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folio import schemas
from folio.sources.docx import Limits, decoded_rows

#: Bytes of files that one task decodes, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 256 << 10
#: Files of a micro-batch.
PER_TRIGGER = 1000
_ENTRY = re.compile(r"^(\d+)\.json$")


@dataclass(frozen=True)
class File:
    path: str
    size: int


@dataclass
class Files(InputPartition):
    """What one task reads."""

    files: tuple[File, ...]


class Folder:
    """A folder in any store that pyarrow knows, with paths written as Spark writes them."""

    def __init__(self, uri: str) -> None:
        uri = re.sub(r"^file:/+", "/", uri)
        if "://" in uri:
            self.fs, self.root = fs.FileSystem.from_uri(uri)
            self.before = uri[: len(uri.rstrip("/")) - len(self.root.rstrip("/"))] if uri.rstrip("/").endswith(self.root.rstrip("/")) else uri.split("://")[0] + "://"
        else:
            self.fs, self.root, self.before = fs.LocalFileSystem(), posixpath.abspath(uri), "file:"

    def documents(self) -> list[File]:
        """All .docx files below, by path."""
        found = self.fs.get_file_info(self.root)
        infos = [found] if found.type == fs.FileType.File else self.fs.get_file_info(fs.FileSelector(self.root, recursive=True))
        hidden = lambda p: any(part.startswith((".", "_")) for part in p[len(self.root) :].split("/"))
        return sorted((File(self.before + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(".docx") and (i.path == self.root or not hidden(i.path))), key=lambda f: f.path)

    def read(self, path: str) -> bytes:
        with self.fs.open_input_stream(path[len(self.before) :]) as f:
            return f.read()


def packed(files: Iterable[File], most: int) -> list[Files]:
    """Files in their order in groups of about `most` bytes; a larger file is alone."""
    out: list[list[File]] = []
    size = most + 1
    for f in files:
        if size + f.size + OPEN_BYTES > most:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size + OPEN_BYTES
    return [Files(tuple(group)) for group in out]


def limits_of(options: dict[str, str]) -> Limits:
    """Limits given as options under their own names."""
    return Limits(**{f.name: int(options[f.name]) for f in fields(Limits) if f.name in options})


class Opening:
    """Reads the files of a partition; shared by tables and streams."""

    def __init__(self, options: dict[str, str], schema: StructType | None = None) -> None:
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.path, self.limits = self.options.get("path"), limits_of(self.options)
        if not self.path:
            raise ValueError("load() needs a path")
        self.bytes = int(self.options.get("partitionbytes", PARTITION_BYTES))

    def batches(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.path)
        schema = to_arrow_schema(self.schema)
        for rows in decoded_rows(((f.path, folder.read(f.path)) for f in partition.files), self.limits):
            yield pa.RecordBatch.from_pylist(rows, schema)


def holds(test: Filter, path: str) -> bool | None:
    """Whether a file can have rows for a filter; None if that can't be told from its path."""
    at = getattr(test, "attribute", None)
    if at not in (("path",), ("doc_id",), ("filename",)):
        return None
    value = posixpath.basename(path) if at == ("filename",) else path
    if isinstance(test, EqualTo):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    return value.startswith(test.value) if isinstance(test, StringStartsWith) else None


class WordReader(Opening, DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType | None = None) -> None:
        super().__init__(options, schema)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if holds(f, "") is None:
                yield f
            else:
                self.tests.append(f)

    def partitions(self) -> Sequence[Files]:
        return packed((f for f in Folder(self.path).documents() if all(holds(t, f.path) for t in self.tests)), self.bytes) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class Log:
    """The files of each batch, one entry per number; entries are written whole and never change."""

    def __init__(self, uri: str) -> None:
        self.folder = Folder(uri)
        self.folder.fs.create_dir(self.folder.root, recursive=True)
        found = self.folder.fs.get_file_info(fs.FileSelector(self.folder.root))
        self.last = max([0, *(int(m[1]) for i in found if (m := _ENTRY.match(posixpath.basename(i.path))))])
        self.seen = {f.path for k in range(1, self.last + 1) for f in self.entry(k)}

    def entry(self, k: int) -> list[File]:
        with self.folder.fs.open_input_stream(f"{self.folder.root}/{k}.json") as f:
            return [File(*x) for x in json.loads(f.read())]

    def add(self, files: list[File]) -> None:
        beside, place = f"{self.folder.root}/.{self.last + 1}.part", f"{self.folder.root}/{self.last + 1}.json"
        with self.folder.fs.open_output_stream(beside) as f:
            f.write(json.dumps([[x.path, x.size] for x in files]).encode())
        self.folder.fs.move(beside, place)
        self.last += 1
        self.seen |= {x.path for x in files}


class WordStreamReader(Opening, DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType | None = None) -> None:
        super().__init__(options, schema)
        if "log" not in self.options:
            raise ValueError('a stream of documents needs option("log"), a folder of its own')
        self.where, self.most = self.options["log"], int(self.options.get("maxfilespertrigger", PER_TRIGGER))
        self.log: Log | None = None

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        self.log = self.log or Log(self.where)
        if new := [f for f in Folder(self.path).documents() if f.path not in self.log.seen][: self.most]:
            self.log.add(new)
        return {"entry": self.log.last}

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        self.log = self.log or Log(self.where)
        return packed((f for k in range(start["entry"] + 1, end["entry"] + 1) for f in self.log.entry(k)), self.bytes)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class WordDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        return schemas.DECODED

    def reader(self, schema: StructType) -> WordReader:
        return WordReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> WordStreamReader:
        return WordStreamReader(dict(self.options), schema)


#: The code of an upload that its user's quota keeps out.
REFUSED = "daily_limit"


def opened(rows: DataFrame, root: str, limits: Limits = Limits()) -> DataFrame:
    """Decoded documents for rows with path, user_id and is_admitted; those not admitted are not opened. Also for streams."""
    extra = rows.select("user_id", "is_admitted").schema
    schema = StructType([*extra.fields, *StructType.fromDDL(schemas.DECODED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, form = Folder(root), to_arrow_schema(schema)
        for batch in batches:
            asked = batch.to_pylist()
            for r in asked:
                if r["is_admitted"]:
                    found = next(decoded_rows([(r["path"], folder.read(r["path"]))], limits))
                else:
                    found = [{"doc_id": r["path"], "path": r["path"], "filename": posixpath.basename(r["path"]), "error_code": REFUSED, "fonts": [], "pages": [], "paragraphs": [], "cells": [], "parts": []}]
                yield pa.RecordBatch.from_pylist([r | x for x in found], form)

    return rows.select("path", "user_id", "is_admitted").mapInArrow(run, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordDataSource)
