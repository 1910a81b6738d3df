"""Document collections: folders of JSON documents as a Spark data source.

A collection is a folder:

    data/<job>/part-<task>-<attempt>.jsonl    one JSON document a line
    _manifest/<number>-<job>.json             schema, files and whether the job replaces all before it

Tasks write files of their own; a write becomes visible when its manifest is renamed into place, as the
last act of the job. Readers open the files that manifests name and nothing else, so a job that fails
half-way, or a second attempt of a task, leaves a collection as it was; files that no manifest names
take space until ``vacuum``. Large files are read in ranges
of ``SPLIT_BYTES``, each cut at line ends, and handed to Spark as Arrow batches.

Paths are those of any file system that pyarrow opens (local, shared mount, s3://, gs://, hdfs://).
Defined results: a field that a document lacks is null, one that the schema lacks is ignored; documents
hold strings, integers, doubles and booleans, other types and non-finite doubles are refused; a
collection that was never written is an error (``read_table`` turns it into None).
"""

from __future__ import annotations

import io
import json
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyarrow import fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    InputPartition, WriterCommitMessage)

FORMAT = "documents"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
MISSING = "no document collection at"

_ARROW = {"string": pa.string(), "long": pa.int64(), "integer": pa.int32(), "short": pa.int16(),
          "byte": pa.int8(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.rstrip("/"))
    return pafs.LocalFileSystem(), path.rstrip("/")


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    fields = []
    for f in schema.fields:
        kind = _ARROW.get(f.dataType.typeName())
        if kind is None:
            raise ValueError(f"documents hold no {f.dataType.simpleString()} (column {f.name})")
        fields.append(pa.field(f.name, kind))
    return pa.schema(fields)


def _manifests(fs: pafs.FileSystem, base: str, up_to: int | None = None) -> list[dict]:
    """The manifests in force, oldest first, as they were when ``up_to`` was the last number."""
    found = fs.get_file_info(pafs.FileSelector(f"{base}/_manifest", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    kept: list[dict] = []
    for name in names:
        number = int(name.rsplit("/", 1)[1].split("-")[0])
        if up_to is not None and number > up_to:
            continue
        with fs.open_input_stream(name) as f:
            one = json.loads(f.read())
        one["number"] = number
        kept = [one] if one["replaces"] else [*kept, one]
    return kept


@dataclass
class _Range(InputPartition):
    file: str
    begin: int
    end: int


@dataclass
class _Written(WriterCommitMessage):
    file: str | None
    rows: int


class DocumentReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split: int, up_to: int | None = None):
        self.path, self.schema, self.split, self.up_to = path, schema, split, up_to

    def partitions(self) -> list[_Range]:
        fs, base = _open(self.path)
        out = []
        for one in _manifests(fs, base, self.up_to):
            for info in fs.get_file_info([f"{base}/{name}" for name in one["files"]]):
                if info.type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"{info.path}, which the collection's manifest names")
                out += [_Range(info.path, at, min(at + self.split, info.size))
                        for at in range(0, info.size, self.split)]
        return out or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _open(self.path)
        schema = _arrow_schema(self.schema)
        options = pj.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        with io.BufferedReader(fs.open_input_file(partition.file)) as f:
            # A line belongs to the range in which it begins.
            if partition.begin:
                f.seek(partition.begin - 1)
                f.readline()
            while f.tell() < partition.end:
                block = f.read(min(BLOCK_BYTES, partition.end - f.tell())) + b""
                if not block.endswith(b"\n"):
                    block += f.readline()
                table = pj.read_json(pa.BufferReader(block), parse_options=options,
                                     read_options=pj.ReadOptions(block_size=len(block) + 1))
                yield from table.select(schema.names).cast(schema).to_batches()


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        _arrow_schema(schema)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        fs, base = _open(self.path)
        name = f"data/{self.job}/part-{context.partitionId():06d}-{context.taskAttemptId()}.jsonl"
        encode = json.JSONEncoder(ensure_ascii=False).encode
        out, rows = None, 0
        try:
            for b in iterator:
                if out is None and b.num_rows:
                    fs.create_dir(f"{base}/data/{self.job}")
                    out = fs.open_output_stream(f"{base}/{name}")
                for field, column in zip(b.schema.names, b.columns):
                    if pa.types.is_floating(column.type) and pc.any(
                            pc.invert(pc.is_finite(column))).as_py():
                        raise ValueError(f"documents hold no non-finite numbers (column {field})")
                if b.num_rows:
                    out.write("".join(f"{encode({k: v for k, v in doc.items() if v is not None})}\n"
                                      for doc in b.to_pylist()).encode())
                rows += b.num_rows
        finally:
            if out is not None:
                out.close()
        return _Written(name if rows else None, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        fs, base = _open(self.path)
        before = _manifests(fs, base)
        number = before[-1]["number"] + 1 if before else 0
        files = sorted(m.file for m in messages if m is not None and m.file)
        text = json.dumps({"schema": self.schema.jsonValue(), "files": files,
                           "replaces": self.overwrite})
        fs.create_dir(f"{base}/_manifest")
        draft = f"{base}/_manifest/.{self.job}"
        with fs.open_output_stream(draft) as f:
            f.write(text.encode())
        fs.move(draft, f"{base}/_manifest/{number:010d}-{self.job}.json")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, base = _open(self.path)
        own = f"{base}/data/{self.job}"
        if fs.get_file_info(own).type == pafs.FileType.Directory:
            fs.delete_dir(own)


class Documents(DataSource):
    """``spark.read.format("documents").load(path)`` and ``df.write.format("documents")``; option
    ``splitBytes`` is the size of a read range, ``upTo`` the last manifest that a read sees."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        fs, base = _open(self.options["path"])
        found = _manifests(fs, base, self._up_to())
        if not found:
            raise FileNotFoundError(f"{MISSING} {self.options['path']}")
        return T.StructType.fromJson(found[-1]["schema"])

    def reader(self, schema: T.StructType) -> DocumentReader:
        return DocumentReader(self.options["path"], schema,
                              int(self.options.get("splitBytes", SPLIT_BYTES)), self._up_to())

    def _up_to(self) -> int | None:
        given = self.options.get("upTo")
        return None if given is None else int(given)

    def writer(self, schema: T.StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session. Its code travels with the plans, so Python workers need
    not have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Documents)


def last_number(path: str) -> int | None:
    """The number of the last manifest at ``path``, None where nothing was ever committed."""
    found = _manifests(*_open(path))
    return found[-1]["number"] if found else None


def vacuum(path: str, older_than_seconds: float = 86_400) -> int:
    """Delete the files that no manifest in force names and that are older than the longest running
    write can be; returns how many."""
    fs, base = _open(path)
    kept = {name for one in _manifests(fs, base) for name in one["files"]}
    before, gone = time.time() - older_than_seconds, 0
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/data", allow_not_found=True,
                                                   recursive=True)):
        name = "/".join(info.path.split("/")[-3:])
        if info.type == pafs.FileType.File and name not in kept and info.mtime.timestamp() <= before:
            fs.delete_file(info.path)
            gone += 1
    return gone
