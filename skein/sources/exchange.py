"""Requests and answers as a Python data source: ``spark.read.format("exchange")``, ``readStream`` and ``write``.

The data are files of JSON objects, one a line, in a folder (a path with a scheme, or one that every machine mounts). Reading gives
for each line its id (file and byte at which it starts) and its text; a schema given by the user names fields of the objects
instead, beside ``id``. Files are read in parts of bytes, a line by the part that it starts in. Files whose names begin with ``.`` or ``_``
are not read.

Writing gives one object for each row. Tasks write under ``_writing-<job>``; only when all have succeeded are the files moved to their
places, and a job that fails leaves none (a task that outlives its failed job may leave that hidden folder, which nobody reads). An answer's file names the job and task, so nothing is overwritten but on request.

A stream's offset is how many bytes of each file have been read, up to the last whole line: files may be added, late ones, too, and may
grow. It grows with the number of files in the folder, so files long answered should be moved away.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DataType, FractionalType, IntegralType, StringType, StructType

SPLIT = 32 << 20
ROWS = 4096


@dataclass
class Part(InputPartition):
    """Lines of a file that start at ``lo`` or later and before ``hi``."""

    path: str
    lo: int
    hi: int


@dataclass
class Written(WriterCommitMessage):
    """The name of a task's file; empty if the task had no row."""

    name: str


def _files(folder: str) -> list[fs.FileInfo]:
    at, path = fs.FileSystem.from_uri(folder)
    found = at.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((i for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._"), key=lambda i: i.base_name)


def _lines(folder: str, part: Part) -> Iterator[tuple[int, bytes]]:
    """(start, line) of a part; the last line may reach past its end."""
    at, _ = fs.FileSystem.from_uri(folder)
    with at.open_input_file(part.path) as raw:
        # From the byte before: a line that starts exactly at ``lo`` follows a line end.
        place = max(part.lo - 1, 0)
        raw.seek(place)
        rest, skip = [], part.lo > 0  # blocks of a line whose end is to come
        while place < part.hi:
            block = raw.read(1 << 20)
            rest.append(block)
            if block and b"\n" not in block:
                continue
            lines = b"".join(rest).split(b"\n")
            rest = [lines.pop()] if block else []
            for line in lines:
                if not skip and place < part.hi and line.strip():
                    yield place, line
                skip = False
                place += len(line) + 1
            if not block:
                return


def _value(x, kind: DataType):
    """A field as its type; null if it is of another."""
    if isinstance(kind, StringType):
        text = x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False)
        return text and text.encode("utf-8", "replace").decode()
    if isinstance(kind, BooleanType):
        return x if isinstance(x, bool) else None
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(kind, IntegralType):
        bits = {"byte": 8, "short": 16, "integer": 32, "long": 64}[kind.typeName()] - 1
        return int(x) if number and x == x and abs(x) != float("inf") and int(x) == x and -(1 << bits) <= x < 1 << bits else None
    return float(x) if number and abs(x) < 1 << 1023 else None


def _object(line: bytes) -> dict:
    """The object of a line; an empty one where the line holds none."""
    try:
        got = json.loads(line.decode("utf-8", "replace"))
    except (ValueError, RecursionError):
        return {}
    return got if isinstance(got, dict) else {}


def _plain(x):
    """A value of a row as JSON has it."""
    if isinstance(x, (datetime.date, datetime.datetime, decimal.Decimal)):
        return str(x)
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(x).decode()
    return x.asDict(True) if hasattr(x, "asDict") else str(x)


class _Reading:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, options["path"]
        self.split = int(options.get("split", SPLIT))

    def _parts(self, path: str, lo: int, hi: int) -> list[Part]:
        return [Part(path, a, min(a + self.split, hi)) for a in range(lo, hi, self.split)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        name = part.path.rsplit("/", 1)[-1]
        rows: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for start, line in _lines(self.folder, part):
            fields = None
            row = []
            for f in self.schema:
                if f.name == "id":
                    row.append(f"{name}:{start}")
                elif f.name == "line":
                    row.append(line.decode("utf-8", "replace"))
                else:
                    fields = _object(line) if fields is None else fields
                    row.append(_value(fields.get(f.name), f.dataType))
            rows.append(row)
            if len(rows) == ROWS:
                yield batch()
                rows = []
        if rows:
            yield batch()


class _Reader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[Part]:
        return [p for i in _files(self.folder) for p in self._parts(i.path, 0, i.size)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.path else iter(())


class _StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file the end of its last whole line."""
        out = {}
        for i in _files(self.folder):
            at, _ = fs.FileSystem.from_uri(self.folder)
            with at.open_input_file(i.path) as f:
                end = i.size
                while end > 0:
                    lo = max(end - (1 << 16), 0)
                    f.seek(lo)
                    found = f.read(end - lo).rfind(b"\n")
                    if found >= 0:
                        out[i.base_name] = lo + found + 1
                        break
                    end = lo
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        _, folder = fs.FileSystem.from_uri(self.folder)
        return [p for name, hi in sorted(end.items()) for p in self._parts(f"{folder}/{name}", start.get(name, 0), hi)]

    def commit(self, end: dict) -> None:
        pass


class _Writer(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.folder, self.overwrite = schema.names, options["path"], overwrite
        self.job = uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        at, path = fs.FileSystem.from_uri(self.folder)
        return at, path, f"{path}/_writing-{self.job}"

    def write(self, rows: Iterator) -> Written:
        at, _, folder = self._temporary()
        context = TaskContext.get()
        name, out = "", None
        try:
            for row in rows:
                if out is None:
                    at.create_dir(folder, recursive=True)
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{self.job}.json"
                    out = at.open_output_stream(f"{folder}/{name}")
                out.write((json.dumps(dict(zip(self.names, row)), ensure_ascii=False, default=_plain) + "\n").encode())
        finally:
            if out is not None:
                out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        at, path, folder = self._temporary()
        before = [i.path for i in _files(self.folder)] if self.overwrite else []
        at.create_dir(path, recursive=True)
        for m in messages:
            if m is not None and m.name:
                at.move(f"{folder}/{m.name}", f"{path}/{m.name}")
        for old in before:
            at.delete_file(old)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        at, _, folder = self._temporary()
        if at.get_file_info(folder).type == fs.FileType.Directory:
            at.delete_dir(folder)


class Exchange(DataSource):
    """Option ``path``: the folder; ``split``: bytes a reading task takes (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "exchange"

    def schema(self) -> str:
        return "id string, line string"

    def _checked(self, schema: StructType) -> StructType:
        for f in schema:
            if not isinstance(f.dataType, (StringType, BooleanType, IntegralType, FractionalType)) or f.dataType.typeName() == "decimal":
                raise ValueError(f"{f.name}: fields are text, numbers or booleans")
        return schema

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._checked(schema), self.options)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self._checked(schema), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """The format's name is known to a session from here on."""
    spark.dataSource.register(Exchange)
