"""A data source and sink of its own: a folder of Arrow files with a log of commits.

A write's tasks each leave one file under a new name; the driver then adds one record to the log that names the files of
the tasks that succeeded, with each file's rows and the least and greatest value of its columns.  Readers see what records
name and nothing else, so rows of failed or repeated tasks, and of writes that were never committed, are never read.  A
write that fails deletes its files; what lost tasks leave after that, Log.vacuum() does.

    arrow_log.register(spark)
    df.write.format("arrow_log").mode("append").save(path)
    spark.read.format("arrow_log").schema(df.schema).load(path)
    spark.readStream.format("arrow_log").schema(df.schema).load(path)

Reading plans a partition for each file; files whose values can't fit a filter aren't opened (register() turns the pushing of
filters to sources in Python on).  A stream's offset is the number of a record.  A folder must have one writer at a time, except on a
local or mounted folder, where records are created only once.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Log:
    """The records of a folder."""

    def __init__(self, path: str):
        self.fs, self.path = _store(path)

    def numbers(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(f"{self.path}/_log", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def record(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.path}/_log/{number:012d}.json") as f:
            return json.loads(f.read())

    def files(self, after: int = -1, upto: int | None = None, replaced: bool = True) -> list[dict]:
        """The files of the records in (after, upto]; those of a record that replaced all before it, and later ones, if so asked."""
        out: list[dict] = []
        for n in self.numbers():
            if after < n and (upto is None or n <= upto):
                r = self.record(n)
                out = ([] if r["replace"] and replaced else out) + r["files"]
        return out

    def add(self, files: list[dict], replace: bool, batch: str | None = None) -> None:
        """One more record; none if the record of this batch of a stream is there already."""
        numbers = self.numbers()
        if batch and any(self.record(n)["batch"] == batch for n in numbers[-100:]):
            return
        self.fs.create_dir(f"{self.path}/_log")
        body = json.dumps({"replace": replace, "batch": batch, "files": files}).encode()
        name = f"{self.path}/_log/{(numbers[-1] if numbers else -1) + 1:012d}.json"
        if isinstance(self.fs, pafs.LocalFileSystem):
            temporary = f"{self.path}/_log/.{uuid.uuid4().hex}"
            with open(temporary, "xb") as f:
                f.write(body)
            try:
                os.link(temporary, name)  # fails if another writer was first
            finally:
                os.unlink(temporary)
        else:
            with self.fs.open_output_stream(name) as f:
                f.write(body)

    def vacuum(self, age: float) -> None:
        """Deletes files that no record names and that are older than so many seconds: what lost tasks have left."""
        known, now = {f["name"] for n in self.numbers() for f in self.record(n)["files"]}, time.time()
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        self.delete([{"name": f.base_name} for f in found if f.base_name.endswith(".arrow") and f.base_name not in known and now - f.mtime.timestamp() >= age])

    def of(self, write: str) -> list[dict]:
        """The files that the tasks of a write have made so far."""
        found = self.fs.get_file_info(pafs.FileSelector(self.path, allow_not_found=True))
        return [{"name": f.base_name} for f in found if f.base_name.startswith(write)]

    def delete(self, files: list[dict]) -> None:
        for f in files:
            if self.fs.get_file_info(f"{self.path}/{f['name']}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.path}/{f['name']}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowLog)


@dataclass
class Written(ds.WriterCommitMessage):
    file: dict | None


class _Files:
    """What a writer's tasks do: one file for each."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.id = path, schema, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        log, schema = Log(self.path), to_arrow_schema(self.schema)
        name, rows, low, high = f"{self.id}-{uuid.uuid4().hex}.arrow", 0, {}, {}
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return Written(None)
        log.fs.create_dir(log.path)
        try:
            with log.fs.open_output_stream(f"{log.path}/{name}") as out, pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                batch = first
                while batch is not None:
                    f.write_batch(pa.RecordBatch.from_arrays([c.cast(s.type) for c, s in zip(batch.columns, schema, strict=True)], schema=schema))
                    rows += batch.num_rows
                    for column, field in zip(batch.columns, schema, strict=True):
                        if pa.types.is_integer(field.type) or pa.types.is_string(field.type):
                            x = pc.min_max(column)
                            if x["min"].is_valid:
                                low[field.name] = min(x["min"].as_py(), low.get(field.name, x["min"].as_py()))
                                high[field.name] = max(x["max"].as_py(), high.get(field.name, x["max"].as_py()))
                    batch = next(batches, None)
        except BaseException:
            log.delete([{"name": name}])
            raise
        return Written({"name": name, "rows": rows, "low": low, "high": high})


class Writer(_Files, ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        super().__init__(path, schema)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        Log(self.path).add([m.file for m in messages if m and m.file], self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        log = Log(self.path)
        log.delete(log.of(self.id))  # those of tasks that didn't report too


class StreamWriter(_Files, ds.DataSourceStreamArrowWriter):
    def __init__(self, path: str, schema: StructType, name: str):
        super().__init__(path, schema)
        self.name = name

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        Log(self.path).add([m.file for m in messages if m and m.file], False, f"{self.name}/{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        Log(self.path).delete([m.file for m in messages if m and m.file])  # other batches may have files of this id


@dataclass
class File(ds.InputPartition):
    name: str


def _read(path: str, name: str, schema: StructType) -> Iterator[pa.RecordBatch]:
    log = Log(path)
    with log.fs.open_input_stream(f"{log.path}/{name}") as f, pa.ipc.open_stream(f) as batches:
        for batch in batches:
            yield batch.select(schema.names)


def _may_fit(file: dict, test: ds.Filter) -> bool:
    """Whether a file can hold a row that fits; a null fits no comparison."""
    (column, *nested) = test.attribute
    if nested or column not in file["low"]:
        return True
    low, high = file["low"][column], file["high"][column]
    values = test.value if isinstance(test, ds.In) else [test.value]
    if any(type(v) is not type(low) for v in values):
        return True
    if isinstance(test, (ds.EqualTo, ds.In)):
        return any(low <= v <= high for v in values)
    (v,) = values
    return {ds.GreaterThan: high > v, ds.GreaterThanOrEqual: high >= v, ds.LessThan: low < v, ds.LessThanOrEqual: low <= v}[type(test)]


class Reader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Comparisons choose files; Spark still filters the rows."""
        self.tests = [f for f in filters if isinstance(f, (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual))]
        yield from filters

    def partitions(self) -> list[File]:
        return [File(f["name"]) for f in Log(self.path).files() if all(_may_fit(f, t) for t in self.tests)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition:  # where there are none, Spark asks for one all the same
            yield from _read(self.path, partition.name, self.schema)


class StreamReader(ds.DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"record": -1}

    def latestOffset(self) -> dict:
        return {"record": max(Log(self.path).numbers(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(f["name"]) for f in Log(self.path).files(start["record"], end["record"], replaced=False)]

    def read(self, partition: File | None) -> Iterator[pa.RecordBatch]:
        if partition:  # where there are none, Spark asks for one all the same
            yield from _read(self.path, partition.name, self.schema)


class ArrowLog(ds.DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "arrow_log"

    def schema(self) -> StructType:
        raise ValueError("arrow_log needs a schema")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], schema, self.options.get("queryname", self.options["path"]))
