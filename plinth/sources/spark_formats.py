"""The binary formats as Spark data sources, for import and export.

Batches ("plinth_batch"): a folder of *.batch files, a partition for each, read in
order of their names; a task writes a file for about every
64 MB (option fileBytes).  Columns
("plinth_column"): a folder of <column>.col files of as many rows each.

    spark.read.format("plinth_batch").schema(schema).load(folder)
    df.write.format("plinth_batch").mode("append").save(folder)

Paths have to be reachable as files from all executors.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from plinth.errors import FormatError
from plinth.sources import batchfile, columnfile
from plinth.types import Schema


#: Bytes of Arrow data that a task gathers for a file.
FILE_BYTES = 64 << 20


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class BatchReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.types, self.path = schema.names, [c.type for c in Schema.from_spark(schema)], path

    def partitions(self) -> list[InputPartition]:
        return [_Files([p]) for p in sorted(glob.glob(os.path.join(self.path, "*.batch")))] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            with open(path, "rb") as file:
                batch = batchfile.decode(file.read(), self.names if self.names else None)
            if [batchfile.type_of(t) for t in batch.schema.types] != self.types:
                raise FormatError(f"{path} doesn't fit the schema")
            yield batch


class ColumnReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path = schema.names, path

    def partitions(self) -> list[InputPartition]:
        return [_Files([os.path.join(self.path, f"{n}.col") for n in self.names])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([columnfile.read(p) for p in partition.paths], names=self.names)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class BatchWriter(DataSourceArrowWriter):
    """Each task writes files beside their final names; all of them get their names when every task has succeeded."""

    def __init__(self, schema: StructType, path: str, overwrite: bool, file_bytes: int = FILE_BYTES):
        self.names, self.path, self.overwrite, self.file_bytes, self.run = schema.names, path, overwrite, file_bytes, uuid.uuid4().hex
        self.types = [batchfile.ARROW[c.type] for c in Schema.from_spark(schema)]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        place, files = TaskContext.get().partitionId(), []
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            os.makedirs(self.path, exist_ok=True)
            temporary = os.path.join(self.path, f".{self.run}-{place:06d}-{uuid.uuid4().hex}.tmp")
            whole = pa.concat_batches(held)
            columns = [c.cast(t) for c, t in zip(whole.columns, self.types, strict=True)]
            with open(temporary, "wb") as file:
                file.write(batchfile.encode(pa.RecordBatch.from_arrays(columns, names=self.names)))
            files.append((f"{place:06d}-{len(files):06d}", temporary))
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= self.file_bytes:
                flush()
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        there = sorted(glob.glob(os.path.join(self.path, "*.batch")))
        done = sorted(f for m in messages if m for f in m.files)
        if self.overwrite:
            for path in there:
                os.remove(path)
            there = []
        first = 1 + max((int(os.path.basename(p).split(".")[0]) for p in there), default=-1)
        for i, (_, temporary) in enumerate(done):
            os.replace(temporary, os.path.join(self.path, f"{first + i:06d}.batch"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for _, temporary in (f for m in messages if m for f in m.files):
            if os.path.exists(temporary):
                os.remove(temporary)


class BatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plinth_batch"

    def schema(self) -> StructType:
        raise FormatError("batch files have no column names; give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return BatchReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(schema, self.options["path"], overwrite, int(self.options.get("fileBytes") or FILE_BYTES))


class ColumnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plinth_column"

    def schema(self) -> StructType:
        raise FormatError("column files have no names; give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ColumnReader(schema, self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BatchSource)
    spark.dataSource.register(ColumnSource)
