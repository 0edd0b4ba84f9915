"""Append-only tables whose rows keep the order in which they came."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.errors import CatalogError
from plinth.types import Schema

#: Hidden columns: the batch of a row (six digits, perhaps a bar and a file; their text order is the order of rows) and its place there.
BATCH, ROW = "__batch", "__row"
#: Rows that a strict table takes in a batch, besides none.
STRICT_ROWS = (64 * 1024, 1024 * 1024)

#: Called with (table, index of the batch, its DataFrame) after a batch is added; if it fails, the batch is taken back.
AppendHook = Callable[["Table", int, DataFrame], None]


def ordered_parquet(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None, segments: bool = False) -> DataFrame:
    """Parquet files with the hidden order columns: rows by file name, then by row in the file.

    segments: the paths are segments of a stored table, whose names number its batches.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    path = F.col("_metadata.file_path")
    batch = F.lpad(F.regexp_extract(path, r"/([0-9]+)\.parquet/[^/]*\z", 1), 6, "0") if segments else F.lit("000000")
    return df.select("*", F.concat(batch, F.lit("|"), path).alias(BATCH), F.col("_metadata.row_index").alias(ROW))


def _plain_files(df: DataFrame) -> list[str] | None:
    """The files of a scan in their order; None where reading some of them alone could give other rows (folders name values, names are encoded)."""
    files = sorted(df.inputFiles())
    return None if any(c in f for f in files for c in "=%") else files


class Table:
    """A name, an id, a schema, and batches of rows.

    Batches are DataFrames or paths of stored segments; all segments are read by one
    scan.  A DataFrame that lacks the hidden order columns gets places in the order
    in which Spark reads it: a place of its own needs a source that is read the same
    way again.  `hook` persists a batch.
    """

    def __init__(self, spark: SparkSession, name: str, schema: Schema, table_id: uuid.UUID | None = None, strict: bool = False, hook: AppendHook | None = None):
        self.spark, self.name, self.schema, self.strict, self.hook = spark, name, schema, strict, hook
        self.id = table_id or uuid.uuid4()
        self.version = 1
        self._batches: list[DataFrame | str] = []
        self._own_places: list[bool] = []
        self._listeners: list[Callable[[Table, int], None]] = []
        self._of_files = False

    @classmethod
    def over(cls, spark: SparkSession, name: str, df: DataFrame, table_id: uuid.UUID | None = None, files: bool = False) -> Table:
        """A table of a DataFrame's rows as they are; files: it is ordered_parquet's."""
        table = cls(spark, name, Schema.from_spark(T.StructType([f for f in df.schema.fields if f.name not in (BATCH, ROW)])), table_id)
        table.adopt(df)
        table._of_files = files
        return table

    @property
    def batches(self) -> tuple[DataFrame, ...]:
        return tuple(self._segments([b]) if isinstance(b, str) else b for b in self._batches)

    def _segments(self, paths: Sequence[str]) -> DataFrame:
        return ordered_parquet(self.spark, paths, self.schema.to_spark(), segments=True)

    def row_count(self) -> int:
        return sum(b.count() for b in self.batches)

    def frame(self) -> DataFrame:
        """All rows with the hidden columns; no guaranteed order by itself."""
        if not self._batches:
            return self.spark.createDataFrame([], T.StructType([*self.schema.to_spark().fields, T.StructField(BATCH, T.StringType()), T.StructField(ROW, T.LongType())]))
        paths = [b for b in self._batches if isinstance(b, str)]
        return reduce(DataFrame.unionAll, [*([self._segments(paths)] if paths else []), *(b for b in self._batches if not isinstance(b, str))])

    def prefixes(self, growth: int = 4) -> Iterator[DataFrame]:
        """The rows of the table's first file, of its first few, and so on, but for all of them; none where rows aren't in files alone."""
        if all(isinstance(b, str) for b in self._batches) and self._batches:
            files, read = _plain_files(self.frame()), self._segments
        elif self._of_files and len(self._batches) == 1:
            files = _plain_files(self._batches[0])
            read = lambda paths: ordered_parquet(self.spark, paths, self.schema.to_spark())
        else:
            return
        n = 1
        while files and n < len(files):
            yield read(files[:n])
            n *= growth

    def is_placed(self, index: int) -> bool:
        """Whether a batch came with places of its rows, so that these and not its partitions order it."""
        return self._own_places[index]

    def replace_batch(self, index: int, path: str) -> None:
        """The same rows from a stored segment."""
        self._batches[index], self._own_places[index] = path, True

    def adopt_segment(self, path: str) -> None:
        """Adds a stored segment; segments come in the order of their names."""
        self._batches.append(path)
        self._own_places.append(True)

    def next_segment(self, index: int) -> int:
        """The number of the segment that batch `index` becomes: after all that are stored."""
        numbers = [int(b.rsplit("/", 1)[-1].split(".")[0]) for b in self._batches if isinstance(b, str)]
        return max([index, *(n + 1 for n in numbers)])

    def _add(self, df: DataFrame) -> DataFrame:
        self._own_places.append({BATCH, ROW} <= set(df.columns))
        self._batches.append(self._placed(df, len(self._batches)))
        return self._batches[-1]

    def _placed(self, df: DataFrame, index: int) -> DataFrame:
        columns = [F.col(f"`{c.name}`") for c in self.schema]
        if {BATCH, ROW} <= set(df.columns):
            return df.select(*columns, BATCH, ROW)
        return df.select(*columns, F.lit(f"{index:06d}").alias(BATCH), F.monotonically_increasing_id().alias(ROW))

    def _check(self, df: DataFrame) -> None:
        there = [f for f in df.schema.fields if f.name not in (BATCH, ROW)]
        if len(there) != len(self.schema):
            raise CatalogError(f"table '{self.name}' has {len(self.schema)} columns, the batch has {len(there)}")
        for field, column in zip(there, self.schema, strict=True):
            if field.dataType != column.spark or field.name.casefold() != column.name.casefold():
                raise CatalogError(f"column '{column.name}' of table '{self.name}' is {column.type.label}; the batch has '{field.name}' of {field.dataType.simpleString()}")

    def adopt(self, df: DataFrame) -> None:
        """Adds rows that are stored already, without the hook."""
        self._check(df)
        self._add(df)

    def append(self, rows: DataFrame | Sequence[Sequence]) -> None:
        """Adds a batch: a DataFrame or local rows of the schema's types."""
        index = len(self._batches)
        if not isinstance(rows, DataFrame):
            width = len(self.schema)
            if any(len(r) != width for r in rows):
                raise CatalogError(f"table '{self.name}' has {width} columns")
            fields = [*self.schema.to_spark().fields, T.StructField(BATCH, T.StringType()), T.StructField(ROW, T.LongType())]
            try:
                rows = self.spark.createDataFrame([(*r, f"{index:06d}", i) for i, r in enumerate(rows)], T.StructType(fields))
            except Exception as error:
                raise CatalogError(f"the batch doesn't fit table '{self.name}': {error}") from error
        self._check(rows)
        if self.strict and (n := rows.count()) and not STRICT_ROWS[0] <= n <= STRICT_ROWS[1]:
            raise CatalogError(f"a strict table takes no row or {STRICT_ROWS[0]} to {STRICT_ROWS[1]} in a batch, not {n}")
        batch = self._add(rows)
        if self.hook:
            try:
                self.hook(self, index, batch)
            except BaseException:
                self._batches.pop()
                self._own_places.pop()
                raise

    def on_version(self, listener: Callable[[Table, int], None]) -> None:
        self._listeners.append(listener)

    def bump_version(self) -> int:
        self.version += 1
        for listener in self._listeners:
            listener(self, self.version)
        return self.version
