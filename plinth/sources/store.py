"""Durable tables: a folder with catalog.json and a Parquet segment for each batch.

    <folder>/catalog.json                                    names, ids and columns, and the folder of the segments
    <folder>/tables/<id>/000000.parquet/part-00000-...       batches in order, files of a batch in order

The folder may be on any file system that Spark reads and writes.  A segment counts
once Spark has marked it as written (_SUCCESS), and catalog.json is replaced as a
whole, so a reader sees a batch or a snapshot wholly or not at all, and no step
depends on renaming folders.  A table's segments are written before the catalog
names the table only if it is exported; a created table starts empty.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.errors import CatalogError, FormatError
from plinth.sources.catalog import Catalog
from plinth.sources.files import Files
from plinth.sources.tables import BATCH, ROW, Table
from plinth.types import Column, ColumnType, Schema

CATALOG, TABLES, VERSION = "catalog.json", "tables", 1
#: Spark's mark of a folder that is written.
WRITTEN = "_SUCCESS"


def _document(catalog: Catalog, data: str = TABLES) -> str:
    for t in catalog:
        if any(c.type is ColumnType.OPAQUE for c in t.schema):
            raise CatalogError(f"table '{t.name}' has columns of types that can't be stored")
    tables = [{"id": t.id.hex, "name": t.name, "columns": [{"name": c.name, "type": c.type.label} for c in t.schema]} for t in catalog]
    return json.dumps({"formatVersion": VERSION, "tables": tables} | ({"folder": data} if data != TABLES else {}), indent=2)


def _write_segment(files: Files, folder: str, index: int, batch: DataFrame, placed: bool) -> str:
    """The files of a batch, as many as Spark has partitions, in the order of its rows.

    placed: its rows have places of their own, by which they are sorted; otherwise
    they are in order as partitions and rows come.
    """
    path = f"{folder}/{index:06d}.parquet"
    if files.exists(f"{path}/{WRITTEN}"):
        raise CatalogError(f"{path} has been written by somebody else")
    columns = [c for c in batch.columns if c not in (BATCH, ROW)]
    rows = (batch.orderBy(BATCH, ROW) if placed else batch).select(*(F.col(f"`{c}`") for c in columns))
    try:
        # What an attempt that failed has left is not read, and is replaced.
        rows.write.mode("overwrite").parquet(path)
    except BaseException:
        files.delete(path)
        raise
    if not files.exists(f"{path}/{WRITTEN}"):
        files.write(f"{path}/{WRITTEN}", "")
    return path


def _read(files: Files, folder: str, catalog: Catalog) -> str:
    """Registers a folder's tables; the name of the folder of their segments."""
    try:
        found = json.loads(files.read(f"{folder}/{CATALOG}"))
    except ValueError as error:
        raise FormatError("catalog.json can't be read") from error
    if found.get("formatVersion") != VERSION:
        raise FormatError(f"catalogs of version {found.get('formatVersion')} can't be read")
    data = found.get("folder", TABLES)
    if not isinstance(data, str) or not data.startswith(TABLES) or "/" in data:
        raise FormatError(f"{data!r} is no folder of segments")
    for t in found.get("tables", []):
        if not t.get("columns"):
            raise FormatError(f"table '{t.get('name')}' has no columns")
        schema = Schema(Column(c["name"], ColumnType.named(c["type"])) for c in t["columns"])
        table = Table(files.spark, t["name"], schema, uuid.UUID(t["id"]))
        place = f"{folder}/{data}/{table.id.hex}"
        for name in files.names(place):
            if name.endswith(".parquet") and files.exists(f"{place}/{name}/{WRITTEN}"):
                table.adopt_segment(f"{place}/{name}")
        catalog.register(table)
    return data


class Store:
    """A folder's tables; what is created in or appended to them is written at once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.catalog, self.files = spark, folder.rstrip("/"), Catalog(), Files(spark)
        self.data = TABLES
        if self.files.exists(f"{self.folder}/{CATALOG}"):
            self.data = _read(self.files, self.folder, self.catalog)
        for table in self.catalog:
            table.hook = self._persist

    def place(self, table: Table) -> str:
        """The folder of a table's segments."""
        return f"{self.folder}/{self.data}/{table.id.hex}"

    def _persist(self, table: Table, index: int, batch: DataFrame) -> None:
        path = _write_segment(self.files, self.place(table), table.next_segment(index), batch, table.is_placed(index))
        # From now on the batch is read from its segment, not made again.
        table.replace_batch(index, path)

    def create(self, name: str, schema: Schema, table_id: uuid.UUID | None = None, strict: bool = False) -> Table:
        if any(c.type is ColumnType.OPAQUE for c in schema):
            raise CatalogError(f"table '{name}' has columns of types that can't be stored")
        table = self.catalog.register(Table(self.spark, name, schema, table_id, strict, self._persist))
        self.flush()
        return table

    def flush(self) -> None:
        self.files.make(self.folder)
        self.files.write(f"{self.folder}/{CATALOG}", _document(self.catalog, self.data))


def export_snapshot(catalog: Catalog, folder: str, spark: SparkSession | None = None) -> None:
    """All tables of a catalog as a store.

    Segments go to a folder of their own; once all are written the catalog is
    replaced by one that names it, and then what the folder had before is deleted.
    """
    _document(catalog)
    files, folder = Files(spark or SparkSession.active()), folder.rstrip("/")
    files.make(folder)
    data = f"{TABLES}-{uuid.uuid4().hex}" if files.exists(f"{folder}/{TABLES}") else TABLES
    for table in catalog:
        for i, batch in enumerate(table.batches):
            _write_segment(files, f"{folder}/{data}/{table.id.hex}", i, batch, table.is_placed(i))
    files.write(f"{folder}/{CATALOG}", _document(catalog, data))
    for name in files.names(folder):
        if name != data and (name == TABLES or name.startswith(f"{TABLES}-")):
            files.delete(f"{folder}/{name}")


def import_snapshot(spark: SparkSession, folder: str) -> Catalog:
    """A store's tables as they are now; appends to them aren't written."""
    files, folder = Files(spark), folder.rstrip("/")
    if not files.exists(f"{folder}/{CATALOG}"):
        raise FileNotFoundError(f"{folder}/{CATALOG}")
    catalog = Catalog()
    _read(files, folder, catalog)
    return catalog
