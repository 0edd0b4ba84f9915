"""The five column types, schemas, and how they map to Spark."""

from __future__ import annotations

import enum
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import types as T

from plinth.errors import CatalogError


class ColumnType(enum.Enum):
    """Value: (name in catalogs, Spark type, numpy code, bytes of a fixed-width value). Order is the type's code in files."""

    INT32 = ("Int32", T.IntegerType(), "<i4", 4)
    INT64 = ("Int64", T.LongType(), "<i8", 8)
    FLOAT64 = ("Float64", T.DoubleType(), "<f8", 8)
    BOOLEAN = ("Boolean", T.BooleanType(), "u1", 1)
    UTF8 = ("Utf8", T.StringType(), None, 0)
    #: A Spark type that queries can carry and count but not look into.
    OPAQUE = ("Opaque", None, None, 0)

    @property
    def label(self) -> str:
        return self.value[0]

    @property
    def spark(self) -> T.DataType:
        return self.value[1]

    @property
    def code(self) -> int:
        return list(ColumnType).index(self)

    @property
    def fixed_width(self) -> bool:
        return self.value[3] > 0

    @classmethod
    def of(cls, kind: T.DataType) -> ColumnType:
        return next((t for t in cls if t.spark == kind), cls.OPAQUE)

    @classmethod
    def named(cls, label: str) -> ColumnType:
        for t in cls:
            if t.label == label and t is not cls.OPAQUE:
                return t
        raise CatalogError(f"unknown column type '{label}'")


@dataclass(frozen=True)
class Column:
    name: str
    type: ColumnType
    #: The Spark type of an opaque column.
    raw: T.DataType | None = None

    @property
    def spark(self) -> T.DataType:
        return self.raw if self.type is ColumnType.OPAQUE else self.type.spark


class Schema:
    """An ordered list of typed columns, all nullable; names differ even without regard to case."""

    def __init__(self, columns: Iterable[Column | tuple[str, ColumnType]]):
        self.columns = tuple(c if isinstance(c, Column) else Column(*c) for c in columns)
        if not self.columns:
            raise CatalogError("a schema needs a column at least")
        self._place: dict[str, int] = {}
        for i, c in enumerate(self.columns):
            if self._place.setdefault(c.name.casefold(), i) != i:
                raise CatalogError(f"duplicate column name '{c.name}'")

    def __len__(self) -> int:
        return len(self.columns)

    def __iter__(self) -> Iterator[Column]:
        return iter(self.columns)

    def __getitem__(self, i: int) -> Column:
        return self.columns[i]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.columns == other.columns

    def __hash__(self) -> int:
        return hash(self.columns)

    def place(self, name: str) -> int | None:
        """Ordinal of a column by name without regard to case."""
        return self._place.get(name.casefold())

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, True) for c in self.columns])

    @classmethod
    def from_spark(cls, schema: T.StructType) -> Schema:
        return cls(Column(f.name, k := ColumnType.of(f.dataType), f.dataType if k is ColumnType.OPAQUE else None) for f in schema.fields)
