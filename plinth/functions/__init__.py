"""Comparisons, aggregates and orders as Spark columns."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from plinth.types import ColumnType

_COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(column: Column, kind: ColumnType, sign: str, value: object) -> Column:
    """column sign value; null cells compare with nothing, and NaN cells are neither more nor less than a number."""
    test = _COMPARE[sign](column, F.lit(value).cast(kind.spark))
    return test & ~F.isnan(column) if kind is ColumnType.FLOAT64 and sign in (">", ">=") else test


def aggregate(function: str, column: Column | None, kind: ColumnType | None, wrap: bool = False) -> Column:
    """wrap: sums of integers wrap around at 64 bits instead of failing."""
    if column is None:
        return F.count(F.lit(1))
    if function == "SUM" and wrap and kind is not ColumnType.FLOAT64:
        two = lambda n: F.lit(str(2**n)).cast("decimal(20,0)")
        return (F.pmod(F.sum(column.cast("decimal(20,0)")) + two(63), two(64)) - two(63)).cast("bigint")
    return {"SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[function](column)


def order(column: Column, kind: ColumnType, descending: bool, nan_first: bool = False) -> list[Column]:
    """Nulls are least; NaN is greatest, or with nan_first least but for nulls."""
    if kind is ColumnType.FLOAT64 and nan_first:
        flags = [column.isNull(), F.isnan(column)]
        return [f.asc() if descending else f.desc() for f in flags] + [column.desc() if descending else column.asc()]
    return [column.desc_nulls_last() if descending else column.asc_nulls_first()]


def group_order(keys: list[Column]) -> list[Column]:
    """Groups by which keys are null (the first key is the lowest bit), then by the keys."""
    mask = sum((F.when(k.isNull(), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, k in enumerate(keys)), F.lit(0).cast("bigint"))
    return [mask.asc(), *(k.asc() for k in keys)]
