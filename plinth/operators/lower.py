"""Every plan as one DataFrame; Catalyst does the rest.

Hidden order columns are only read where the order of rows is part of the result,
so other queries keep their pruned scans and need no sort.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import singledispatch

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.errors import SqlCompileError
from plinth.functions import aggregate, compare, group_order, order
from plinth.operators.result import Result
from plinth.plans.binder import check_aggregate, check_filter, check_key, join_columns, output_names
from plinth.plans.physical import HASH, MERGE, Filter, GroupedJoinPlan, Grouping, GroupPlan, JoinPlan, JoinSortPlan, NotePlan, Options, ScanPlan, SortPlan
from plinth.sources.catalog import Catalog
from plinth.sources.tables import BATCH, ROW, Table
from plinth.types import Column, ColumnType

#: Receives one JSON line for each batch with many groups.
SpillHook = Callable[[str], None]


@dataclass
class Context:
    """ordered: what is sorted without being asked to: "groups" (the default), "all" (scans and joins in row order too) or "none"."""

    catalog: Catalog
    spill_hook: SpillHook | None = None
    ordered: str = "groups"


class Input:
    """A table's filtered rows under unique internal names."""

    def __init__(self, table: Table, filters: tuple[Filter, ...], prefix: str, frame: DataFrame | None = None):
        self.table, self.filters, self.prefix = table, filters, prefix
        self.df = self.of(table.frame() if frame is None else frame)

    def of(self, df: DataFrame) -> DataFrame:
        """The filtered rows of some of the table's rows, with the hidden columns where these are there."""
        for f in self.filters:
            column = self.check(f.column)
            check_filter(column, f.operator)
            df = df.filter(compare(F.col(f"`{column.name}`"), column.type, f.operator, f.value))
        hidden = [F.col(c).alias(f"{self.prefix}{c}") for c in (BATCH, ROW) if c in df.columns]
        return df.select(*(F.col(f"`{c.name}`").alias(self.name(i)) for i, c in enumerate(self.table.schema)), *hidden)

    def check(self, place: int) -> Column:
        if not 0 <= place < len(self.table.schema):
            raise SqlCompileError(f"table '{self.table.name}' has no column {place}")
        return self.table.schema[place]

    def name(self, place: int) -> str:
        return f"{self.prefix}{place}"

    @property
    def places(self) -> list[SparkColumn]:
        return [F.col(f"{self.prefix}{BATCH}").asc(), F.col(f"{self.prefix}{ROW}").asc()]


def _first(source: Input, limit: int, of: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """`of` the source's rows, or of its first files' if these alone give `limit` rows, so that a limit reads few files of many."""
    for prefix in source.table.prefixes():
        rows = of(source.of(prefix))
        if rows.limit(limit).count() == limit:
            return rows
    return of(source.df)


def _dealt(df: DataFrame, options: Options) -> DataFrame:
    return df if options.parallelism < 0 else df.coalesce(max(1, options.parallelism))


@singledispatch
def lower(plan: object, context: Context) -> Result:
    """Of a plan that can't be run: an empty result."""
    return Result.empty(plan)


@lower.register
def _(plan: NotePlan, context: Context) -> Result:
    return Result.empty(plan)


@lower.register
def _(plan: ScanPlan, context: Context) -> Result:
    source = Input(context.catalog[plan.table], plan.filters, "c")
    if plan.aggregate:
        a = plan.aggregate
        column = None if a.column is None else source.check(a.column)
        check_aggregate(a.function, column)
        cell = None if column is None else F.col(source.name(a.column))
        value = aggregate(a.function, cell, column and column.type, plan.options.wrap_overflow).alias(_call_name(a.function, column))
        both = source.df.agg(value, F.count(F.lit(1) if cell is None else cell).alias("__contributing"))
        return Result(plan, both.select(both.columns[0]), both)
    columns = [(source.name(i), source.check(i).name) for i in plan.columns]
    rows = source.df.orderBy(*source.places) if context.ordered == "all" else source.df
    return Result(plan, _dealt(project(rows, columns), plan.options))


def project(df: DataFrame, columns: list[tuple[str, str]], unique: bool = False) -> DataFrame:
    names = output_names([n for _, n in columns], unique)
    return df.select(*(F.col(c).alias(n) for (c, _), n in zip(columns, names, strict=True)))


def _call_name(function: str, column: Column | None, prefix: str = "") -> str:
    return f"{function.lower()}_{'star' if column is None else prefix + column.name}"


def grouped(df: DataFrame, columns: list[tuple[str, Column, str]], g: Grouping, options: Options, ordered: bool) -> DataFrame:
    """columns: internal name, column, and name in the output, of all that can be grouped or aggregated."""
    for i in (*g.keys, *(a.column for a in g.aggregates if a.column is not None)):
        if not 0 <= i < len(columns):
            raise SqlCompileError(f"there is no column {i} to group")
    for i in g.keys:
        check_key(columns[i][1], "GROUP BY")
    calls = []
    for i, a in enumerate(g.aggregates):
        name, column, _ = columns[a.column] if a.column is not None else (None, None, None)
        check_aggregate(a.function, column)
        calls.append(aggregate(a.function, name and F.col(name), column and column.type, options.wrap_overflow).alias(f"a{i}"))
    keys = [f"k{i}" for i in range(len(g.keys))]
    out = df.groupBy(*(F.col(columns[k][0]).alias(n) for n, k in zip(keys, g.keys, strict=True))).agg(*calls)
    if ordered:
        out = out.orderBy(*group_order([F.col(k) for k in keys]))
    shown = []
    for kind, i in g.layout:
        if kind == "key":
            shown.append((f"k{i}", columns[g.keys[i]][2]))
        else:
            a = g.aggregates[i]
            shown.append((f"a{i}", f"{a.function.lower()}_{'star' if a.column is None else columns[a.column][2]}"))
    return project(out, shown)


@lower.register
def _(plan: GroupPlan, context: Context) -> Result:
    source = Input(context.catalog[plan.table], plan.filters, "c")
    columns = [(source.name(i), c, c.name) for i, c in enumerate(source.table.schema)]
    out = grouped(source.df, columns, plan.grouping, plan.options, context.ordered != "none")
    if context.spill_hook and plan.options.spill_threshold is not None:
        batch = F.substring_index(f"c{BATCH}", "|", 1).cast("int")
        _tell(source.df, [columns[k] for k in plan.grouping.keys], batch, plan.options.spill_threshold, context.spill_hook)
    return Result(plan, _dealt(out, plan.options))


def _tell(df: DataFrame, keys: list[tuple[str, Column, str]], batch: SparkColumn, threshold: int, hook: SpillHook) -> None:
    """One line for each batch that has at least `threshold` groups; the result doesn't depend on it."""
    text = any(c.type is ColumnType.UTF8 for _, c, _ in keys)
    groups = F.struct(*(F.col(name) for name, _, _ in keys))
    many = df.groupBy(batch.alias("batch")).agg(F.count_distinct(groups).alias("n")).filter(F.col("n") >= threshold).orderBy("batch")
    for row in many.toLocalIterator():
        hook(json.dumps({"op": "hash_agg_partial_utf8" if text else "hash_agg_partial", "batch": row["batch"], "entries": row["n"]}))


@lower.register
def _(plan: SortPlan, context: Context) -> Result:
    source = Input(context.catalog[plan.table], plan.filters, "c")
    keys = []
    for i, descending in plan.keys:
        check_key(source.check(i), "ORDER BY")
        keys += order(F.col(source.name(i)), source.check(i).type, descending, plan.options.nan_first)
    rows = (source.df if keys else _first(source, plan.limit)).orderBy(*(keys or source.places))
    if plan.limit is not None:
        rows = rows.limit(plan.limit)
    return Result(plan, project(rows, [(source.name(i), source.check(i).name) for i in plan.columns]))


def _joined(plan: JoinPlan, context: Context) -> tuple[Callable[[DataFrame], DataFrame], Input, Input]:
    """What joins rows of the left side with the right one, and both sides."""
    left, right = Input(context.catalog[plan.left], plan.left_filters, "l"), Input(context.catalog[plan.right], plan.right_filters, "r")
    on = []
    for a, b in zip(plan.left_keys, plan.right_keys, strict=True):
        if left.check(a).type is not right.check(b).type or left.check(a).type is ColumnType.OPAQUE:
            raise SqlCompileError(f"'{left.check(a).name}' and '{right.check(b).name}' can't be join keys")
        on.append(F.col(left.name(a)) == F.col(right.name(b)))
    hint = {HASH: "shuffle_hash", MERGE: "merge"}.get(plan.algorithm)
    # The right side is the build side of a hash join.
    join = lambda df: df.join(right.df.hint(hint) if hint else right.df, on, "inner")
    return join, left, right


def _join_output(plan: JoinPlan, left: Input, right: Input) -> list[tuple[str, str]]:
    sides = (left, right)
    return [(sides[s].name(c), f"{sides[s].table.name}_{sides[s].check(c).name}") for s, c in join_columns(plan, left.table, right.table)]


@lower.register
def _(plan: JoinPlan, context: Context) -> Result:
    join, left, right = _joined(plan, context)
    df = join(left.df)
    if context.ordered == "all":
        # A merge goes by keys, other joins by the left rows; both then by the order of rows.
        keys = [F.col(left.name(i)).asc() for i in plan.left_keys] if plan.algorithm == MERGE else []
        df = df.orderBy(*keys, *left.places, *right.places)
    return Result(plan, _dealt(project(df, _join_output(plan, left, right), unique=True), plan.options))


@lower.register
def _(plan: JoinSortPlan, context: Context) -> Result:
    join, left, right = _joined(plan.join, context)
    output = _join_output(plan.join, left, right)
    keys = []
    for place, descending in plan.keys:
        if not 0 <= place < len(output):
            raise SqlCompileError(f"the join has no output column {place}")
        side, i = join_columns(plan.join, left.table, right.table)[place]
        column = (left, right)[side].check(i)
        check_key(column, "ORDER BY")
        keys += order(F.col(output[place][0]), column.type, descending, plan.join.options.nan_first)
    df = join(left.df) if keys else _first(left, plan.limit, join)
    rows = df.orderBy(*(keys or [*left.places, *right.places]))
    if plan.limit is not None:
        rows = rows.limit(plan.limit)
    return Result(plan, project(rows, output, unique=True))


@lower.register
def _(plan: GroupedJoinPlan, context: Context) -> Result:
    join, left, right = _joined(plan.join, context)
    df = join(left.df)
    columns = [(s.name(i), c, f"{s.table.name}_{c.name}") for s in (left, right) for i, c in enumerate(s.table.schema)]
    if context.spill_hook and plan.join.options.spill_threshold is not None:
        # The rows of a join are one batch.
        _tell(df, [columns[k] for k in plan.grouping.keys], F.lit(0), plan.join.options.spill_threshold, context.spill_hook)
    return Result(plan, _dealt(grouped(df, columns, plan.grouping, plan.join.options, context.ordered != "none"), plan.join.options))
