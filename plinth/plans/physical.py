"""Plans that can be run, by ordinals; compiled from statements or made by hand."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from plinth.errors import SqlCompileError

AUTO, HASH, MERGE = "auto", "hash", "merge"
FUNCTIONS = ("SUM", "MIN", "MAX", "COUNT")
OPERATORS = ("=", "<>", "<", "<=", ">", ">=")
#: Grouping keys at most.
MOST_KEYS = 32


@dataclass(frozen=True)
class Options:
    """parallelism: partitions of results (-1: as planned, 0: one); spill_threshold: groups in a batch from which the metrics hook hears of it;
    nan_first: order NaN below all numbers; wrap_overflow: integer sums wrap instead of failing;
    scheduler: "static" or "channel", how batches reach workers elsewhere; Spark's scheduler gives the same rows for both."""

    parallelism: int = -1
    spill_threshold: int | None = None
    nan_first: bool = False
    wrap_overflow: bool = False
    scheduler: str = "static"

    def __post_init__(self) -> None:
        if self.scheduler not in ("static", "channel"):
            raise SqlCompileError(f"unknown scheduler {self.scheduler}")


@dataclass(frozen=True)
class Filter:
    """column op value; the value has the column's type."""

    column: int
    operator: str
    value: object

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise SqlCompileError(f"unknown operator {self.operator}")

    def __str__(self) -> str:
        return f"#{self.column} {self.operator} {self.value!r}"


@dataclass(frozen=True)
class Aggregate:
    """column: None for COUNT(*)."""

    function: str
    column: int | None = None

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS:
            raise SqlCompileError(f"unknown aggregate {self.function}")
        if self.column is None and self.function != "COUNT":
            raise SqlCompileError(f"{self.function} needs a column")

    def __str__(self) -> str:
        return f"{self.function}({'*' if self.column is None else f'#{self.column}'})"


def _list(items) -> str:
    return "[" + ", ".join(str(i) if not isinstance(i, int) else f"#{i}" for i in items) + "]"


@dataclass(frozen=True)
class ScanPlan:
    """Filtered rows, projected or folded into one aggregate."""

    table: uuid.UUID
    columns: tuple[int, ...]
    filters: tuple[Filter, ...] = ()
    aggregate: Aggregate | None = None
    options: Options = field(default=Options(), compare=False)

    def __post_init__(self) -> None:
        if self.aggregate is None and not self.columns:
            raise SqlCompileError("a scan needs a column at least")

    def explain(self) -> str:
        return f"Scan {self.table.hex} filters={_list(self.filters)} " + (f"aggregate={self.aggregate}" if self.aggregate else f"columns={_list(self.columns)}")


@dataclass(frozen=True)
class Grouping:
    """output: ("key" | "aggregate", place) in order; empty for keys, then aggregates."""

    keys: tuple[int, ...]
    aggregates: tuple[Aggregate, ...]
    output: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        if not self.keys:
            raise SqlCompileError("grouping needs a key at least")
        if len(self.keys) > MOST_KEYS:
            raise SqlCompileError(f"grouping takes {MOST_KEYS} keys at most")
        if not self.aggregates:
            raise SqlCompileError("grouping needs an aggregate at least")
        sizes = {"key": len(self.keys), "aggregate": len(self.aggregates)}
        for kind, place in self.output:
            if not 0 <= place < sizes.get(kind, 0):
                raise SqlCompileError(f"there is no {kind} {place} to put out")

    @property
    def layout(self) -> tuple[tuple[str, int], ...]:
        return self.output or (*(("key", i) for i in range(len(self.keys))), *(("aggregate", i) for i in range(len(self.aggregates))))

    def __str__(self) -> str:
        return f"keys={_list(self.keys)} aggregates={_list(self.aggregates)}"


@dataclass(frozen=True)
class GroupPlan:
    table: uuid.UUID
    grouping: Grouping
    filters: tuple[Filter, ...] = ()
    options: Options = field(default=Options(), compare=False)

    def explain(self) -> str:
        return f"Group {self.table.hex} filters={_list(self.filters)} {self.grouping}"


@dataclass(frozen=True)
class SortPlan:
    """keys: (column, descending); without keys the rows keep their order."""

    table: uuid.UUID
    columns: tuple[int, ...]
    keys: tuple[tuple[int, bool], ...] = ()
    limit: int | None = None
    filters: tuple[Filter, ...] = ()
    options: Options = field(default=Options(), compare=False)

    def __post_init__(self) -> None:
        _check_limit(self.limit)
        if not self.keys and self.limit is None:
            raise SqlCompileError("a sort needs a key or a limit")

    def explain(self) -> str:
        return f"Sort {self.table.hex} filters={_list(self.filters)} {_keys(self.keys)} limit={self.limit} columns={_list(self.columns)}"


def _keys(keys: tuple[tuple[int, bool], ...]) -> str:
    return "keys=[" + ", ".join(f"#{c} {'desc' if d else 'asc'}" for c, d in keys) + "]"


def _check_limit(limit: int | None) -> None:
    if limit is not None and limit < 1:
        raise SqlCompileError("a limit has to be positive")


@dataclass(frozen=True)
class JoinPlan:
    """Inner equi-join. columns: (side 0 or 1, column) in order; None for all of the left, then all of the right."""

    left: uuid.UUID
    right: uuid.UUID
    left_keys: tuple[int, ...]
    right_keys: tuple[int, ...]
    columns: tuple[tuple[int, int], ...] | None = None
    left_filters: tuple[Filter, ...] = ()
    right_filters: tuple[Filter, ...] = ()
    algorithm: str = AUTO
    options: Options = field(default=Options(), compare=False)

    def __post_init__(self) -> None:
        if not self.left_keys or len(self.left_keys) != len(self.right_keys):
            raise SqlCompileError("a join needs as many left keys as right ones, and one at least")
        if self.algorithm not in (AUTO, HASH, MERGE):
            raise SqlCompileError(f"unknown join algorithm {self.algorithm}")
        if self.left == self.right:
            raise SqlCompileError("a table can't be joined with itself")

    def explain(self) -> str:
        columns = "*" if self.columns is None else "[" + ", ".join(f"{'LR'[s]}#{c}" for s, c in self.columns) + "]"
        return f"Join({self.algorithm}) {self.left.hex}{_list(self.left_keys)} = {self.right.hex}{_list(self.right_keys)} left={_list(self.left_filters)} right={_list(self.right_filters)} columns={columns}"


@dataclass(frozen=True)
class JoinSortPlan:
    """keys: (place in the join's output, descending)."""

    join: JoinPlan
    keys: tuple[tuple[int, bool], ...] = ()
    limit: int | None = None

    def __post_init__(self) -> None:
        _check_limit(self.limit)
        if not self.keys and self.limit is None:
            raise SqlCompileError("a sort needs a key or a limit")

    def explain(self) -> str:
        return f"Sort {_keys(self.keys)} limit={self.limit} over {self.join.explain()}"


@dataclass(frozen=True)
class GroupedJoinPlan:
    """grouping counts the columns of all of the left, then all of the right."""

    join: JoinPlan
    grouping: Grouping

    def explain(self) -> str:
        return f"Group {self.grouping} over {self.join.explain()}"


@dataclass(frozen=True)
class NotePlan:
    """A plan that only says something; running it gives an empty result."""

    text: str

    def explain(self) -> str:
        return self.text


Plan = ScanPlan | GroupPlan | SortPlan | JoinPlan | JoinSortPlan | GroupedJoinPlan | NotePlan
