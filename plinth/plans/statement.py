"""The one statement of the subset, as written."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A column, perhaps with its table's name."""

    column: str
    table: str | None = None
    position: int | None = field(default=None, compare=False)

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Call:
    """SUM, MIN, MAX or COUNT of a column, or COUNT(*) without one."""

    function: str
    argument: Name | None

    def __str__(self) -> str:
        return f"{self.function}({self.argument or '*'})"


@dataclass(frozen=True)
class Literal:
    """kind: integer, decimal, string or boolean."""

    kind: str
    value: object

    def __str__(self) -> str:
        return "'" + str(self.value).replace("'", "''") + "'" if self.kind == "string" else str(self.value).upper()


@dataclass(frozen=True)
class Comparison:
    name: Name
    operator: str
    literal: Literal

    def __str__(self) -> str:
        return f"{self.name} {self.operator} {self.literal}"


@dataclass(frozen=True)
class SortKey:
    name: Name
    descending: bool = False

    def __str__(self) -> str:
        return f"{self.name} {'DESC' if self.descending else 'ASC'}"


@dataclass(frozen=True)
class Join:
    """Equalities of a left with a right column."""

    table: str
    on: tuple[tuple[Name, Name], ...]


@dataclass(frozen=True)
class Select:
    """items: None for *."""

    items: tuple[Name | Call, ...] | None
    table: str
    join: Join | None = None
    where: tuple[Comparison, ...] = ()
    group_by: tuple[Name, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None

    def explain(self) -> str:
        """The statement on one line, its clauses in order of evaluation."""
        parts = [f"scan {self.table}"]
        if self.join:
            parts = [f"join {self.table} with {self.join.table} on {' and '.join(f'{a} = {b}' for a, b in self.join.on)}"]
        if self.where:
            parts.append("filter " + " and ".join(map(str, self.where)))
        if self.group_by:
            parts.append("group by " + ", ".join(map(str, self.group_by)))
        parts.append("output " + ("*" if self.items is None else ", ".join(map(str, self.items))))
        if self.order_by:
            parts.append("order by " + ", ".join(map(str, self.order_by)))
        if self.limit is not None:
            parts.append(f"limit {self.limit}")
        return " | ".join(parts)
