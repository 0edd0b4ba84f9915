"""Names and ids of tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from plinth.errors import CatalogError
from plinth.sources.tables import Table


class Catalog:
    """Tables by name, without regard to case, and by id; a name or an id is taken only once."""

    def __init__(self) -> None:
        self._named: dict[str, Table] = {}
        self._by_id: dict[uuid.UUID, Table] = {}

    def register(self, table: Table) -> Table:
        if table.name.casefold() in self._named:
            raise CatalogError(f"there is a table '{table.name}' already")
        if table.id in self._by_id:
            raise CatalogError(f"there is a table of id {table.id.hex} already")
        self._named[table.name.casefold()] = self._by_id[table.id] = table
        return table

    def get(self, key: str | uuid.UUID) -> Table | None:
        return self._by_id.get(key) if isinstance(key, uuid.UUID) else self._named.get(key.casefold())

    def __getitem__(self, key: str | uuid.UUID) -> Table:
        if (table := self.get(key)) is None:
            raise CatalogError(f"there is no table {key}")
        return table

    def __contains__(self, key: str | uuid.UUID) -> bool:
        return self.get(key) is not None

    def __iter__(self) -> Iterator[Table]:
        """By name."""
        return iter(sorted(self._named.values(), key=lambda t: (t.name.casefold(), t.name)))

    def __len__(self) -> int:
        return len(self._named)

    def names(self) -> list[str]:
        return [t.name for t in self]
