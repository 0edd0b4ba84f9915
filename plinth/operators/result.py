"""What running a plan gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


class Result:
    """df: the rows, evaluated when asked for.  Closing frees what was kept; it may be done twice, and ends all use."""

    def __init__(self, plan: object, df: DataFrame | None, counted: DataFrame | None = None):
        self.plan, self._df, self._counted = plan, df, counted
        self._row: Row | None = None
        self._closed = False

    @classmethod
    def empty(cls, plan: object) -> Result:
        return cls(plan, None)

    @property
    def is_aggregate(self) -> bool:
        """Whether this is the single value of an aggregate over a whole table."""
        return self._counted is not None

    @property
    def df(self) -> DataFrame:
        self._check()
        if self._df is None:
            raise ValueError("an empty result has no columns")
        return self._df

    def rows(self) -> list[Row]:
        self._check()
        return [] if self._df is None else self._df.collect()

    def row_count(self) -> int:
        self._check()
        return 0 if self._df is None else 1 if self.is_aggregate else self._df.count()

    def _value(self) -> Row:
        self._check()
        if not self.is_aggregate:
            raise ValueError("this result is no single value")
        self._row = self._row or self._counted.first()
        return self._row

    def value(self) -> object:
        """An aggregate's value, None for null."""
        return self._value()[0]

    def contributing_rows(self) -> int:
        """How many rows an aggregate's value comes from."""
        return self._value()["__contributing"]

    def _check(self) -> None:
        if self._closed:
            raise RuntimeError("this result is closed")

    def close(self) -> None:
        if not self._closed and self._df is not None:
            self._df.unpersist()
        self._closed = True

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
