"""The engine: a catalog, statements and plans over it."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from plinth.operators.lower import Context, SpillHook, lower
from plinth.operators.result import Result
from plinth.plans.binder import compile_sql
from plinth.plans.builder import Query
from plinth.plans.grammar import parse
from plinth.plans.physical import AUTO, Options, Plan
from plinth.plans.statement import Select
from plinth.sources.catalog import Catalog
from plinth.sources.store import Store
from plinth.sources.tables import Table, ordered_parquet
from plinth.types import ColumnType, Schema


#: (statement, catalog, options, join algorithm) -> plan; (plan, context) -> result.
Compiler = Callable[[str, Catalog, Options, str], Plan]
Executor = Callable[[Plan, Context], Result]


class Engine:
    """Runs strict-subset SQL and plans as Spark DataFrames.

    ordered: what results are sorted by without being asked to: "groups" (grouped
    results come in key order), "all" (scans and joins in row order as well), "none".
    compiler, executor: what turns a statement into a plan, and a plan into a result,
    in place of the engine's own.
    """

    def __init__(
        self, spark: SparkSession, catalog: Catalog | None = None, store: Store | None = None, options: Options | None = None, spill_hook: SpillHook | None = None, ordered: str = "groups",
        compiler: Compiler = compile_sql, executor: Executor = lower,
    ):
        self.spark, self.store, self.options, self.compiler, self.executor = spark, store, options or Options(), compiler, executor
        self.catalog = store.catalog if store else catalog if catalog is not None else Catalog()
        self._context = Context(self.catalog, spill_hook, ordered)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **more: object) -> Engine:
        """Over a folder's durable tables."""
        return cls(spark, store=Store(spark, folder), **more)

    def create_table(self, name: str, columns: Schema | Sequence[tuple[str, ColumnType]], rows: Sequence[Sequence] | None = None, strict: bool = False) -> Table:
        """An empty table, durable if the engine has a store; rows: a first batch."""
        schema = columns if isinstance(columns, Schema) else Schema(columns)
        table = self.store.create(name, schema, strict=strict) if self.store else self.catalog.register(Table(self.spark, name, schema, strict=strict))
        if rows is not None:
            table.append(rows)
        return table

    def register(self, name: str, df: DataFrame) -> Table:
        """A table of a DataFrame's rows."""
        return self.catalog.register(Table.over(self.spark, name, df))

    def register_parquet(self, name: str, path: str) -> Table:
        """A table of Parquet files, its rows ordered by file and place."""
        return self.catalog.register(Table.over(self.spark, name, ordered_parquet(self.spark, path), files=True))

    def register_csv(self, name: str, path: str, schema: Schema, header: bool = True) -> Table:
        return self.register(name, self.spark.read.csv(path, schema=schema.to_spark(), header=header))

    def compile(self, sql: str, options: Options | None = None, algorithm: str = AUTO) -> Plan:
        return self.compiler(sql, self.catalog, options or self.options, algorithm)

    def execute_sql(self, sql: str, options: Options | None = None, algorithm: str = AUTO) -> Result:
        return self.execute_plan(self.compile(sql, options, algorithm))

    def execute_plan(self, plan: Plan) -> Result:
        return self.executor(plan, self._context)

    def table(self, name: str) -> Query:
        """A statement over a table, to be built by calls."""
        return Query(self, Select(None, name))

    def sql(self, sql: str, **more: object) -> DataFrame:
        return self.execute_sql(sql, **more).df

    def explain(self, sql: str) -> str:
        """The statement, its plan, and Spark's."""
        plan = self.compile(sql)
        df = self.execute_plan(plan).df
        return "\n".join([parse(sql).explain(), plan.explain(), df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])

    @contextlib.contextmanager
    def session(self, tag: str) -> Iterator[Engine]:
        """Jobs that this thread starts within can be stopped by cancel(tag)."""
        context = self.spark.sparkContext
        context.addJobTag(tag)
        try:
            yield self
        finally:
            context.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        """Stops jobs of the tag, whichever threads started them; a session's own tags are known to their thread only."""
        self.spark.sparkContext.cancelJobsWithTag(tag)
