"""Stored tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plinth.errors import SqlCompileError
from plinth.operators.lower import Input, grouped, project
from plinth.plans.physical import GroupPlan, ScanPlan
from plinth.sources.store import Store


def follow(store: Store, name: str, max_files: int = 64) -> DataFrame:
    """The rows of a stored table, those there and those still to be appended, as a streaming DataFrame."""
    table = store.catalog[name]
    folder = store.place(table)
    store.files.make(folder)
    return store.spark.readStream.schema(table.schema.to_spark()).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.parquet").parquet(folder)


def apply(plan: ScanPlan | GroupPlan, store: Store) -> DataFrame:
    """A scan or grouped plan over a stored table's stream: the checks, filters, names and layout of a run over the table; groups are running and unordered."""
    if not isinstance(plan, (ScanPlan, GroupPlan)) or isinstance(plan, ScanPlan) and plan.aggregate:
        raise SqlCompileError("only scans and grouped scans can follow a stream")
    table = store.catalog[plan.table]
    source = Input(table, plan.filters, "c", follow(store, table.name))
    if isinstance(plan, GroupPlan):
        return grouped(source.df, [(source.name(i), c, c.name) for i, c in enumerate(table.schema)], plan.grouping, plan.options, ordered=False)
    return project(source.df, [(source.name(i), source.check(i).name) for i in plan.columns])
