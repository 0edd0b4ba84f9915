"""A strict-subset analytics engine that plans on Spark.

    from plinth import Engine
    engine = Engine(spark)
    engine.register_parquet("lineitem", ".../lineitem.parquet")
    engine.sql("SELECT l_returnflag, SUM(l_quantity) FROM lineitem GROUP BY l_returnflag").show()
"""

from plinth.engine import Engine
from plinth.errors import CatalogError, FormatError, SqlCompileError
from plinth.plans.binder import compile_sql
from plinth.plans.grammar import parse
from plinth.types import Column, ColumnType, Schema

__all__ = ["CatalogError", "Column", "ColumnType", "Engine", "FormatError", "Schema", "SqlCompileError", "compile_sql", "parse"]
