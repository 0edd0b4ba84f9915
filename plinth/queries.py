"""The query catalogue for the driver: strict SQL over its tables, plans by hand, and the same in DuckDB's SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.engine import Engine
from plinth.plans.physical import HASH, MERGE, Aggregate, Filter, Grouping, GroupPlan, JoinPlan, Options, ScanPlan, SortPlan
from plinth.sources import batchfile, columnfile, spark_formats
from plinth.sources.files import scratch
from plinth.sources.store import export_snapshot, import_snapshot
from plinth.types import ColumnType as C
from plinth.types import Schema

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

Query = Callable[[SparkSession, str], DataFrame]


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    out = Engine(spark)
    for t in tables:
        out.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return out


def _tables_of(sql: str) -> list[str]:
    words = sql.replace(",", " ").replace(".", " ").split()
    return [t for t in TABLES if t in words]


def _derived(e: Engine, spark: SparkSession, sf_dir: str) -> None:
    """Tables that have what the driver's lack: booleans, text keys, two-column keys."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    e.register("flags", read("labels").select("doc_id", (F.col("toxic") == 1).alias("toxic_b"), "quality"))
    e.register("langs", spark.createDataFrame([("en", "English"), ("de", "German"), ("fr", "French"), ("xx", "None")], "code string, title string"))
    e.register("firsts", read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity")))


_FLAGS = "(SELECT doc_id, toxic = 1 AS toxic_b, quality FROM labels)"
_LANGS = "(VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('xx', 'None')) AS langs(code, title)"

#: name -> (strict SQL, DuckDB's SQL; None where the same text with output names works).
SQL: dict[str, tuple[str, str]] = {
    "scan_star": ("SELECT * FROM nation", "SELECT * FROM nation"),
    "project_list": ("SELECT c_name, c_acctbal FROM customer", "SELECT c_name, c_acctbal FROM customer"),
    "project_reordered": ("SELECT customer.c_acctbal, c_custkey, c_name FROM customer", "SELECT c_acctbal, c_custkey, c_name FROM customer"),
    "project_repeated": ("SELECT r_name, r_name FROM region", "SELECT r_name, r_name AS r_name_2 FROM region"),
    "project_opaque": ("SELECT o_orderkey, o_orderdate FROM orders", "SELECT o_orderkey, o_orderdate FROM orders"),
    "filter_utf8_eq": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_utf8_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O'", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O'"),
    "filter_utf8_quote": ("SELECT c_custkey FROM customer WHERE c_name <> 'it''s'", "SELECT c_custkey FROM customer WHERE c_name <> 'it''s'"),
    "filter_and_mixed": ("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 AND l_returnflag <> 'N'"),
    "agg_count_star": ("SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'O'", "SELECT COUNT(*) AS count_star FROM orders WHERE o_orderstatus = 'O'"),
    "agg_count_col": ("SELECT COUNT(c_name) FROM customer", "SELECT COUNT(c_name) AS count_c_name FROM customer"),
    "agg_count_opaque": ("SELECT COUNT(embedding) FROM embeddings", "SELECT COUNT(embedding) AS count_embedding FROM embeddings"),
    "agg_sum_f64": ("SELECT SUM(l_quantity) FROM lineitem", "SELECT SUM(l_quantity) AS sum_l_quantity FROM lineitem"),
    "agg_sum_i32": ("SELECT SUM(l_linenumber) FROM lineitem", "SELECT CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber FROM lineitem"),
    "agg_sum_i64": ("SELECT SUM(n_chars) FROM documents WHERE lang = 'en'", "SELECT CAST(SUM(n_chars) AS BIGINT) AS sum_n_chars FROM documents WHERE lang = 'en'"),
    "agg_sum_none": ("SELECT SUM(l_quantity) FROM lineitem WHERE l_quantity > 1000000", "SELECT SUM(l_quantity) AS sum_l_quantity FROM lineitem WHERE l_quantity > 1000000"),
    "agg_min_f64": ("SELECT MIN(l_extendedprice) FROM lineitem", "SELECT MIN(l_extendedprice) AS min_l_extendedprice FROM lineitem"),
    "agg_max_f64": ("SELECT MAX(l_extendedprice) FROM lineitem WHERE l_returnflag = 'R'", "SELECT MAX(l_extendedprice) AS max_l_extendedprice FROM lineitem WHERE l_returnflag = 'R'"),
    "group_utf8_multi": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity), COUNT(*) FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_l_quantity, COUNT(*) AS count_star FROM lineitem GROUP BY ALL"),
    "group_filtered": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity), COUNT(*) FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_l_quantity, COUNT(*) AS count_star FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL"),
    "group_i32": ("SELECT n_regionkey, COUNT(n_name) FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, COUNT(n_name) AS count_n_name FROM nation GROUP BY ALL"),
    "group_i64": ("SELECT l_orderkey, SUM(l_linenumber), MAX(l_extendedprice) FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, CAST(SUM(l_linenumber) AS BIGINT) AS sum_l_linenumber, MAX(l_extendedprice) AS max_l_extendedprice FROM lineitem GROUP BY l_orderkey"),
    "group_f64_key": ("SELECT l_discount, COUNT(*) FROM lineitem GROUP BY l_discount", "SELECT l_discount, COUNT(*) AS count_star FROM lineitem GROUP BY l_discount"),
    "group_mixed": ("SELECT l_linenumber, l_returnflag, MIN(l_quantity), MAX(l_quantity) FROM lineitem GROUP BY l_linenumber, l_returnflag", "SELECT l_linenumber, l_returnflag, MIN(l_quantity) AS min_l_quantity, MAX(l_quantity) AS max_l_quantity FROM lineitem GROUP BY l_linenumber, l_returnflag"),
    "group_agg_before_key": ("SELECT SUM(l_quantity), l_returnflag FROM lineitem GROUP BY l_returnflag", "SELECT SUM(l_quantity) AS sum_l_quantity, l_returnflag FROM lineitem GROUP BY l_returnflag"),
    "group_key_left_out": ("SELECT COUNT(*) FROM orders GROUP BY o_orderpriority", "SELECT COUNT(*) AS count_star FROM orders GROUP BY o_orderpriority"),
    "group_empty": ("SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS count_star FROM orders WHERE o_totalprice < 0 GROUP BY o_orderstatus"),
    "group_bool": ("SELECT toxic_b, COUNT(*), SUM(quality) FROM flags GROUP BY toxic_b", f"SELECT toxic_b, COUNT(*) AS count_star, CAST(SUM(quality) AS BIGINT) AS sum_quality FROM {_FLAGS} GROUP BY toxic_b"),
    "join_default": ("SELECT orders.o_orderkey, customer.c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey WHERE customer.c_mktsegment = 'BUILDING' AND orders.o_totalprice > 100000", "SELECT o_orderkey AS orders_o_orderkey, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000"),
    "join_star": ("SELECT * FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey", "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name, n_regionkey AS nation_n_regionkey, r_regionkey AS region_r_regionkey, r_name AS region_r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_swapped_on": ("SELECT c_name, n_name FROM customer INNER JOIN nation ON nation.n_nationkey = customer.c_nationkey WHERE c_acctbal > 5000", "SELECT c_name AS customer_c_name, n_name AS nation_n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000"),
    "join_multi_key": ("SELECT lineitem.l_orderkey, firsts.quantity FROM lineitem INNER JOIN firsts ON lineitem.l_orderkey = firsts.l_orderkey AND lineitem.l_linenumber = firsts.l_linenumber WHERE lineitem.l_quantity > 45", "SELECT l.l_orderkey AS lineitem_l_orderkey, f.quantity AS firsts_quantity FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, SUM(l_quantity) AS quantity FROM lineitem GROUP BY ALL) f ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.l_linenumber WHERE l.l_quantity > 45"),
    "join_utf8_key": ("SELECT documents.doc_id, langs.title FROM documents INNER JOIN langs ON documents.lang = langs.code", f"SELECT doc_id AS documents_doc_id, title AS langs_title FROM documents JOIN {_LANGS} ON lang = code"),
    "join_group": ("SELECT customer.c_mktsegment, COUNT(*), SUM(orders.o_custkey) FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment", "SELECT c_mktsegment AS customer_c_mktsegment, COUNT(*) AS count_star, CAST(SUM(o_custkey) AS BIGINT) AS sum_orders_o_custkey FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "join_group_filtered": ("SELECT MAX(l_extendedprice), orders.o_orderpriority FROM lineitem INNER JOIN orders ON lineitem.l_orderkey = orders.o_orderkey WHERE lineitem.l_returnflag = 'R' AND o_orderstatus = 'F' GROUP BY orders.o_orderpriority", "SELECT MAX(l_extendedprice) AS max_lineitem_l_extendedprice, o_orderpriority AS orders_o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' GROUP BY o_orderpriority"),
    "order_multi_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 10"),
    "order_full": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey DESC", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey DESC NULLS LAST"),
    "order_by_hidden": ("SELECT c_name FROM customer ORDER BY c_custkey LIMIT 5", "SELECT c_name FROM customer ORDER BY c_custkey NULLS FIRST LIMIT 5"),
    "order_utf8": ("SELECT n_name FROM nation WHERE n_regionkey <> 1 ORDER BY n_name DESC LIMIT 7", "SELECT n_name FROM nation WHERE n_regionkey <> 1 ORDER BY n_name DESC NULLS LAST LIMIT 7"),
    "limit_only": ("SELECT c_custkey FROM customer LIMIT 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7"),
    "limit_filtered": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' LIMIT 9", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 9"),
    "join_order_limit": ("SELECT orders.o_orderkey, orders.o_totalprice, customer.c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey ORDER BY orders.o_totalprice DESC, orders.o_orderkey LIMIT 10", "SELECT o_orderkey AS orders_o_orderkey, o_totalprice AS orders_o_totalprice, c_name AS customer_c_name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "join_limit": ("SELECT nation.n_nationkey, region.r_name FROM nation INNER JOIN region ON nation.n_regionkey = region.r_regionkey LIMIT 6", "SELECT n_nationkey AS nation_n_nationkey, r_name AS region_r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_nationkey LIMIT 6"),
}
for _kind, _sql in (("i32", "SELECT p_partkey FROM part WHERE p_size {} 10"), ("i64", "SELECT o_orderkey FROM orders WHERE o_custkey {} 500"), ("f64", "SELECT o_orderkey FROM orders WHERE o_totalprice {} 100000"), ("bool", "SELECT doc_id FROM flags WHERE toxic_b {} TRUE")):
    for _name, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
        SQL[f"filter_{_kind}_{_name}"] = (_sql.format(_sign), _sql.format(_sign).replace("FROM flags", f"FROM {_FLAGS}"))


def _sql_query(sql: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *_tables_of(sql))
        if any(t in sql for t in ("flags", "langs", "firsts")):
            _derived(e, spark, sf_dir)
        return e.sql(sql)

    return run


def _join_by(algorithm: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, "orders", "customer").sql(SQL["join_default"][0], algorithm=algorithm)

    return run


def _plan(make: Callable[[Engine], object], *tables: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, *tables)
        return e.execute_plan(make(e)).df

    return run


def _contributing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "lineitem")
    result = e.execute_sql("SELECT SUM(l_quantity) FROM lineitem WHERE l_returnflag = 'A'")
    return spark.createDataFrame([(result.value(), result.contributing_rows())], "value double, contributing long")


_ORDERS = [("o_orderkey", C.INT64), ("o_totalprice", C.FLOAT64), ("o_orderstatus", C.UTF8)]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*(n for n, _ in _ORDERS))


def _persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as two batches of a durable table, read by another engine."""
    folder, rows = scratch(spark), _orders(spark, sf_dir)
    table = Engine.open(spark, folder).create_table("orders", _ORDERS)
    table.append(rows.filter("o_totalprice < 100000"))
    table.append(rows.filter("o_totalprice >= 100000"))
    return Engine.open(spark, folder).sql("SELECT o_orderstatus, COUNT(*), MAX(o_totalprice) FROM orders GROUP BY o_orderstatus")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    export_snapshot(engine(spark, sf_dir, "customer", "nation").catalog, folder, spark)
    return Engine(spark, import_snapshot(spark, folder)).sql("SELECT c_custkey, n_name FROM customer INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey")


def _local(folder: str) -> str:
    """A folder as workers' plain files reach it; the binary formats know no other file systems."""
    return folder[folder.index("/") :] if folder.startswith("file:") else folder


def _batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark_formats.register(spark)
    folder, rows = _local(scratch(spark)), _orders(spark, sf_dir)
    rows.write.format("plinth_batch").mode("append").save(folder)
    return spark.read.format("plinth_batch").schema(rows.schema).load(folder)


def _column_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of nations as column files; the driver writes them, and the table has a handful of rows whatever the scale."""
    spark_formats.register(spark)
    folder, rows = _local(scratch(spark)), spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey")
    for name, column in zip(rows.columns, rows.toArrow().combine_chunks().columns, strict=True):
        columnfile.write(os.path.join(folder, f"{name}.col"), pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type))
    return spark.read.format("plinth_column").schema(rows.schema).load(folder)


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = scratch(spark), _orders(spark, sf_dir)
    rows.write.csv(f"{folder}/csv", header=True)
    e = Engine(spark)
    e.register_csv("orders", f"{folder}/csv", Schema(_ORDERS))
    return e.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")


def _codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions through bytes and back; the table has a handful of rows whatever the scale."""
    names, kinds = ["r_regionkey", "r_name"], [pa.int32(), pa.string()]
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(*names).toArrow()
    columns = [pa.array(rows.column(n).to_pylist(), k) for n, k in zip(names, kinds, strict=True)]
    back = batchfile.decode(batchfile.encode(pa.RecordBatch.from_arrays(columns, names=names)), names)
    return spark.createDataFrame(back.to_pylist(), T.StructType([T.StructField("r_regionkey", T.IntegerType()), T.StructField("r_name", T.StringType())]))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "part").table("part").where("p_size", ">", 40).select("p_partkey", "p_size").order_by("p_size").order_by("p_partkey").limit(25).run().df


def _spilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the metrics hook hears of a grouped scan and a grouped join of orders with more groups than the threshold."""
    told: list[str] = []
    e = engine(spark, sf_dir, "orders", "customer")
    e = Engine(spark, e.catalog, spill_hook=told.append, options=Options(spill_threshold=3))
    e.sql("SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority")
    e.sql("SELECT customer.c_mktsegment, COUNT(*) FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey GROUP BY customer.c_mktsegment")
    return spark.createDataFrame([(line,) for line in told], "line string")


def _by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "documents")
    _derived(e, spark, sf_dir)
    return e.sql(SQL["join_utf8_key"][0], algorithm=MERGE)


def _fixture(columns: list[tuple[str, C]], rows: list[tuple], sql: str, **more: object) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = Engine(spark)
        e.create_table("t", columns, rows)
        return e.sql(sql, **more)

    return run


_NAN = float("nan")
_N1 = ([("k", C.INT32), ("g", C.UTF8), ("x", C.FLOAT64)], [(1, "a", 1.0), (None, "a", None), (2, None, 3.0), (None, None, None)])
_N2 = ([("x", C.FLOAT64)], [(1.0,), (_NAN,), (None,), (-2.0,)])
_N4 = ([("k", C.INT32), ("s", C.UTF8)], [(2, "b"), (None, "c"), (1, None), (1, "a")])
_N6 = ([("b", C.BOOLEAN)], [(True,), (False,), (None,)])
_V1 = "(VALUES (1, 'a', 1.0::DOUBLE), (NULL, 'a', NULL), (2, NULL, 3.0), (NULL, NULL, NULL)) AS t(k, g, x)"
_V2 = "(VALUES (1.0::DOUBLE), ('NaN'::DOUBLE), (NULL), (-2.0)) AS t(x)"
_V4 = "(VALUES (2, 'b'), (NULL, 'c'), (1, NULL), (1, 'a')) AS t(k, s)"
_V6 = "(VALUES (TRUE), (FALSE), (NULL)) AS t(b)"

_ID = lambda e, name: e.catalog[name].id

#: name -> (query, DuckDB's SQL).
OTHERS: dict[str, tuple[Query, str]] = {
    "join_hash": (_join_by(HASH), SQL["join_default"][1]),
    "join_merge": (_join_by(MERGE), SQL["join_default"][1]),
    "plan_scan": (_plan(lambda e: ScanPlan(_ID(e, "part"), (0, 4), (Filter(4, ">=", 40),)), "part"), "SELECT p_partkey, p_size FROM part WHERE p_size >= 40"),
    "plan_aggregate": (_plan(lambda e: ScanPlan(_ID(e, "orders"), (), (), Aggregate("COUNT"), Options(parallelism=4)), "orders"), "SELECT COUNT(*) AS count_star FROM orders"),
    "plan_group": (_plan(lambda e: GroupPlan(_ID(e, "lineitem"), Grouping((8, 3), (Aggregate("SUM", 4), Aggregate("COUNT", 0)), (("aggregate", 1), ("key", 0), ("key", 1), ("aggregate", 0)))), "lineitem"), "SELECT COUNT(l_orderkey) AS count_l_orderkey, l_returnflag, l_linenumber, SUM(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY l_returnflag, l_linenumber"),
    "plan_sort": (_plan(lambda e: SortPlan(_ID(e, "part"), (0, 5), ((5, True), (0, False)), 12), "part"), "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 12"),
    "plan_merge_join": (_plan(lambda e: JoinPlan(_ID(e, "supplier"), _ID(e, "nation"), (2,), (0,), ((0, 1), (1, 1)), algorithm=MERGE), "supplier", "nation"), "SELECT s_name AS supplier_s_name, n_name AS nation_n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "contributing_rows": (_contributing, "SELECT SUM(l_quantity) AS value, COUNT(l_quantity) AS contributing FROM lineitem WHERE l_returnflag = 'A'"),
    "persist_roundtrip": (_persisted, "SELECT o_orderstatus, COUNT(*) AS count_star, MAX(o_totalprice) AS max_o_totalprice FROM orders GROUP BY o_orderstatus"),
    "export_import": (_exported, "SELECT c_custkey AS customer_c_custkey, n_name AS nation_n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "batch_files": (_batch_files, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"),
    "column_files": (_column_files, "SELECT n_nationkey, n_regionkey FROM nation"),
    "csv_scan": (_csv, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"),
    "built_statement": (_built, "SELECT p_partkey, p_size FROM part WHERE p_size > 40 ORDER BY p_size, p_partkey LIMIT 25"),
    "spill_lines": (_spilled, """
        SELECT '{"op": "hash_agg_partial_utf8", "batch": 0, "entries": ' || count(DISTINCT o_orderpriority) || '}' AS line FROM orders
        UNION ALL SELECT '{"op": "hash_agg_partial_utf8", "batch": 0, "entries": ' || count(DISTINCT c_mktsegment) || '}' FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "join_utf8_merge": (_by_text, SQL["join_utf8_key"][1]),
    "codec_roundtrip": (_codec, "SELECT * FROM region"),
    "null_groups": (_fixture(*_N1, "SELECT k, g, SUM(x), COUNT(x), COUNT(*) FROM t GROUP BY k, g"), f"SELECT k, g, SUM(x) AS sum_x, COUNT(x) AS count_x, COUNT(*) AS count_star FROM {_V1} GROUP BY k, g"),
    "null_filter": (_fixture(*_N1, "SELECT k FROM t WHERE k <> 1"), f"SELECT k FROM {_V1} WHERE k <> 1"),
    "null_order": (_fixture(*_N4, "SELECT k, s FROM t ORDER BY k, s DESC LIMIT 3"), f"SELECT k, s FROM {_V4} ORDER BY k NULLS FIRST, s DESC NULLS LAST LIMIT 3"),
    "null_bool": (_fixture(*_N6, "SELECT b, COUNT(*) FROM t WHERE b <= TRUE GROUP BY b"), f"SELECT b, COUNT(*) AS count_star FROM {_V6} WHERE b <= TRUE GROUP BY b"),
    "nan_filter": (_fixture(*_N2, "SELECT x FROM t WHERE x > 0.5"), f"SELECT x FROM {_V2} WHERE x > 0.5 AND NOT isnan(x)"),
    "nan_first_order": (_fixture(*_N2, "SELECT x FROM t ORDER BY x DESC LIMIT 2", options=Options(nan_first=True)), f"SELECT x FROM {_V2} ORDER BY (x IS NULL), coalesce(isnan(x), FALSE), x DESC LIMIT 2"),
    "sum_wraps": (_fixture([("v", C.INT64)], [(2**63 - 1,), (2,)], "SELECT SUM(v) FROM t", options=Options(wrap_overflow=True)), "SELECT CAST(-9223372036854775807 AS BIGINT) AS sum_v"),
}

QUERIES: dict[str, Query] = {name: _sql_query(sql) for name, (sql, _) in SQL.items()} | {name: q for name, (q, _) in OTHERS.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in SQL.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
#: The minimum slice of the engine, run by the driver's smoke check.
FLAGSHIP = "group_filtered"
