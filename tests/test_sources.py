"""Durable tables, snapshots, binary formats, streams."""

import os
import shutil
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plinth import CatalogError, ColumnType, Engine, FormatError, SqlCompileError
from plinth.plans.physical import Aggregate, Filter, Grouping, GroupPlan, Options, ScanPlan
from plinth.sources import batchfile, columnfile, spark_formats, store
from plinth.sources.store import Store, export_snapshot, import_snapshot
from plinth.streaming import apply

COLUMNS = [("port", ColumnType.UTF8), ("tide", ColumnType.FLOAT64)]


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_tables_outlive_their_engine(spark, tmp_path, prefix):
    folder, rows = f"{prefix}{tmp_path}/db", [("Brest", 6.25), (None, -0.5), ("Lagos", None), ("Brest", 3.0), ("Osaka", 1.75)]
    table = Engine.open(spark, folder).create_table("tides", COLUMNS, rows[:2])
    table.append(rows[2:4])
    again = Engine.open(spark, folder)
    assert [tuple(r) for r in again.sql("SELECT port, tide FROM tides LIMIT 50").collect()] == rows[:4]
    assert sorted(os.listdir(tmp_path / "db" / "tables" / table.id.hex)) == ["000000.parquet", "000001.parquet"]
    again.catalog["tides"].append(rows[4:])
    assert Engine.open(spark, folder).execute_sql("SELECT SUM(tide) FROM tides").value() == sum(t or 0 for _, t in rows)
    assert len(Store(spark, f"{folder}/nosuch").catalog) == 0


def test_what_wasnt_finished_isnt_read(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path))
    table = e.create_table("t", [("x", ColumnType.INT64)], [(1,), (2,)])
    place = tmp_path / "tables" / table.id.hex
    shutil.copytree(place / "000000.parquet", place / "000001.parquet")
    (place / "000001.parquet" / "_SUCCESS").unlink()
    again = Engine.open(spark, str(tmp_path))
    assert again.execute_sql("SELECT COUNT(*) FROM t").value() == 2
    again.catalog["t"].append([(5,)])
    assert [r[0] for r in Engine.open(spark, str(tmp_path)).sql("SELECT x FROM t LIMIT 9").collect()] == [1, 2, 5]
    # The first engine knows nothing of that batch; its own one must not replace it.
    with pytest.raises(CatalogError, match="somebody else"):
        table.append([(6,)])
    assert table.row_count() == 2


def test_very_many_batches_are_one_scan(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path))
    table = e.create_table("t", [("x", ColumnType.INT64)], [(0,), (1,)])
    place = tmp_path / "tables" / table.id.hex
    for i in range(1, 2000):
        shutil.copytree(place / "000000.parquet", place / f"{i:06d}.parquet", copy_function=os.link)
    again, began = Engine.open(spark, str(tmp_path)), time.monotonic()
    df = again.sql("SELECT x FROM t WHERE x = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - began < 60 and plan.count("FileScan") == 1 and "Union" not in plan
    assert again.execute_sql("SELECT COUNT(*) FROM t").value() == 4000
    again.catalog["t"].append([(7,)])
    assert sorted(os.listdir(place))[-1] == "002000.parquet"


def test_an_export_that_fails_leaves_the_one_before(spark, tmp_path, monkeypatch):
    e = Engine(spark)
    table = e.create_table("t", [("x", ColumnType.INT32)], [(1,)])
    export_snapshot(e.catalog, str(tmp_path))
    table.append([(2,)])
    write = store._write_segment

    def fail(files, folder, index, *more):
        if index:
            raise OSError("full")
        return write(files, folder, index, *more)

    monkeypatch.setattr(store, "_write_segment", fail)
    with pytest.raises(OSError):
        export_snapshot(e.catalog, str(tmp_path))
    assert import_snapshot(spark, str(tmp_path))["t"].row_count() == 1
    monkeypatch.undo()
    export_snapshot(e.catalog, str(tmp_path))
    assert import_snapshot(spark, str(tmp_path))["t"].row_count() == 2 and len([n for n in os.listdir(tmp_path) if n.startswith("tables")]) == 1


def test_large_batches_keep_their_order(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "db"))
    table = e.create_table("t", [("id", ColumnType.INT64)])
    table.append(spark.range(1000, numPartitions=4))
    (segment,) = (tmp_path / "db" / "tables" / table.id.hex).glob("*.parquet")
    assert len(list(segment.glob("part-*.parquet"))) == 4
    again = Engine.open(spark, str(tmp_path / "db"))
    assert [r[0] for r in again.sql("SELECT id FROM t LIMIT 600").collect()] == list(range(600))
    export_snapshot(again.catalog, str(tmp_path / "copy"))
    copied = Engine(spark, import_snapshot(spark, str(tmp_path / "copy")))
    assert [r[0] for r in copied.sql("SELECT id FROM t LIMIT 600").collect()] == list(range(600))


def test_a_failing_hook_takes_the_batch_back(spark):
    table = Engine(spark).create_table("t", [("x", ColumnType.INT32)])

    def fail(*_):
        raise OSError("full")

    table.hook = fail
    with pytest.raises(OSError):
        table.append([(1,)])
    assert table.row_count() == 0 and table.batches == ()


def test_snapshots(spark, tmp_path):
    e = Engine(spark)
    e.create_table("t", [("x", ColumnType.INT32)], [(1,), (2,), (3,)])
    for _ in range(2):
        export_snapshot(e.catalog, str(tmp_path))
    catalog = import_snapshot(spark, str(tmp_path))
    assert catalog["t"].row_count() == 3 and len(catalog["t"].batches) == 1 and catalog["t"].id == e.catalog["t"].id
    with pytest.raises(FileNotFoundError):
        import_snapshot(spark, str(tmp_path / "nosuch"))
    e.register("o", spark.sql("SELECT array(1) AS v"))
    with pytest.raises(CatalogError):
        export_snapshot(e.catalog, str(tmp_path))
    (tmp_path / "catalog.json").write_text('{"formatVersion": 2, "tables": []}')
    with pytest.raises(FormatError):
        import_snapshot(spark, str(tmp_path))


CELLS = {pa.int32(): st.integers(-(2**31), 2**31 - 1), pa.int64(): st.integers(-(2**63), 2**63 - 1), pa.float64(): st.floats(allow_nan=False), pa.bool_(): st.booleans(), pa.string(): st.text(max_size=8)}


@st.composite
def batches(draw):
    n = draw(st.integers(0, 20))
    kinds = draw(st.lists(st.sampled_from(list(CELLS)), min_size=1, max_size=5))
    return pa.RecordBatch.from_arrays([pa.array(draw(st.lists(st.none() | CELLS[k], min_size=n, max_size=n)), k) for k in kinds], names=[f"c{i}" for i in range(len(kinds))])


@settings(max_examples=60, deadline=None)
@given(batches(), st.booleans())
def test_batches_survive_bytes(batch, by_lengths):
    raw = batchfile.encode(batch, by_lengths)
    assert batchfile.decode(raw).equals(batch)
    for broken in (raw + b"\0", raw[:-1], b"X" + raw[1:], raw[:8] + b"\x02" + raw[9:]):
        with pytest.raises(FormatError):
            batchfile.decode(broken)


def test_bytes_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([1, None], pa.int32()), pa.array(["a", "bc"])], names=["x", "s"])
    assert batchfile.encode(batch) == (
        b"RNBATCH1" + bytes.fromhex("01000000 02000000 02000000") + bytes.fromhex("01 00 01 02000000 08000000 01000000 00000000 02")
        + bytes.fromhex("02 00 02000000 03000000 00000000 01000000 03000000 03000000") + b"abc"
    )


@pytest.mark.parametrize("column", [pa.array([5.0, 6.0]), pa.array([1, None, 3], pa.int32()), pa.array([True, False, None]), pa.array([], pa.int64())])
def test_column_files(tmp_path, column):
    path = str(tmp_path / "c.col")
    columnfile.write(path, column)
    assert columnfile.read(path).equals(column)
    raw = open(path, "rb").read()
    for broken in (raw[:20], b"X" + raw[1:], raw[:8] + b"\x09" + raw[9:], raw[:16] + b"\x04" + raw[17:], raw[:12] + b"\x63" + raw[13:], *([raw[:-1]] if len(column) else [])):
        open(path, "wb").write(broken)
        with pytest.raises(FormatError):
            columnfile.read(path)


def test_text_has_no_column_file(tmp_path):
    with pytest.raises(FormatError):
        columnfile.write(str(tmp_path / "c.col"), pa.array(["a"]))


def test_formats_in_spark(spark, tmp_path):
    spark_formats.register(spark)
    df = spark.createDataFrame([(i, f"n{i}" if i % 3 else None, i / 2) for i in range(50)], "x int, s string, f double").repartition(3)
    folder = str(tmp_path / "b")
    for mode, n in (("append", 50), ("append", 100), ("overwrite", 50)):
        df.write.format("plinth_batch").mode(mode).save(folder)
        assert spark.read.format("plinth_batch").schema(df.schema).load(folder).count() == n
    assert sorted(map(tuple, spark.read.format("plinth_batch").schema(df.schema).load(folder).collect())) == sorted(map(tuple, df.collect()))
    # Large partitions become several files, in the order of their rows.
    long = spark.range(30_000, numPartitions=2)
    long.write.format("plinth_batch").mode("overwrite").option("fileBytes", 40_000).save(folder)
    assert len(os.listdir(folder)) > 3
    assert [r[0] for r in spark.read.format("plinth_batch").schema(long.schema).load(folder).collect()] == list(range(30_000))
    columns = tmp_path / "c"
    columns.mkdir()
    columnfile.write(str(columns / "x.col"), pa.array(np.arange(4, dtype=np.int32)))
    columnfile.write(str(columns / "y.col"), pa.array([0.5, None, 1.5, 2.5]))
    assert [tuple(r) for r in spark.read.format("plinth_column").schema("x int, y double").load(str(columns)).collect()] == [(0, 0.5), (1, None), (2, 1.5), (3, 2.5)]


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")
    df.write.csv(str(tmp_path / "csv"), header=True)
    df.coalesce(1).write.parquet(str(tmp_path / "parquet"))
    e = Engine(spark)
    e.register_parquet("p", str(tmp_path / "parquet"))
    e.register_csv("c", str(tmp_path / "csv"), e.catalog["p"].schema)
    assert sorted(map(tuple, e.sql("SELECT c.s, p.x FROM c INNER JOIN p ON c.x = p.x").collect())) == [("a", 1), ("b", 2)]
    assert "PushedFilters: [IsNotNull(x), EqualTo(x,1)]" in e.explain("SELECT s FROM p WHERE x = 1")


def test_a_stored_table_as_a_stream(spark, tmp_path):
    e = Engine.open(spark, str(tmp_path / "db"))
    table = e.create_table("t", [("k", ColumnType.INT32), ("v", ColumnType.INT64)], [(1, 10), (2, 20)])
    grouped = apply(GroupPlan(table.id, Grouping((0,), (Aggregate("SUM", 1), Aggregate("COUNT")))), e.store)
    swapped = apply(GroupPlan(table.id, Grouping((0,), (Aggregate("SUM", 1),), (("aggregate", 0), ("key", 0))), options=Options(wrap_overflow=True)), e.store)
    assert grouped.columns == ["k", "sum_v", "count_star"] and swapped.columns == ["sum_v", "k"]
    assert apply(ScanPlan(table.id, (1, 1)), e.store).columns == ["v", "v_2"]
    for bad in (ScanPlan(table.id, (9,)), GroupPlan(table.id, Grouping((0,), (Aggregate("MIN", 1),)))):
        with pytest.raises(SqlCompileError):
            apply(bad, e.store)
    rows = apply(ScanPlan(table.id, (1,), (Filter(0, "=", 1),)), e.store)
    queries = [grouped.writeStream.outputMode("complete").format("memory").queryName("grouped").start(), rows.writeStream.format("memory").queryName("rows").start()]
    try:
        for q in queries:
            q.processAllAvailable()
        table.append([(1, 5)])
        for q in queries:
            q.processAllAvailable()
        assert sorted(map(tuple, spark.table("grouped").collect())) == [(1, 15, 2), (2, 20, 1)]
        assert sorted(r[0] for r in spark.table("rows").collect()) == [5, 10]
    finally:
        for q in queries:
            q.stop()
    with pytest.raises(SqlCompileError):
        apply(ScanPlan(table.id, (), (), Aggregate("COUNT")), e.store)
