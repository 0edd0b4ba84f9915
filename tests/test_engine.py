"""Results, null and NaN rules, orders and rejections over small tables."""

import math
import operator
import random
import time

import pytest
from pyspark import InheritableThread

from plinth import CatalogError, ColumnType, Engine, Schema, SqlCompileError
from plinth.operators.lower import lower
from plinth.plans.binder import compile_sql
from plinth.plans.physical import HASH, MERGE, Aggregate, Filter, Grouping, GroupPlan, JoinPlan, NotePlan, Options, ScanPlan, SortPlan

I32, I64, F64, BOOL, UTF8 = ColumnType.INT32, ColumnType.INT64, ColumnType.FLOAT64, ColumnType.BOOLEAN, ColumnType.UTF8
NAN = float("nan")


def make(spark, **tables):
    """name=(columns, batch, batch, ...)"""
    e = Engine(spark)
    for name, (columns, *batches) in tables.items():
        table = e.create_table(name, columns)
        for b in batches:
            table.append(b)
    return e


def rows(e, sql, **more):
    return [tuple(r) for r in e.execute_sql(sql, **more).rows()]


def cells(seed, n, *kinds):
    """n rows of random cells, a few of them null: numbers below 8, halves of such, short texts."""
    rng = random.Random(seed)
    pick = {I32: lambda: rng.randrange(8), I64: lambda: rng.randrange(8) << 33, F64: lambda: rng.randrange(16) / 2, UTF8: lambda: rng.choice("pqrs") * rng.randint(1, 2)}
    return [tuple(None if rng.random() < 0.15 else pick[k]() for k in kinds) for _ in range(n)]


#: Weather stations, and what they measured.
STATIONS = ([("code", I32), ("height", F64), ("kind", UTF8)], cells(1, 30, I32, F64, UTF8))
COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@pytest.mark.parametrize("sign", COMPARE)
def test_filters_and_projections_as_in_python(spark, sign):
    columns, data = STATIONS
    e, test = make(spark, stations=(columns, data[:11], data[11:])), COMPARE[sign]
    found = rows(e, f"SELECT height, code FROM stations WHERE code {sign} 4")
    assert sorted(found, key=repr) == sorted([(h, c) for c, h, _ in data if c is not None and test(c, 4)], key=repr)
    found = rows(e, f"SELECT STATIONS.Kind FROM Stations WHERE height {sign} 3.5 AND code < 6")
    assert sorted(found, key=repr) == sorted([(k,) for c, h, k in data if None not in (c, h) and test(h, 3.5) and c < 6], key=repr)
    if sign in ("=", "<>"):
        assert len(rows(e, f"SELECT code FROM stations WHERE kind {sign} 'pp'")) == sum(k is not None and test(k, "pp") for *_, k in data)


def test_names_of_repeated_columns(spark):
    e = make(spark, stations=STATIONS)
    assert e.sql("SELECT kind, code, kind, kind FROM stations").columns == ["kind", "code", "kind_2", "kind_3"]


def test_scans_keep_row_order_where_asked(spark):
    e = make(spark, t=([("x", I32)], [(3,), (1,)], [], [(2,), (0,)]))
    e._context.ordered = "all"
    assert rows(e, "SELECT x FROM t") == [(3,), (1,), (2,), (0,)]
    assert rows(e, "SELECT x FROM t LIMIT 3") == [(3,), (1,), (2,)]
    assert rows(e, "SELECT x FROM t WHERE x < 3 LIMIT 2") == [(1,), (2,)]
    with e.execute_sql("SELECT x FROM t", options=Options(parallelism=8)) as r:
        assert [x[0] for x in r.rows()] == [3, 1, 2, 0] and r.row_count() == 4


def test_global_aggregates(spark):
    e = make(spark, t=([("amt", F64), ("n", I32), ("s", UTF8)], [(1.0, 1, "a"), (2.0, None, None)], [(3.0, 3, "b"), (4.0, 4, "b")]), empty=([("x", F64)],), nulls=([("x", F64)], [(None,), (None,)]))
    result = e.execute_sql("SELECT SUM(amt) FROM t")
    assert result.is_aggregate and result.value() == 10.0 and result.contributing_rows() == 4 and result.row_count() == 1
    assert rows(e, "SELECT SUM(n) FROM t") == [(8,)] and dict(e.sql("SELECT SUM(n) FROM t").dtypes) == {"sum_n": "bigint"}
    assert rows(e, "SELECT COUNT(n) FROM t") == [(3,)] and rows(e, "SELECT COUNT(s) FROM t WHERE amt > 1.5") == [(2,)]
    assert rows(e, "SELECT MIN(amt) FROM t") == [(1.0,)] and rows(e, "SELECT MAX(amt) FROM t WHERE s = 'a'") == [(1.0,)]
    for name in ("empty", "nulls"):
        for f in ("SUM", "MIN", "MAX"):
            r = e.execute_sql(f"SELECT {f}(x) FROM {name}")
            assert r.value() is None and r.contributing_rows() == 0
    assert rows(e, "SELECT COUNT(*) FROM empty") == [(0,)] and rows(e, "SELECT COUNT(*) FROM nulls") == [(2,)] and rows(e, "SELECT COUNT(x) FROM nulls") == [(0,)]


def test_groups_come_in_order_with_nulls_last(spark):
    e = make(spark, t=([("k", I32), ("g", UTF8), ("x", F64)], [(2, None, 3.0), (None, None, None)], [(None, "a", None), (1, "a", 1.0)]), d=([("k", F64), ("n", I32)], [(0.0, 3), (-2.0, 1), (-1.0, 2)]))
    assert rows(e, "SELECT k, g, SUM(x) FROM t GROUP BY k, g") == [(1, "a", 1.0), (None, "a", None), (2, None, 3.0), (None, None, None)]
    assert rows(e, "SELECT COUNT(*), k FROM t GROUP BY k") == [(1, 1), (1, 2), (2, None)]
    assert rows(e, "SELECT k, COUNT(n) FROM d GROUP BY k") == [(-2.0, 1), (-1.0, 1), (0.0, 1)]
    assert rows(e, "SELECT SUM(x), g, g FROM t WHERE x > 0 GROUP BY g") == [(1.0, "a", "a"), (3.0, None, None)]
    assert rows(e, "SELECT k, SUM(x) FROM t WHERE x > 99 GROUP BY k") == []


def test_group_of_an_empty_table_keeps_its_columns(spark):
    e = make(spark, t=([("k", I32), ("v", I64)],))
    assert e.sql("SELECT k, SUM(v) FROM t GROUP BY k").columns == ["k", "sum_v"] and rows(e, "SELECT k, SUM(v) FROM t GROUP BY k") == []


@pytest.mark.parametrize("sign, found", [("=", [True]), ("<>", [False]), ("<", [False]), ("<=", [False, True]), (">", []), (">=", [True])])
def test_booleans(spark, sign, found):
    e = make(spark, t=([("b", BOOL)], [(True,), (False,), (None,)]))
    assert sorted(r[0] for r in rows(e, f"SELECT b FROM t WHERE b {sign} TRUE")) == found


def test_null_cells_compare_with_nothing(spark):
    e = make(spark, t=([("x", I32), ("s", UTF8)], [(7, "wet"), (None, None), (9, "dry")]))
    assert rows(e, "SELECT x FROM t WHERE x <> 7") == [(9,)] and rows(e, "SELECT x FROM t WHERE s != 'wet'") == [(9,)]


def test_nan_and_zero(spark):
    e = make(spark, t=([("x", F64)], [(1.0,), (NAN,), (None,), (-0.0,), (0.0,)]))
    assert rows(e, "SELECT x FROM t WHERE x > 0.5") == [(1.0,)] and rows(e, "SELECT x FROM t WHERE x >= 1") == [(1.0,)]
    assert len(rows(e, "SELECT x FROM t WHERE x <> 1")) == 3 and len(rows(e, "SELECT x FROM t WHERE x <= 0")) == 2
    shown = lambda found: [None if x is None else "nan" if math.isnan(x) else x + 0.0 for (x,) in found]
    assert shown(rows(e, "SELECT x FROM t ORDER BY x")) == [None, 0.0, 0.0, 1.0, "nan"]
    assert shown(rows(e, "SELECT x FROM t ORDER BY x", options=Options(nan_first=True))) == [None, "nan", 0.0, 0.0, 1.0]
    assert shown(rows(e, "SELECT x FROM t ORDER BY x DESC", options=Options(nan_first=True))) == [1.0, 0.0, 0.0, "nan", None]
    assert len(rows(e, "SELECT x, COUNT(*) FROM t GROUP BY x")) == 4  # -0.0 and 0.0 are one group
    assert math.isnan(e.execute_sql("SELECT MAX(x) FROM t").value()) and e.execute_sql("SELECT MIN(x) FROM t").value() == 0.0


def test_integer_sums_fail_or_wrap(spark):
    e = make(spark, t=([("v", I64)], [(2**63 - 1,), (1,)]))
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        rows(e, "SELECT SUM(v) FROM t")
    assert rows(e, "SELECT SUM(v) FROM t", options=Options(wrap_overflow=True)) == [(-(2**63),)]


def test_order_and_limit(spark):
    e = make(spark, t=([("k", I32), ("s", UTF8)], [(2, "b"), (None, "c"), (1, None), (1, "a")]))
    assert rows(e, "SELECT k, s FROM t ORDER BY k, s DESC") == [(None, "c"), (1, "a"), (1, None), (2, "b")]
    assert rows(e, "SELECT s FROM t ORDER BY k DESC, s LIMIT 2") == [("b",), (None,)]
    assert [r[0] for r in rows(make(spark, t=([("s", UTF8)], [("z",), ("é",), ("",), ("Z",), ("😀",)])), "SELECT s FROM t ORDER BY s")] == ["", "Z", "z", "é", "😀"]


FLEET = ([("hull", I32), ("flag", UTF8), ("decks", I32)], cells(2, 25, I32, UTF8, I32))
CALLS = ([("vessel", I32), ("ensign", UTF8), ("cargo", I64)], cells(3, 40, I32, UTF8, I64))


def nested(*keys):
    """The join of the fleet and its calls by the given pairs of columns, the fleet's rows first in order, as in Python."""
    return [a + b for a in FLEET[1] for b in CALLS[1] if all(a[i] is not None and a[i] == b[j] for i, j in keys)]


@pytest.mark.parametrize("algorithm", ["auto", HASH, MERGE])
def test_joins_as_in_python(spark, algorithm):
    e = make(spark, fleet=FLEET, calls=CALLS)
    run = lambda sql: sorted(rows(e, sql, algorithm=algorithm), key=repr)
    same = lambda sql, expected: run(sql) == sorted(expected, key=repr)
    by_hull, by_both = nested((0, 0)), nested((0, 0), (1, 1))
    assert same("SELECT * FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel", by_hull)
    assert same("SELECT cargo, decks FROM fleet INNER JOIN calls ON calls.ensign = fleet.flag AND fleet.hull = calls.vessel", [(r[5], r[2]) for r in by_both])
    assert same("SELECT calls.cargo FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel WHERE decks >= 3 AND calls.ensign <> 'q'", [(r[5],) for r in by_hull if (r[2] or 0) >= 3 and r[4] not in (None, "q")])
    sums = {}
    for r in nested((1, 1)):
        n, total = sums.get(r[1], (0, None))
        sums[r[1]] = (n + 1, total if r[5] is None else (total or 0) + r[5])
    assert same("SELECT COUNT(*), fleet.flag, SUM(calls.cargo) FROM fleet INNER JOIN calls ON fleet.flag = calls.ensign GROUP BY fleet.flag", [(n, k, t) for k, (n, t) in sums.items()])
    sql = "SELECT fleet.decks, calls.cargo FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel"
    assert rows(e, f"{sql} LIMIT 9", algorithm=algorithm) == [(r[2], r[5]) for r in by_hull[:9]]
    ordered = sorted(by_hull, key=lambda r: (-1 if r[5] is None else r[5], -(-1 if r[2] is None else r[2])))
    assert rows(e, f"{sql} ORDER BY calls.cargo, fleet.decks DESC LIMIT 12", algorithm=algorithm) == [(r[2], r[5]) for r in ordered[:12]]
    assert e.sql("SELECT * FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel").columns == ["fleet_hull", "fleet_flag", "fleet_decks", "calls_vessel", "calls_ensign", "calls_cargo"]


def test_order_of_joins_where_asked(spark):
    e = make(spark, fleet=(FLEET[0], FLEET[1][:9], FLEET[1][9:]), calls=CALLS)
    e._context.ordered = "all"
    sql = "SELECT * FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel"
    assert rows(e, sql) == rows(e, sql, algorithm=HASH) == nested((0, 0))
    assert rows(e, sql, algorithm=MERGE) == sorted(nested((0, 0)), key=lambda r: r[0])
    assert rows(e, sql, options=Options(parallelism=1)) == nested((0, 0))


def test_join_hints_reach_the_plan(spark):
    e = make(spark, fleet=FLEET, calls=CALLS)
    plan = lambda a: e.sql("SELECT hull FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel", algorithm=a)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan(HASH) and "BuildRight" in plan(HASH) and "SortMergeJoin" in plan(MERGE)


JOIN = "FROM fleet INNER JOIN calls ON fleet.hull = calls.vessel"
BAD = [
    # Names that are nowhere, in another table, or not one table's.
    "SELECT hull FROM harbour", "SELECT keel FROM fleet", "SELECT calls.vessel FROM fleet", "SELECT hull FROM fleet WHERE calls.vessel = 3", "SELECT SUM(harbour.decks) FROM fleet", f"SELECT twin.hull {JOIN}",
    # Literals and comparisons that a column doesn't take.
    "SELECT hull FROM fleet WHERE flag >= 'p'", "SELECT hull FROM fleet WHERE hull < 2.5", "SELECT hull FROM fleet WHERE decks = 'three'", "SELECT hull FROM fleet WHERE hull <> FALSE", "SELECT hull FROM fleet WHERE hull > -2147483649", "SELECT hull FROM fleet WHERE flag = 7",
    # Aggregates of types that they don't take, and columns beside them that aren't grouped.
    "SELECT SUM(flag) FROM fleet", "SELECT MIN(decks) FROM fleet", "SELECT MAX(cargo) FROM calls", "SELECT decks, SUM(hull) FROM fleet GROUP BY flag", f"SELECT calls.ensign, SUM(calls.cargo) {JOIN} GROUP BY fleet.flag",
    # Joins: of keys of two types, with a table itself, with equal names in the output, ordered by what isn't put out.
    "SELECT hull FROM fleet INNER JOIN calls ON fleet.hull = calls.cargo", "SELECT fleet.hull FROM fleet INNER JOIN fleet ON fleet.hull = fleet.decks", f"SELECT fleet.flag, fleet.flag {JOIN}", f"SELECT hull {JOIN} ORDER BY fleet.decks",
    f"SELECT ensign, SUM(cargo) {JOIN} GROUP BY calls.ensign", f"SELECT calls.ensign, SUM(cargo) {JOIN} GROUP BY ensign", f"SELECT fleet.hull {JOIN} ORDER BY hull",
]


@pytest.mark.parametrize("sql", BAD)
def test_rejected_by_the_catalog(spark, sql):
    with pytest.raises(SqlCompileError):
        make(spark, fleet=FLEET, calls=CALLS).compile(sql)


@pytest.mark.parametrize("sql", ["SELECT code FROM a INNER JOIN b ON a.code = b.code", "SELECT a.n FROM a INNER JOIN b ON a.code = b.code WHERE code = 1"])
def test_names_of_both_tables_need_one(spark, sql):
    with pytest.raises(SqlCompileError, match="ambiguous"):
        make(spark, a=([("code", I32), ("n", I32)],), b=([("code", I32)],)).compile(sql)


def test_opaque_columns(spark):
    e = Engine(spark)
    e.register("t", spark.sql("SELECT 1L AS id, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS at, array(1, 2) AS v"))
    assert rows(e, "SELECT COUNT(v) FROM t") == [(1,)] and len(rows(e, "SELECT * FROM t")[0]) == 3
    for sql in ("SELECT id FROM t WHERE at = 'x'", "SELECT id FROM t ORDER BY at", "SELECT v, COUNT(*) FROM t GROUP BY v", "SELECT SUM(v) FROM t"):
        with pytest.raises(SqlCompileError):
            e.compile(sql)


def test_plans_by_hand(spark):
    e = make(spark, fleet=FLEET, calls=CALLS)
    left, right = e.catalog["Fleet"].id, e.catalog["calls"].id
    fleet, calls = FLEET[1], CALLS[1]
    same = lambda p, expected: sorted((tuple(r) for r in e.execute_plan(p).rows()), key=repr) == sorted(expected, key=repr)
    assert same(ScanPlan(left, (2, 0), (Filter(0, "=", 5),)), [(d, h) for h, _, d in fleet if h == 5])
    assert same(ScanPlan(left, (0, 1), (), Aggregate("COUNT")), [(len(fleet),)])
    assert same(GroupPlan(right, Grouping((1,), (Aggregate("COUNT", 2),))), [(k, sum(x[1] == k and x[2] is not None for x in calls)) for k in {x[1] for x in calls}])
    assert same(SortPlan(right, (2,), ((2, True),), 4), [(c,) for c in sorted((x[2] for x in calls if x[2] is not None), reverse=True)[:4]])
    for algorithm in (HASH, MERGE):
        assert same(JoinPlan(left, right, (0,), (0,), ((0, 2), (1, 2)), algorithm=algorithm), [(r[2], r[5]) for r in nested((0, 0))])
    assert same(NotePlan("nothing"), []) and e.execute_plan(object()).row_count() == 0
    for bad in (lambda: ScanPlan(left, ()), lambda: SortPlan(left, (0,)), lambda: SortPlan(left, (0,), (), 0), lambda: Grouping((), (Aggregate("COUNT"),)), lambda: Grouping((0,), ()), lambda: Grouping(tuple(range(33)), (Aggregate("COUNT"),)),
                lambda: Grouping((0,), (Aggregate("COUNT"),), (("key", 1),)), lambda: JoinPlan(left, right, (0,), ()), lambda: JoinPlan(left, right, (0,), (0,), algorithm="loop"), lambda: Aggregate("SUM"), lambda: Aggregate("AVG", 0), lambda: Filter(0, "~", 1)):
        with pytest.raises(SqlCompileError):
            bad()
    for bad in (ScanPlan(left, (9,)), ScanPlan(left, (0,), (Filter(1, "<", "a"),)), GroupPlan(left, Grouping((0,), (Aggregate("MIN", 0),))), JoinPlan(left, right, (0,), (2,))):
        with pytest.raises(SqlCompileError):
            e.execute_plan(bad)


def test_compiled_plans(spark):
    e = make(spark, fleet=FLEET, calls=CALLS)
    kinds = {"SELECT decks FROM fleet": "Scan", "SELECT COUNT(flag) FROM fleet": "Scan", "SELECT flag, COUNT(*) FROM fleet GROUP BY flag": "Group", "SELECT flag FROM fleet LIMIT 3": "Sort", f"SELECT * {JOIN}": "Join", f"SELECT * {JOIN} LIMIT 2": "Sort", f"SELECT SUM(calls.cargo), fleet.flag {JOIN} GROUP BY fleet.flag": "Group"}
    for sql, kind in kinds.items():
        assert e.compile(sql).explain().startswith(kind)
    assert "Scan" in e.explain("SELECT hull FROM fleet") and "== Physical Plan ==" in e.explain("SELECT hull FROM fleet")


def test_other_compilers_and_executors(spark):
    said = []

    def compiler(sql, catalog, options, algorithm):
        said.append((sql, algorithm))
        return compile_sql(sql.replace("PICK", "SELECT"), catalog, options, algorithm)

    def executor(plan, context):
        said.append(plan.explain())
        return lower(plan, context)

    e = Engine(spark, compiler=compiler, executor=executor)
    e.create_table("t", [("x", I32)], [(4,), (6,)])
    assert rows(e, "PICK x FROM t WHERE x > 5") == [(6,)]
    assert said[0] == ("PICK x FROM t WHERE x > 5", "auto") and said[1].startswith("Scan")


def test_limits_read_few_files(spark, tmp_path):
    spark.range(2000, numPartitions=40).selectExpr("id", "id % 100 AS part").write.parquet(str(tmp_path / "p"))
    e = Engine(spark)
    e.register_parquet("p", str(tmp_path / "p"))
    e.create_table("k", [("id", I64)], [(i,) for i in range(0, 2000, 3)])
    every = [r[0] for r in e.sql("SELECT id FROM p").orderBy("id").collect()]
    for sql, found, most in (
        ("SELECT id FROM p LIMIT 7", list(range(7)), 1), ("SELECT id FROM p LIMIT 120", list(range(120)), 4), ("SELECT id FROM p WHERE part = 7 LIMIT 3", [7, 107, 207], 16), ("SELECT id FROM p WHERE part > 100 LIMIT 3", [], 40),
        ("SELECT p.id FROM p INNER JOIN k ON p.id = k.id LIMIT 4", [0, 3, 6, 9], 1), ("SELECT id FROM p LIMIT 5000", every, 40),
    ):
        df = e.sql(sql)
        assert [r[0] for r in df.collect()] == found and len(df.inputFiles()) <= most
    # Values in folders' names are no matter for single files.
    spark.range(60).selectExpr("id", "CAST(id % 3 AS INT) AS third").write.partitionBy("third").parquet(str(tmp_path / "q"))
    e.register_parquet("q", str(tmp_path / "q"))
    assert len(e.sql("SELECT id, third FROM q LIMIT 50").collect()) == 50


def test_spill_hook(spark):
    told = []
    e = make(spark, t=([("k", I32), ("v", I64)], [(1, 1), (2, 1), (3, 1)], [(1, 1)]))
    e._context.spill_hook = told.append
    sql = "SELECT k, SUM(v) FROM t GROUP BY k"
    expected = rows(e, sql)
    assert told == [] and rows(e, sql, options=Options(spill_threshold=2)) == expected
    assert told == ['{"op": "hash_agg_partial", "batch": 0, "entries": 3}']
    e.create_table("u", [("j", I32), ("g", UTF8)], [(1, "a"), (2, "b"), (9, "c")])
    assert len(rows(e, "SELECT u.g, COUNT(*) FROM t INNER JOIN u ON t.k = u.j GROUP BY u.g", options=Options(spill_threshold=2))) == 2
    assert told[1:] == ['{"op": "hash_agg_partial_utf8", "batch": 0, "entries": 2}']


def test_results_close(spark):
    r = make(spark, stations=STATIONS).execute_sql("SELECT height FROM stations")
    r.close()
    r.close()
    with pytest.raises(RuntimeError):
        r.rows()


def test_catalog_and_tables(spark):
    e = make(spark, t=([("x", I32)], [(1,)]))
    with pytest.raises(CatalogError):
        e.create_table("T", [("x", I32)])
    table = e.catalog["T"]
    assert e.catalog.get(table.id) is table and "nosuch" not in e.catalog and e.catalog.names() == ["t"] and table.row_count() == 1
    for bad in ([(1, 2)], [("a",)], spark.sql("SELECT 1L AS x"), spark.sql("SELECT 1 AS y")):
        with pytest.raises(CatalogError):
            table.append(bad)
    assert table.row_count() == 1
    for columns in ([], [("a", I32), ("A", I64)]):
        with pytest.raises(CatalogError):
            Schema(columns)
    seen = []
    table.on_version(lambda t, v: seen.append(v))
    assert table.bump_version() == 2 and seen == [2]
    strict = e.create_table("s", [("x", I64)], strict=True)
    strict.append([])
    strict.append(spark.range(65536).withColumnRenamed("id", "x"))
    with pytest.raises(CatalogError):
        strict.append(spark.range(10).withColumnRenamed("id", "x"))
    assert strict.row_count() == 65536


def test_jobs_can_be_stopped(spark):
    e, ended = Engine(spark), []
    e.register("endless", spark.range(1 << 50, numPartitions=8).selectExpr("id"))

    def run():
        try:
            with e.session("mine"):
                ended.append(e.execute_sql("SELECT COUNT(*) FROM endless WHERE id <> 5").value())
        except Exception as error:
            ended.append(error)

    tracker, began = spark.sparkContext.statusTracker(), time.monotonic()
    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    try:
        while not tracker.getActiveStageIds() and time.monotonic() - began < 30:
            time.sleep(0.05)
        e.cancel("other")
        thread.join(1)
        assert thread.is_alive() and not ended
        e.cancel("mine")
        thread.join(30)
        assert not thread.is_alive() and "cancel" in str(ended[0]).lower()
        assert "mine" not in spark.sparkContext.getJobTags()
    finally:
        spark.sparkContext.cancelAllJobs()


def test_a_million_rows(spark):
    e = Engine(spark)
    e.register("hits", spark.range(1 << 20).selectExpr("CAST(id * 7919 % 1000 AS INT) AS code", "id"))
    assert e.execute_sql("SELECT COUNT(*) FROM hits WHERE code < 37 AND id >= 1000").value() == sum(i * 7919 % 1000 < 37 for i in range(1000, 1 << 20))


def test_statements_by_calls(spark):
    e = make(spark, fleet=FLEET, calls=CALLS)
    plan = lambda q, sql: q.compile() == e.compile(sql)
    assert plan(e.table("fleet").where("decks", ">=", 4).select("hull", "fleet.flag").order_by("hull", descending=True).limit(2), "SELECT hull, fleet.flag FROM fleet WHERE decks >= 4 ORDER BY hull DESC LIMIT 2")
    assert plan(e.table("calls").group_by("ensign").aggregate(("sum", "cargo"), "ensign", ("COUNT", None)), "SELECT SUM(cargo), ensign, COUNT(*) FROM calls GROUP BY ensign")
    assert plan(e.table("fleet").where("flag", "=", "it's"), "SELECT * FROM fleet WHERE flag = 'it''s'")
    joined = e.table("fleet").join("calls", ("hull", "vessel"), ("flag", "ensign")).select("fleet.decks", "calls.cargo")
    assert sorted(map(tuple, joined.run(algorithm=MERGE).rows()), key=repr) == sorted([(r[2], r[5]) for r in nested((0, 0), (1, 1))], key=repr)
    assert e.table("fleet").aggregate(("COUNT", None)).run(options=Options(scheduler="channel")).value() == len(FLEET[1]) == len(e.table("fleet").run().rows())
    q = e.table("fleet")
    for bad in (lambda: q.where("hull", "~", 1), lambda: q.where("hull", "=", None), lambda: q.where("hull", "=", "x").run(), lambda: q.aggregate(("SUM", None)), lambda: q.aggregate(("AVG", "hull")), lambda: q.select("nosuch").run(), lambda: q.join("calls"), lambda: q.limit(0).run(),
                lambda: q.aggregate("hull", ("COUNT", None)).run(), lambda: q.group_by("hull").run(), lambda: q.join("calls", ("hull", "vessel")).aggregate(("COUNT", None)).run(), lambda: e.table("nosuch").run(), lambda: Options(scheduler="x")):
        with pytest.raises(SqlCompileError):
            bad()
