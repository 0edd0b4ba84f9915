"""Random statements of the subset against DuckDB, with nulls everywhere; hash against merge joins."""

import math
import random

import duckdb
import pytest

from plinth import ColumnType, Engine

KINDS = {"i": (ColumnType.INT32, "INTEGER"), "l": (ColumnType.INT64, "BIGINT"), "f": (ColumnType.FLOAT64, "DOUBLE"), "b": (ColumnType.BOOLEAN, "BOOLEAN"), "s": (ColumnType.UTF8, "VARCHAR")}
VALUES = {"i": [-2, 0, 1, 2, 3], "l": [-5, 0, 1, 2**40], "f": [-1.5, 0.5, 2.0, 3.25], "b": [True, False], "s": ["", "a", "b", "it's", "é"]}


def shown(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    engine, db = Engine(spark), duckdb.connect()
    for name in ("t", "u"):
        rows = [tuple(None if rng.random() < 0.2 else rng.choice(VALUES[k]) for k in KINDS) for _ in range(40)]
        table = engine.create_table(name, [(f"{name}{k}", kind) for k, (kind, _) in KINDS.items()], rows[:25])
        table.append(rows[25:])
        db.execute(f"CREATE TABLE {name} ({', '.join(f'{name}{k} {sql}' for k, (_, sql) in KINDS.items())})")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?, ?)", rows)
    return engine, db


def where(rng, names):
    out = []
    for _ in range(rng.randint(0, 2)):
        n = rng.choice(names)
        sign = rng.choice(["=", "<>", "!="] if n[1] == "s" else ["=", "<>", "<", "<=", ">", ">="])
        out.append(f"{n} {sign} {shown(rng.choice(VALUES[n[1]]))}")
    return " WHERE " + " AND ".join(out) if out else ""


def statement(rng):
    """Strict SQL, DuckDB's SQL, whether rows are in order."""
    join = rng.random() < 0.35
    names = [f"t{k}" for k in KINDS] + ([f"u{k}" for k in KINDS] if join else [])
    tail = "t"
    if join:
        keys = rng.sample(list(KINDS), rng.randint(1, 2))
        tail = "t INNER JOIN u ON " + " AND ".join(f"t.t{k} = u.u{k}" for k in keys)
    tail += where(rng, names)
    q = lambda n: f"{n[0]}.{n}"
    calls = lambda: [rng.choice([f"COUNT({n})", *([f"SUM({n})"] if n[1] in "ilf" else []), *([f"MIN({n})", f"MAX({n})"] if n[1] == "f" else [])]) for n in rng.sample(names, 2)] + ["COUNT(*)"]
    way = rng.random()
    if way < 0.4:
        keys = rng.sample(names, rng.randint(1, 2))
        items = [q(k) for k in keys] + rng.sample(calls(), rng.randint(1, 3))
        rng.shuffle(items)
        sql = f"SELECT {', '.join(items)} FROM {tail} GROUP BY {', '.join(map(q, keys))}"
        return sql, sql, False
    if way < 0.6 and not join:
        sql = f"SELECT {rng.choice(calls())} FROM {tail}"
        return sql, sql, False
    items = rng.sample(names, rng.randint(1, 4))
    sql = f"SELECT {', '.join(map(q, items))} FROM {tail}"
    if way < 0.8:
        ways = [(q(n), rng.random() < 0.5) for n in items]
        order = lambda spell: " ORDER BY " + ", ".join(spell(n, d) for n, d in ways)
        # Sorted by all columns, equal rows are the same whatever their order.
        limit = f" LIMIT {rng.randint(1, 30)}" if rng.random() < 0.5 else ""
        return sql + order(lambda n, d: n + (" DESC" if d else "")) + limit, sql + order(lambda n, d: f"{n} DESC NULLS LAST" if d else f"{n} NULLS FIRST") + limit, True
    return sql, sql, False


def cell(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) and not (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("seed", range(60))
def test_as_duckdb(world, seed):
    engine, db = world
    sql, other, ordered = statement(random.Random(seed))
    found = [tuple(map(cell, r)) for r in engine.execute_sql(sql).rows()]
    expected = [tuple(map(cell, r)) for r in db.execute(other).fetchall()]
    assert (found if ordered else sorted(found, key=repr)) == (expected if ordered else sorted(expected, key=repr)), sql
    if "JOIN" in sql and not ordered:
        ways = [sorted((tuple(map(cell, r)) for r in engine.execute_sql(sql, algorithm=a).rows()), key=repr) for a in ("hash", "merge")]
        assert ways[0] == ways[1] == sorted(expected, key=repr)
