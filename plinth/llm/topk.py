"""Exact top-k inner products over a bit-sliced index.

Components are quantised to floor(scale * x).  A block of rows keeps, for every
component, one bitmap per bit of (value - least value of the block).  A query is
scored against all rows of a block at once: for groups of eight components the
sums of all 256 subsets are themselves bit-sliced, so each bit of the query's
components picks one subset sum per group; these are added by carry-save adders,
64 rows to a machine word and many queries to an operation.  The best rows are
then taken from the most significant slice of the sums downward, and rows equal in
all slices at the boundary are resolved by the smaller id.

The index holds rows whose components leave room for every sum in a long.  Rows
with a larger component are few in sound data; they are kept as they came, meet
all queries with whole integers of any size, and so do queries of that kind.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import cut, partitions

#: Rows in a block of the index, and queries that meet a block together.
BLOCK, QUERIES = 8192, 2048
#: Components added up in one table of subset sums, and bytes of one group of running slices.
GROUP, WORKING = 8, 1 << 18
#: Pairs of rows that are scored at once with whole integers.
PAIRS = 1 << 16
#: The scores that a long takes; one beyond counts as the nearest of these.
LEAST, MOST = -(1 << 63), (1 << 63) - 1

Slices = list[np.ndarray]


def _add(a: Slices, b: Slices) -> Slices:
    """The bit slices of a + b, by a ripple of carries."""
    out, carry = [], None
    for x, y in itertools.zip_longest(a, b):
        terms = [t for t in (x, y, carry) if t is not None]
        if len(terms) == 1:
            out.append(terms[0])
            carry = None
        elif len(terms) == 2:
            out.append(terms[0] ^ terms[1])
            carry = terms[0] & terms[1]
        else:
            half = x ^ y
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
    return [*out, carry] if carry is not None and carry.any() else out


def _total(columns: list[list[np.ndarray]]) -> Slices:
    """Sum of bitmaps by weight (columns[i]: those of weight 2**i); full adders turn three into a sum and a carry."""
    out: Slices = []
    i = 0
    while i < len(columns):
        column = columns[i]
        while len(column) > 1:
            if i + 1 == len(columns):
                columns.append([])
            if len(column) == 2:
                x, y = column.pop(), column.pop()
                columns[i + 1].append(x & y)
                column.append(x ^ y)
            else:
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                columns[i + 1].append((x & y) | (half & z))
                column.insert(0, half ^ z)
        out.append(column[0] if column else np.zeros(1, np.uint64))
        i += 1
    return out


class Block:
    """The index of up to BLOCK rows: `values` (rows, components) as bit slices."""

    def __init__(self, values: np.ndarray):
        self.rows, self.width = values.shape
        self.words = -(-self.rows // 64)
        self.least = values.min(axis=0)
        shifted = np.zeros((self.words * 64, self.width), np.uint64)
        shifted[: self.rows] = (values - self.least).astype(np.uint64)
        bits = max(1, int(shifted.max()).bit_length())
        packed = np.packbits(((shifted[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        self.slices = np.ascontiguousarray(np.moveaxis(packed, 0, 2)).view(np.uint64)  # component, bit, words
        self.there = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64)
        self.sums: Slices = []
        for d in range(self.width):
            self.sums = _add(self.sums, list(self.slices[d]))
        self.tables = [self._subsets(range(d, min(d + GROUP, self.width))) for d in range(0, self.width, GROUP)]

    def _subsets(self, group: range) -> np.ndarray:
        """(slices, 2 ** len(group), words): sums of all subsets of some components."""
        table: Slices = [np.zeros((1, self.words), np.uint64)]
        for d in group:
            more = _add(table, [s[None, :] for s in self.slices[d]])
            table = [np.concatenate([a if a is not None else np.zeros_like(b), b]) for a, b in itertools.zip_longest(table, more)]
        return np.stack(table)

    def scores(self, queries: np.ndarray) -> tuple[Slices, np.ndarray]:
        """Bit slices (queries, words) of non-negative sums, and what to add to each query's sums for its inner products."""
        base = max(0, -int(queries.min()))
        lifted = (queries + base).astype(np.uint64)
        columns: list[list[np.ndarray]] = [[] for _ in range(64)]
        for bit in range(int(lifted.max()).bit_length()):
            on = ((lifted >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
            for g, table in enumerate(self.tables):
                part = on[:, g * GROUP : (g + 1) * GROUP]
                pick = part @ (1 << np.arange(part.shape[1]))
                for i, s in enumerate(table):
                    columns[bit + i].append(s[pick])
        # Lifting the query adds base * (sum of a row's components): take base * (most - sum) on top.
        most = (1 << len(self.sums)) - 1
        for i, s in enumerate(self.sums):
            for bit in range(base.bit_length()):
                if base >> bit & 1:
                    columns[i + bit].append(np.broadcast_to(~s, (len(queries), self.words)))
        while columns and not columns[-1]:
            columns.pop()
        slices = [np.broadcast_to(s, (len(queries), self.words)) for s in _total(columns)] or [np.zeros((len(queries), self.words), np.uint64)]
        return slices, queries @ self.least - base * most

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of each query's k best rows, the earlier row at a tie; own: row that a query must not take, or -1."""
        slices, add = self.scores(queries)
        maybe = np.broadcast_to(self.there, (len(queries), self.words)).copy()
        mine = np.flatnonzero(own >= 0)
        maybe[mine, own[mine] // 64] &= ~(np.uint64(1) << (own[mine] % 64).astype(np.uint64))
        sure = np.zeros_like(maybe)
        for s in reversed(slices):
            high = sure | (maybe & s)
            few = (np.bitwise_count(high).sum(axis=1, dtype=np.int64) < k)[:, None]
            sure = np.where(few, high, sure)
            maybe &= np.where(few, ~s, s)
        # At most k - 1 rows are sure; those left are equal in every slice, the first of them fill up.
        bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(bool)
        taken, tied = bits(np.ascontiguousarray(sure)), bits(np.ascontiguousarray(maybe))
        room = k - taken.sum(axis=1)
        q, row = np.nonzero(taken | (tied & (np.cumsum(tied, axis=1) <= room[:, None])))
        word, shift = row // 64, (row % 64).astype(np.uint64)
        score = np.zeros(len(q), np.int64)
        for i, s in enumerate(slices):
            score += ((s[q, word] >> shift) & np.uint64(1)).astype(np.int64) << i
        return q, row, score + add[q]


def sliced_limit(width: int) -> int:
    """The greatest size of a component in the index: sums over `width` products, lifted to be non-negative, then fit in a long."""
    return min(1 << 30, 1 << (59 - width.bit_length()) // 2)


def _whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers; beyond 2 ** 53 a double is an integer itself, so scaling can't overflow."""
    return np.array([math.floor(x * scale) if abs(x) < 2.0**53 else int(x) * scale for x in values.ravel().tolist()], object).reshape(values.shape)


def exact_top(queries: np.ndarray, rows: np.ndarray, asks: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's id, row's id, score) of each query's k best rows of another id, by whole integers; a tie goes to the smaller id."""
    out: list[tuple[int, int, int]] = []
    many = max(1, PAIRS // max(1, len(ids)))
    least, most = LEAST, MOST
    for a in range(0, len(asks), many):
        points = queries[a : a + many].dot(rows.T)
        for ask, of in zip(asks[a : a + many].tolist(), points, strict=True):
            found = sorted((-min(most, max(least, p)), i) for p, i in zip(of.tolist(), ids.tolist(), strict=True) if i != ask)[:k]
            out += [(ask, i, -p) for p, i in found]
    columns = zip(*out, strict=True) if out else ((), (), ())
    return tuple(np.array(c, np.int64) for c in columns)


_PACKED = "ids binary, vals binary, width int, wide boolean"


def _pack(limit: int, scale: int):
    """Rows (id, v) to packed blocks of at most `limit` rows of one width, by id within a block.

    vals are quantised (int32), or for rows with a component beyond sliced_limit the doubles that came.
    """
    schema = pa.schema([("ids", pa.binary()), ("vals", pa.binary()), ("width", pa.int32()), ("wide", pa.bool_())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(kind: tuple[int, bool]) -> pa.RecordBatch:
            ids, vals = (np.concatenate(x) for x in zip(*held.pop(kind), strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pylist([{"ids": ids[order].tobytes(), "vals": vals[order].tobytes(), "width": kind[0], "wide": kind[1]}], schema)

        for batch in batches:
            ids, v = batch.column("id").to_numpy(), batch.column("v")
            widths = pc.list_value_length(v).to_numpy()
            flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
            for width in np.unique(widths).tolist():
                rows = np.flatnonzero(widths == width)
                raw = flat[starts[rows][:, None] + np.arange(width)]
                with np.errstate(over="ignore"):
                    scaled = np.floor(raw * scale)
                over = (np.abs(scaled) > sliced_limit(width)).any(axis=1)
                for wide, values in ((False, scaled[~over].astype(np.int32)), (True, raw[over])):
                    own = ids[rows[over == wide]]
                    kind = (width, wide)
                    for a in range(0, len(own), limit):
                        held.setdefault(kind, []).append((own[a : a + limit], values[a : a + limit]))
                        if sum(len(i) for i, _ in held[kind]) >= limit:
                            yield block(kind)
        for kind in list(held):
            yield block(kind)

    return pack


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other rows by integer inner product.

    Components become floor(scale * x); a tie goes to the smaller id.  Vectors that
    are null or empty, hold a null or a non-finite component, or have no id take no
    part; vectors of different widths don't meet.  Scores are exact whatever the
    size of the components; one that doesn't fit in a long counts as the greatest
    or least long, so such rows tie with each other at that end.  Of rows that
    share an id each is a candidate, except for queries of the same id.  Fewer
    candidates than k give all of them.  Other columns are ignored.
    """
    v = F.col(vec_col)
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), sound.alias("sound"), is_query.alias("ask")).filter("id is not null and sound")
    spark = vectors.sparkSession
    asked = usable.filter("ask").select("id", "v")
    # Queries are dealt to as many tasks as they fill blocks, however small the input's partitions are.  The counts read no vectors.
    rows, n_asked = vectors.agg(F.count("*"), F.count_if(is_query)).first()
    blocks = max(1, -(-n_asked // QUERIES))
    questions = cut(asked.repartition(min(blocks, n := partitions(spark))).mapInArrow(_pack(QUERIES, scale), _PACKED)).select(F.struct("ids", "vals", "width", "wide").alias("q"))
    # A block of the index meets every block of queries in a cell of a grid of down * across cells, more than there are tasks:
    # index blocks are copied along a row of the grid, query blocks down a column, so that both sides send about as much.
    cells = 4 * n
    across = max(1, min(blocks, round((cells * n_asked / max(1, rows)) ** 0.5)))
    down = -(-cells // across)
    index = usable.select("id", "v").mapInArrow(_pack(BLOCK, scale), _PACKED).select(F.struct("ids", "vals", "width", "wide").alias("b"), F.col("width"), _place("ids", down).alias("i"))
    index = index.select("b", "width", "i", _every(across).alias("j"))
    spread = questions.select("q", F.col("q.width").alias("width"), _every(down).alias("i"), _place("q.ids", across).alias("j"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Block | None] = (b"", None)
        for batch in batches:
            for i in range(batch.num_rows):
                b, q = batch.column("b")[i].as_py(), batch.column("q")[i].as_py()
                ids, asks = np.frombuffer(b["ids"], np.int64), np.frombuffer(q["ids"], np.int64)
                if b["wide"] or q["wide"]:
                    sides = (np.frombuffer(x["vals"], np.float64 if x["wide"] else np.int32).reshape(-1, x["width"]) for x in (q, b))
                    whole = (_whole(x, scale) if x.dtype == np.float64 else x.astype(object) for x in sides)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, exact_top(*whole, asks, ids, k))), names=["query_id", "vec_id", "score"])
                    continue
                values, questions = (np.frombuffer(x["vals"], np.int32).reshape(-1, b["width"]).astype(np.int64) for x in (b, q))
                if last[0] != b["ids"] + b["vals"] or last[1] is None:
                    last = (b["ids"] + b["vals"], Block(values))
                block = last[1]
                low, high = np.searchsorted(ids, asks), np.searchsorted(ids, asks, side="right")
                many = max(1, WORKING // (8 * block.words))
                for a in range(0, len(asks), many):
                    at = slice(a, a + many)
                    # Of a query's own id at most one row can be masked here; any further ones go below.
                    extra = int(max(0, (high[at] - low[at]).max() - 1))
                    own = np.where(high[at] > low[at], low[at], -1)
                    who, row, points = block.top(questions[at], own, k + extra)
                    fine = ids[row] != asks[at][who]
                    who, row, points = who[fine], row[fine], points[fine]
                    yield pa.RecordBatch.from_arrays([pa.array(asks[at][who]), pa.array(ids[row]), pa.array(points)], names=["query_id", "vec_id", "score"])

    # The sizes that Spark estimates count no copies: without the hint one side would be broadcast, copies and all, through the driver.
    found = index.join(spread.hint("merge"), ["width", "i", "j"]).select("b", "q").mapInArrow(score, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _place(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
