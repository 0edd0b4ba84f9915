"""Near-duplicates by b-bit MinHash, confirmed on the full shingle sets.

Texts with the same set of shingles are one class from the start.  Each class has
128 minima; 32 bands of four give buckets of candidates, and the low four bits of
all minima, packed into eight longs, give a collision-corrected estimate by
counting bits.  Candidates are confirmed on whole sets:

1. every class against the best-connected class of each of its buckets;
2. then, within buckets that still hold several components, only pairs across
   components that can be linked at all: by their sizes, by the estimate, and by
   what is known exactly of each, namely the shingles that no other text or no
   other component of those buckets has, and how its set compares with that of the
   bucket's pivot.

Before any two meet in step 2, a class leaves a bucket where its own shingles and
the fewest own ones of another component there rule out all partners.  So a group
of copies, and a group of texts of one template, cost about a comparison for each
member and not one for each pair, while no pair of classes that could still join
two components is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.arrays import SLICE_BYTES, Words, compressed, full, mix, plain, slices, windows
from plinth.llm.common import cut
from plinth.llm.graph import components

SHINGLE, MINIMA, ROWS, BITS = 5, 128, 4, 4
#: The packed nibbles of all minima, in longs.
PACKED = MINIMA * BITS // 64
#: A candidate goes if its estimate is this far (five deviations) below the threshold.
MARGIN = 0.2
#: Classes of a bucket that meet in one task; larger buckets are spread over a grid of tasks.
CELL = 512


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word 5-grams; of a shorter text the whole sequence."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    at = full(words, SHINGLE)
    found = windows(hashes, SHINGLE)
    edges = np.searchsorted(at, words.first)
    out = [np.unique(found[at[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for i in np.flatnonzero((words.count > 0) & (words.count < SHINGLE)):
        out[i] = windows(hashes[words.first[i] : words.first[i + 1]].copy(), int(words.count[i]))
    return out


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 128): minima of the sets (none empty) under 128 multiplications by odd numbers."""
    factors = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(sets), MINIMA), np.uint64)
    first = 0
    while first < len(sets):  # about 32k hashes at a time stay in the cache
        stop, size = first, 0
        while stop < len(sets) and (stop == first or size + len(sets[stop]) <= 32768):
            size += len(sets[stop])
            stop += 1
        x = np.concatenate(sets[first:stop])
        edges = np.cumsum([0] + [len(s) for s in sets[first : stop - 1]])
        product = np.empty_like(x)
        for i, factor in enumerate(factors):
            np.multiply(x, factor, out=product)
            out[first:stop, i] = np.minimum.reduceat(product, edges)
        first = stop
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    grouped = minima.reshape(len(minima), -1, ROWS)
    key = mix(np.broadcast_to(np.arange(1, grouped.shape[1] + 1, dtype=np.uint64), grouped.shape[:2]).copy())
    for i in range(ROWS):
        key = mix(key + grouped[:, :, i] * np.uint64(0x9E3779B97F4A7C15))
    return key


def _packed(minima: np.ndarray) -> np.ndarray:
    nibbles = (mix(minima.copy()) & np.uint64(15)).reshape(len(minima), PACKED, 16)
    return np.bitwise_or.reduce(nibbles << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2)


_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, " + ", ".join(f"p{i} long" for i in range(PACKED))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128 bits (s1, s2) that name the set, band keys, packed low bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                names, packed = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), PACKED), np.uint64)
                keys = np.zeros((0, MINIMA // ROWS), np.uint64)
                if len(some):
                    there = [sets[i] for i in some]
                    edges = np.cumsum([0] + [len(s) for s in there[:-1]])
                    flat = np.concatenate(there)
                    names[some, 0], names[some, 1] = np.add.reduceat(mix(flat.copy()), edges), np.add.reduceat(mix(flat + np.uint64(0x1234567)), edges)
                    minima = _minima(there)
                    keys, packed[some] = _bands(minima), _packed(minima)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * (MINIMA // ROWS))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), *(pa.array(np.ascontiguousarray(names[:, i]).view(np.int64)) for i in (0, 1)), bands, *(pa.array(np.ascontiguousarray(packed[:, i]).view(np.int64)) for i in range(PACKED))],
                    names=["doc_id", "n_shingles", "s1", "s2", "bands", *(f"p{i}" for i in range(PACKED))],
                )

    return docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(sign, _SIGNED)


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed low bits of sides a and b, corrected for chance agreement."""
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(x)
    chance = 1 / (1 << BITS)
    return (1 - differ / MINIMA - chance) / (1 - chance)


def _possible(a: str, b: str, percent: int) -> Column:
    sizes = 100 * F.least(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")) >= percent * F.greatest(F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles"))
    return sizes & (estimate(a, b) >= percent / 100 - MARGIN)


def _compared(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with `shared`, the shingles in both full sets, `size`, those of b, and whether that makes a link."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in batches:
            for part in slices(batch, "ta", SLICE_BYTES // 2):
                counts = []
                for x, y in zip(shingle_sets(plain(part.column("ta"))), part.column("tb").to_pylist(), strict=True):
                    if y != last[0]:  # rows come by b
                        last = (y, shingle_sets(plain(pa.array([y], pa.binary())))[0])
                    both = len(np.intersect1d(x, last[1], assume_unique=True))
                    counts.append((both, len(last[1]), 100 * both >= percent * (len(x) + len(last[1]) - both)))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), *map(pa.array, zip(*counts, strict=True))], names=["a", "b", "shared", "size", "link"])

    sides = [texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long, shared long, size long, link boolean").groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("size").alias("size"), F.max("link").alias("link"))


def _own(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(class, alone, own): how many shingles of each class no other text has, and how many no other component (of placed: class, component)."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 2):
                sets = shingle_sets(plain(part.column("text")))
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["class", "h"])

    found = cut(texts.mapInArrow(shingles, "class long, h long").join(placed, "class"))
    holders = found.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("class").alias("a"), F.max("class").alias("b"))
    single = cut(holders.filter("lo = hi").select("h", (F.col("a") == F.col("b")).alias("alone")))
    return found.join(single, "h").groupBy("class").agg(F.count_if("alone").alias("alone"), F.count("*").alias("own"))


def _with_partners(side: DataFrame) -> DataFrame:
    """Rows of side (band, component, need) with need + another's need <= 0 for some row of the band in another component.

    Only the least need of each component counts, and of these the two least.
    """
    least = cut(side.groupBy("band", "component").agg(F.min("need").alias("need")))
    ranked = least.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("need", "component"))).filter("r <= 2")
    two = cut(ranked.groupBy("band").agg(F.min("need").alias("n1"), F.min_by("component", "r").alias("c1"), F.max("need").alias("n2"), F.count("*").alias("n")).filter("n = 2").drop("n"))
    kept = side.join(two, "band").filter(F.col("need") + F.when(F.col("component") == F.col("c1"), F.col("n2")).otherwise(F.col("n1")) <= 0)
    return kept.drop("n1", "c1", "n2")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * shared >= percent * all of their distinct
    lower-case (A-Z) 5-word shingles; a text of fewer words is a single shingle, a
    text without words and a null have none and are linked with nothing.
    component_id is the least doc_id that links reach, kept says that it is the
    document's own.  Rows without a doc_id are left out; rows that share a doc_id
    are one document, linked by any of its texts.  Other columns are ignored.
    """
    signed = cut(signatures(docs))
    some = signed.filter("n_shingles > 0")
    key = ["s1", "s2", "n_shingles"]
    # Aggregates are written before they are joined: a join of two plain exchanges can be split where a set, a band or a
    # document has very many rows, one with an aggregate in between can't.
    members = some.join(cut(some.groupBy(*key).agg(F.min("doc_id").alias("class"))), key)
    packed = [f"p{i}" for i in range(PACKED)]
    classes = members.filter("doc_id = class")
    # Buckets with several classes; the pivot is the class that meets most others in all its buckets.
    banded = classes.select("class", F.explode("bands").alias("band"))
    shared = cut(banded.join(cut(banded.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")), "band"))
    degree = shared.groupBy("class").agg(F.sum("size").alias("degree"))
    buckets = cut(shared.select("band", "class").join(degree, "class"))
    pivots = cut(buckets.groupBy("band").agg(F.max_by("class", F.struct("degree", -F.col("class"))).alias("pivot")))
    stats = cut(classes.select("class", "n_shingles", "bands", *packed).join(degree.select("class"), "class", "left_semi"))
    texts = cut(compressed(docs).join(degree.select(F.col("class").alias("doc_id")), "doc_id", "left_semi"))

    pairs = buckets.join(pivots, "band").filter("class != pivot").select(F.col("class").alias("x"), F.col("pivot").alias("y")).distinct()
    x, y = (stats.alias(k).withColumnRenamed("class", "id").alias(k) for k in "xy")
    likely = cut(pairs.join(x, F.col("x") == F.col("x.id")).join(y, F.col("y") == F.col("y.id")).filter(_possible("x", "y", percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    tried = cut(_compared(likely, texts, percent))
    # A doc_id whose texts are in several classes links these.
    spread = cut(members.groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("most")).filter("b < most").select("doc_id", "b"))
    links = tried.filter("link").select("a", "b").unionByName(members.join(spread, "doc_id").filter("class > b").select(F.col("class").alias("a"), "b"))
    found = cut(components(links))

    # What could still join two components.
    placed = buckets.select("band", "class").join(found, F.col("class") == F.col("node"), "left").select("band", "class", F.coalesce("component", "class").alias("component"))
    split = cut(placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band"))
    # Two sets differ at least in: the shingles that nothing else has; what more of their other shingles outside
    # of the pivot's set one of them has; and how many more of the pivot's one of them misses.
    against = tried.select(F.col("a").alias("class"), F.col("b").alias("pivot"), "shared", (F.col("size") - F.col("shared")).alias("miss"))
    # Of a doc_id with several texts such counts would be of all of them; it goes without.
    several = cut(stats.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select("class"))
    against = against.join(several, "class", "left_anti").join(several.withColumnRenamed("class", "pivot"), "pivot", "left_anti")
    # Pairs with the pivot itself are decided.
    left = cut(placed.join(split, "band").join(pivots, "band").filter("class != pivot"))
    population = cut(left.select("class").unionByName(left.select(F.col("pivot").alias("class"))).distinct())
    population = population.join(found, F.col("class") == F.col("node"), "left").select("class", F.coalesce("component", "class").alias("component"))
    own = _own(texts.join(population.select(F.col("class").alias("doc_id")), "doc_id", "left_semi"), population)
    own = cut(own.join(several, "class", "left_anti"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sized = left.join(stats.select("class", "n_shingles"), "class").join(own, "class", "left").select(*left.columns, "n_shingles", zero("alone"), zero("own"))
    # A pair needs (100 + percent) * difference <= (100 - percent) * both sizes, and what each has of its own differs.
    able = cut(_with_partners(sized.withColumn("need", (100 + percent) * F.col("own") - (100 - percent) * F.col("n_shingles"))))
    side = able.drop("n_shingles").join(against, ["class", "pivot"], "left").join(stats, "class")
    side = side.withColumn("other", F.col("n_shingles") - F.col("shared") - F.col("alone")).withColumn("place", F.array_position("bands", F.col("band"))).drop("shared")
    grid = cut(able.groupBy("band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("k")))
    side = cut(side.join(grid, "band").withColumn("part", F.pmod(F.xxhash64("class"), F.col("k")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    x, y = side.select("*", F.col("part").alias("i"), every.alias("j")).alias("x"), side.select("*", every.alias("i"), F.col("part").alias("j")).alias("y")
    more_of = lambda c: F.coalesce(F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")), F.lit(0))
    apart = F.col("x.alone") + F.col("y.alone") + more_of("other") + more_of("miss")
    near = (100 + percent) * apart <= (100 - percent) * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    near &= F.col("x.need") + F.col("y.need") <= 0
    across = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.component") < F.col("y.component")) & near & _possible("x", "y", percent)
    # A pair comes from the first bucket that has both.
    across &= F.array_position(F.zip_with("x.bands", "y.bands", lambda a, b: a == b), True) == F.col("x.place")
    rest = x.join(y, across).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = ordered(rest).join(ordered(tried).distinct(), ["a", "b"], "left_anti")
    more = cut(_compared(rest, texts, percent).filter("link").select("a", "b"))
    if more.limit(1).count():
        found = cut(components(links.unionByName(more)))

    by_class = members.select("doc_id", "class").join(found, F.col("class") == F.col("node"), "left")
    placed = by_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("component_id", "doc_id") == F.col("doc_id")).alias("kept"))
    )
