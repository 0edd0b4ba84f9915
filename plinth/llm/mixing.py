"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Each document has a hash.  A source takes whole copies of all its documents and,
for what is left of its target, the documents whose hash is below a threshold.
The threshold comes from histograms: sizes are summed by source and by the leading
bits of the hash, the bucket in which the running sum passes the budget is the
boundary, and only that bucket is split again by the next bits, until the hash is
used up.  Nothing is sorted but the histogram.  Budgets nest: a smaller one takes a
subset of what a larger one takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import SPACE, cut

#: Weights by rank of the source, repeating; what is shared, and a source's most, as multiples of sizes.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Bits of the hash, and those that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12


def size(text: Column) -> Column:
    """Words of a text (null: 0)."""
    # White space before each word but the first, and a word at all: what is left are its first characters.
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also target: shares by weight, none above MOST times its size.

    Filling up to the caps and sharing the excess again until none is above ends
    where all uncapped sources have the same share per weight.  In order of size
    per weight the capped ones come first, so running sums find that level.
    One row per source is sorted here, after the documents are summed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = reduce(lambda w, i: w.when((F.col("rank") - 1) % len(WEIGHTS) == i, float(WEIGHTS[i])), range(1, len(WEIGHTS)), F.when((F.col("rank") - 1) % len(WEIGHTS) == 0, float(WEIGHTS[0])))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # Levels fall from there on: the first source that its share doesn't fill sets the level; before it all are capped.
    levels = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _hash(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text")), F.lit(seed)), 64 - HASH_BITS)


def thresholds(sized: DataFrame) -> DataFrame:
    """(s, source_size, target, whole, limit) for each source of sized (source, size, hash): whole copies of all, and one more of hashes below limit."""
    # A budget for each source: whole copies aside, what the threshold has to give.
    state = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST))).otherwise(F.lit(0))
    state = state.withColumn("whole", whole.cast("int")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = cut(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("width", F.lit(0).cast("long")).withColumn("open", F.lit(True)))
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - (level + 1) * LEVEL_BITS
        edge = state.filter("open").select(F.col("source").alias("s"), "prefix", "left")
        # Only documents of the boundary bucket are summed again.
        inside = sized.join(edge, _same("source", "s") & (F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("s", "left", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        passed = sums.withColumn("after", F.sum("tokens").over(running)).filter(F.col("after") > F.col("left"))
        first = passed.groupBy("s").agg(F.min(F.struct("bucket", "tokens", "after")).alias("b")).select("s", "b.*")
        found = state.join(first, _same("source", "s"), "left")
        state = cut(found.select(
            "source", "source_size", "target", "whole",
            # What the buckets before the boundary take is settled.
            F.when(F.col("bucket").isNotNull(), F.col("left") - (F.col("after") - F.col("tokens"))).otherwise(F.col("left")).alias("left"),
            F.coalesce("bucket", F.when(F.col("open"), F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).otherwise(F.shiftleft("prefix", LEVEL_BITS))).alias("prefix"),
            F.coalesce("tokens", F.lit(0)).alias("width"), F.col("bucket").isNotNull().alias("open"),
        ))
    # The last bucket is a single hash value: in, if that comes nearer.
    limit = F.col("prefix") + F.when(F.col("open") & (2 * F.col("left") >= F.col("width")), 1).otherwise(0)
    return state.select(F.col("source").alias("s"), "source_size", "target", "whole", limit.alias("limit"))


def _copies() -> Column:
    return (F.col("whole") + F.when((F.col("hash") < F.col("limit")) & (F.col("whole") < MOST), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, size_of: Column | None = None, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and copies (0, 1 or 2).

    Sources rank by code point, null last.  taken = copies * size; for each source
    the sum of taken is as near to its target as whole documents in hash order
    come, so it is off by at most half of the boundary document.  The hash is that
    of doc_id (of the text where that is null): rows that share it go together,
    and reruns agree.  A null text has size 0, is never needed for a target and is
    taken like its neighbours in hash order.  An empty table gives no rows; other columns are ignored.
    """
    sized = cut(docs.select("doc_id", "source", (size(F.col("text")) if size_of is None else size_of).alias("size"), _hash(seed).alias("hash")))
    joined = sized.join(thresholds(sized), _same("source", "s"))
    return joined.select("doc_id", "size", "source_size", "target", (_copies() * F.col("size")).alias("taken"), _copies().alias("copies"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs that the mix takes, all columns, those taken twice as two rows.

    Each row is judged where it is read, by its hash and its source's threshold;
    docs are neither sorted nor joined by document.  Second copies come from a
    reading of their own, so that they are far from the first ones.
    """
    plan = thresholds(cut(docs.select("source", size(F.col("text")).alias("size"), _hash(seed).alias("hash"))))
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), F.col("source").alias("source"), _hash(seed).alias("hash")).join(plan, _same("source", "s"))
    return reduce(DataFrame.unionAll, [held.filter(_copies() > i).select("row.*") for i in range(MOST)])
