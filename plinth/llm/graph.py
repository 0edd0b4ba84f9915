"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut, dropped

#: Links that a task of a round takes, about; a round of few links isn't spread over all partitions of a shuffle.
LINKS = 100_000


def _stars(links: DataFrame, both_ways: bool, tasks: int) -> DataFrame:
    """Every node hands its least neighbour (or itself) to its larger or smaller neighbours.

    Least neighbours are an aggregate that is written and joined back, so a node
    with very many links is rows of a join that can be split, never a list.
    """
    seen = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else links
    least = cut(seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
    joined = seen.join(least, "a")
    if both_ways:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = cut(out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct().coalesce(tasks))
    dropped(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): the least node that can be reached.

    Alternates large-star and small-star steps until the links are stars around
    the least node of each component, in logarithmically many rounds.  Nulls and
    links of a node to itself are ignored; nodes without links don't appear.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b").distinct())
    state = None
    while True:
        # An order-free digest of all links tells whether a round changed any.
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = -(-max(1, now[0]) // LINKS)
        if not now[0] or now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).coalesce(tasks)
        state = now
        half = _stars(links, True, tasks)
        dropped(links)
        links = _stars(half, False, tasks)
        dropped(half)
