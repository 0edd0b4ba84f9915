"""Exact token counts for every context limit from a histogram of lengths.

Documents are aggregated by their encoded length; running sums over the distinct
lengths then answer how many documents and tokens lie below or above a limit, what
truncation keeps, and quantiles.  The histogram is written before it is summed, so
texts are encoded once.  It has far fewer rows than the corpus: n distinct lengths
need n * n / 2 tokens, so 100 TB have some millions at most.  Its running sums are
taken in blocks of BLOCK lengths, and one task adds up a row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.arrays import slices
from plinth.llm.common import cut
from plinth.llm.tokens import byte_bpe

#: Lengths in a block of the running sums.
BLOCK = 64


def encoded_lengths(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(n_tokens, docs) with partial counts of the documents of each length; a null text has 0 tokens.

    path: file of ranks in tiktoken's format, the same on all executors; pattern: how it splits texts.
    Special tokens in a text are ordinary text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_bpe(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [len(encoding.encode_ordinary(t)) if t else 0 for t in part.column("text").to_pylist()]
                lengths, docs = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["n_tokens", "docs"])

    return docs.select("text").mapInArrow(count, "n_tokens long, docs long")


def suffix_sums(counts: DataFrame) -> DataFrame:
    """For each distinct length n_tokens: docs, docs_over and tokens_over (longer ones), docs_up_to, tokens_up_to, kept_tokens (if all are truncated to it), quantile.

    counts: (n_tokens, docs), any number of rows per length.  An empty table gives no rows.
    """
    histogram = cut(counts.groupBy("n_tokens").agg(F.sum("docs").alias("docs")))
    histogram = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = histogram.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), *(F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, d: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{d}_later")
    out = histogram.join(blocks, "block").withColumn("docs_over", over("docs", "d")).withColumn("tokens_over", over("tokens", "t"))
    up_to = F.col("d_all") - F.col("docs_over")
    return out.select(
        "n_tokens", "docs", "docs_over", "tokens_over", up_to.alias("docs_up_to"), (F.col("t_all") - F.col("tokens_over")).alias("tokens_up_to"),
        (F.col("t_all") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("kept_tokens"), (up_to / F.col("d_all")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, kept_tokens) for any limits, from suffix_sums: below a distinct length the next lower one answers."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in limits], "limit long"))  # as many rows as limits are asked
    below = lambda c: F.coalesce(F.max_by(c, F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_tokens"))), F.lit(0))
    shorter = sums.join(asked, F.col("n_tokens") <= F.col("limit"), "right").groupBy("limit").agg(below("docs_up_to").alias("up_to"), below("tokens_up_to").alias("tokens"))
    every = sums.agg(F.max("docs_up_to").alias("every"))
    return shorter.withColumn("every", F.coalesce(F.lit(every.first()[0]), F.lit(0))).select("limit", (F.col("every") - F.col("up_to")).alias("docs_over"), (F.col("tokens") + F.col("limit") * (F.col("every") - F.col("up_to"))).alias("kept_tokens"))


def quantile(sums: DataFrame, share: float) -> Column | int | None:
    """The least length that at least this share of the documents doesn't exceed (null without documents)."""
    return sums.filter(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
