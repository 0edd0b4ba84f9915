"""documents -> language ID -> near-duplicates -> personal data -> mixing -> packed sequences."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm import language, mixing, nearcopies, packing, personal
from plinth.llm.common import bounded_batches, cut, dropped, stored, table

#: Least posterior of the predicted language.
LEAST_SCORE = 0.5
#: Share of the labelled rows predicted as a language that may fit it worse than all others, and how far below these the limit is.
OUTSIDE, SLACK = 0.001, 1.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language that the labelled rows teach; texts that are null, have no letters or fit no taught language go.

    The limit of the fit to a language is set by all labelled rows that are predicted
    as it, whatever their label; without any there is none.
    """
    model = language.train(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out()))
    out = ("__language", "__score", "__fit")
    least = cut(language.least_fit(language.predict(docs.filter("lang is not null"), model, ["lang"], out), "lang", "__language", "__fit", OUTSIDE))
    fits = F.col("__least").isNull() | (F.col("__fit") >= F.col("__least") - SLACK)
    known = (F.col("__language") != language.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    return language.predict(docs, model, out=out).filter(known).join(F.broadcast(least.withColumnRenamed("least", "__least")), "__language", "left").filter(fits).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group; rows without a doc_id stay, rows that share one stay or go together."""
    gone = nearcopies.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by the name of its kind, n_chars adjusted."""
    return personal.mask(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a training sequence, with its tokens: a sequence is its pieces' ids by offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _bounded(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _bounded(stage)) for stage in (language_id, near_dedup, personal_data, source_mixing, sequence_packing)]

#: Models, hashes and merges of byte pairs are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each one keeps is written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if i:
            dropped(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
