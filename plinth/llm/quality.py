"""Quality rules; DataFrame functions only.

Base rules count words, symbols and repeats.  The verdict is a log-likelihood
ratio: hashed word n-grams of trusted documents and of the whole corpus are two
multinomials, and a document keeps its place if the mean log-ratio of its n-grams
reaches a threshold.  The table has BUCKETS cells whatever the corpus, so it is
part of the plan and each document is scored where it is read.  Repeats are found
by hashes of 64 bits: a text of ten million words has a false one with a
probability of 1e-5 at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut, words

#: Cells of the table of log-ratios, a power of two; smoothing.
BUCKETS, ALPHA = 1 << 14, 1.0
#: Trusted documents that are learned from at most (those of the least hashes of doc_id), a documented bound of the fit.
TRUSTED = 10_000
#: One of so many trusted documents is held out of the counts; all of these set the threshold, which lies SLACK below this quantile
#: of their scores, taken in steps of 1 / STEPS.
HELD_OUT, QUANTILE, SLACK, STEPS = 4, 0.005, 0.05, 10_000


def _bucket(*x: Column) -> Column:
    return F.xxhash64(*x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _from(x: Column, place: int, less: int) -> Column:
    """The elements of x from a place (counted from 1) on, `less` fewer than x has."""
    return F.slice(x, place, F.greatest(F.size(x) - less, F.lit(0)))


def _features(w: Column) -> Column:
    """Buckets of a text's words and word pairs."""
    return F.concat(F.transform(w, lambda x: _bucket(x)), F.zip_with(_from(w, 1, 1), _from(w, 2, 1), lambda x, y: _bucket(x, y)))


def base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, then w (words), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row's text."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*keep, text.alias("t"), words(F.col("text")).alias("w"), F.split(text, "\n", -1).alias("lines"))
    out = out.select("*", F.array_distinct("lines").alias("others"), F.transform("w", lambda x: F.xxhash64(x)).alias("g"))
    # Only of texts with equal lines these are looked at.
    spoken = lambda c: F.size(F.filter(c, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    again = F.when(F.size("lines") > F.size("others"), spoken("lines") - spoken("others")).otherwise(0)
    # Windows of three words as hashes of 64 bits, made of those of their words.
    g, hashed = F.col("g"), lambda x, y: F.xxhash64(x, y)
    out = out.select(
        *keep, "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        again.cast("long").alias("n_dup_lines"),
        F.zip_with(F.zip_with(_from(g, 1, 2), _from(g, 2, 2), hashed), _from(g, 3, 2), hashed).alias("h"),
    )
    # Only of texts with a repeat the windows are sorted, with their places: neighbours that share the hash repeat.
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), placed))
    same = lambda x, i: F.coalesce(x["h"] == F.get("s", i)["h"], F.lit(False))
    again = F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.withColumn("p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.transform("p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - p, F.lit(3))))
    repeated = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return out.withColumn("n_repeat_words", repeated).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("h", "s", "p")


class Ratio:
    """Log-ratios by bucket."""

    def __init__(self, values: list[float]):
        self.values = values

    def score(self, w: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.5f}" for x in self.values)), ",").cast("array<double>")
        # Each word with the pair that it begins; the last one, beside no other, counts twice.
        each = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, y: F.get(table, _bucket(x)) + F.get(table, _bucket(x, y)))
        total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b) - F.get(table, _bucket(F.get(w, F.size(w) - 1)))
        return F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).otherwise(F.lit(0.0))


def _trusted(labels: DataFrame) -> DataFrame:
    """(trusted, tested): ids of documents of quality 1, and whether they are held out of the counts."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted")).distinct()
    return good.withColumn("tested", F.pmod(F.xxhash64("trusted", F.lit(1)), F.lit(HELD_OUT)) == 0)


def fit(docs: DataFrame, labels: DataFrame) -> Ratio:
    """Ratios of trusted documents (quality 1, those held out aside) to all documents; without trusted ones all ratios are 0."""
    # Documents that were counted as trusted score above their like, so others of them set the threshold.
    learned = _trusted(labels).filter("not tested").orderBy(F.xxhash64("trusted"), "trusted").limit(TRUSTED).select("trusted")
    marked = docs.select("doc_id", "text").join(F.broadcast(learned), F.col("doc_id") == F.col("trusted"), "left")  # TRUSTED rows at most
    each = marked.select(F.col("trusted").isNotNull().alias("good"), words(F.col("text")).alias("w")).select("good", F.explode(_features(F.col("w"))).alias("bucket"))
    rows = each.groupBy("bucket").agg(F.count("*").alias("every"), F.count_if("good").alias("good")).collect()  # BUCKETS at most
    every, trusted = ({r["bucket"]: r[c] for r in rows} for c in ("every", "good"))
    n, m = sum(every.values()), sum(trusted.values())
    if not m:
        return Ratio([0.0] * BUCKETS)
    ratio = lambda b: math.log((trusted.get(b, 0) + ALPHA) / (m + ALPHA * BUCKETS)) - math.log((every.get(b, 0) + ALPHA) / (n + ALPHA * BUCKETS))
    return Ratio([ratio(b) for b in range(BUCKETS)])


def scored(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score of each row."""
    rules = base_rules(docs.select("doc_id", "text"), ["doc_id"])
    return rules.withColumn("score", ratio.score(F.col("w"))).drop("w")


def threshold(found: DataFrame, labels: DataFrame) -> float:
    """SLACK below the low quantile of the scores (0 at most) of all trusted documents that were held out and have 50 words; below 0 without any."""
    tested = found.filter("n_words >= 50").join(_trusted(labels).filter("tested"), F.col("doc_id") == F.col("trusted"))
    # Steps keep the distinct values of the exact percentile few.
    low = tested.agg(F.percentile(F.floor(F.col("score") * STEPS) / STEPS, QUANTILE)).first()[0]
    return min(0.0, low or 0.0) - SLACK


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null text has no words and fails the base rules.  Rows are judged alone:
    ties, repeated rows and null doc_ids are rows like others; other columns are
    ignored.  Counts and scores, not texts, are written before the threshold is
    taken from them, so texts are read twice, once to count and once to score.
    """
    found = cut(scored(docs, fit(docs, labels)))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold(found, labels))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")
