"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled documents by language and bucket;
each task sums its own before the exchange.  The matrix of log-probabilities has a
row of BUCKETS for each language, 128 KB whatever the input, and is broadcast in
slices of LANGUAGES rows.  It scores whole batches: the sparse n-grams of each text
select cells of a row, which are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plinth.llm.arrays import mix, slices
from plinth.llm.common import cut
from plinth.llm.tokens import forget

#: Lengths of n-grams, buckets, smoothing, languages in a slice of the matrix (16 MB).
ORDERS, BUCKETS, ALPHA, LANGUAGES = (1, 2, 3), 1 << 15, 0.5, 128
#: Answer for texts without letters.
UNKNOWN = "und"
#: n-grams that count as independent evidence for the score.
EVIDENCE = 64
#: Characters whose n-grams are worked on at once.
_STEP = 1 << 18

_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(low: list[str], buckets: int, starts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-case texts, the first of each text (n + 1 positions), whether a text has some.

    Everything but letters is a space; an n-gram has a letter and stays within its
    text.  starts: of a single text, the places from which n-grams are taken.
    """
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    letter = _LETTER[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    owner = np.repeat(np.arange(len(low)), np.diff(edges))
    found, owners = [], []
    key, some = points.copy(), letter.copy()
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            key = key[:-1] | (points[n - 1 :] << np.uint64(21 * (n - 1)))
            some = some[:-1] | letter[n - 1 :]
        if not len(key):
            break
        if n in ORDERS:
            use = some & (owner[: len(key)] == owner[n - 1 :])
            if starts is not None:
                use[starts:] = False
            found.append((mix(key[use] + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(buckets - 1)).astype(np.int32))
            owners.append(owner[: len(key)][use])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(low) + 1, np.int64), np.zeros(len(low), bool)
    all_owners = np.concatenate(owners)
    order = np.argsort(all_owners, kind="stable")
    first = np.searchsorted(all_owners[order], np.arange(len(low) + 1))
    return np.concatenate(found)[order], first, np.diff(first) > 0


def _lower(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def counted(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ngrams of the texts in lower case; a single text that is long comes in parts, each n-gram in one of them."""
    low = _lower(texts)
    if len(low) != 1 or len(low[0]) <= _STEP:
        yield ngrams(low, BUCKETS)
        return
    for at in range(0, len(low[0]), _STEP):
        yield ngrams([low[0][at : at + _STEP + max(ORDERS) - 1]], BUCKETS, _STEP)


class Slice:
    """Log-probabilities (languages, buckets) of some languages."""

    def __init__(self, counts: np.ndarray):
        self.weights = np.log((counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * counts.shape[1])).astype(np.float32)
        #: Mean log-probability of the n-grams that each language was counted from, smoothing included.
        self.usual = (np.exp(self.weights, dtype=np.float64) * self.weights).sum(axis=1)

    def totals(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(languages, texts): sums over the n-grams `found` of texts that begin at `first` and have some."""
        return np.stack([np.add.reduceat(row[found], first, dtype=np.float64) for row in self.weights])


class Model:
    """Languages with log-priors, and the matrix in slices, each held by a broadcast variable (or anything with a `value`)."""

    def __init__(self, languages: list[str], documents: np.ndarray, slices: list):
        self.languages, self.slices = languages, slices
        self.priors = np.log((documents + 1) / (documents.sum() + len(languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """The likeliest language of each text, its posterior, with evidence counted for at most EVIDENCE n-grams, and its fit.

        The fit is how far the mean log-probability of the text's n-grams in that
        language is above the usual one, times the root of their number (EVIDENCE at
        most): short texts stray more.  Unlike the posterior it is low for languages
        that weren't learned.
        """
        answers, score, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not self.languages:
            return answers, score.tolist(), fit.tolist()
        sizes, every = np.zeros(len(texts), np.int64), np.zeros((len(self.languages), len(texts)))
        for found, first, some in counted(texts):
            there = np.flatnonzero(some)
            if len(there):
                sizes[there] += np.diff(first)[there]
                every[:, there] += np.concatenate([part.value.totals(found, first[there]) for part in self.slices])
        rows = np.flatnonzero(sizes)
        sizes, total, at = sizes[rows], every[:, rows], np.arange(len(rows))
        best = (total + self.priors[:, None]).argmax(axis=0)
        usual = np.concatenate([part.value.usual for part in self.slices])
        fit[rows] = (total[best, at] / sizes - usual[best]) * np.sqrt(np.minimum(sizes, EVIDENCE))
        level = total / sizes * np.minimum(sizes, EVIDENCE) + self.priors[:, None]
        if len(rows):
            odds = np.exp(level - level.max(axis=0))
            score[rows] = odds[best, at] / odds.sum(axis=0)
        for i, b in zip(rows.tolist(), best.tolist(), strict=True):
            answers[i] = self.languages[b]
        return answers, score.tolist(), fit.tolist()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, "text", _STEP)


def train(docs: DataFrame, label: str = "lang") -> Model:
    """The model of the texts and non-null labels of all of docs; its size goes with the number of labels alone."""
    labelled = docs.select("text", F.col(label).alias("label")).filter("text is not null and label is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name in list(sums):
                held = sums.pop(name)
                there = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(there), pa.string()), pa.array(there.astype(np.int32) - 1), pa.array(held[there])], names=["label", "bucket", "n"])

        for batch in batches:
            for part in _parts(batch):
                labels = np.array(part.column("label").to_pylist(), object)
                for name in set(labels):
                    sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[0] += (labels == name).sum()  # documents
                for found, first, _ in counted(part.column("text").to_pylist()):
                    owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                    for name in set(labels):
                        sums[name][1:] += np.bincount(found[(labels == name)[owner]], minlength=BUCKETS)
                # Sums are handed on before they outgrow the task, as many labels as there may be.
                if len(sums) > LANGUAGES:
                    yield from flush()
        yield from flush()

    sums = cut(labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    documents = {r["label"]: r["n"] for r in sums.filter("bucket < 0").select("label", "n").toLocalIterator()}
    languages = sorted(documents)
    parts = []
    for low in range(0, len(languages), LANGUAGES):
        names = languages[low : low + LANGUAGES]
        place = {name: i for i, name in enumerate(names)}
        got = sums.filter((F.col("bucket") >= 0) & F.col("label").between(names[0], names[-1])).toArrow()
        counts = np.zeros((len(names), BUCKETS))
        row = np.array([place[x] for x in got.column("label").to_pylist()], np.int64)
        counts[row, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        parts.append(docs.sparkSession.sparkContext.broadcast(Slice(counts)))
    return Model(languages, np.array([documents[x] for x in languages], np.float64), parts)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1 (null: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, out: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Columns `keep` of docs (all) with lang_pred and score (0 to 1) from each row's whole text; `und` and 0 for a null text or one without letters.

    out: names of the two new columns, perhaps of a third one for the fit; columns
    of docs with these names are replaced.  With a model of no languages every answer is `und`.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in out]
    docs = docs.select(*keep, *[c for c in ["text"] if c not in keep])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                languages, *scores = model.predict(part.column("text").to_pylist())
                new = [pa.array(languages, pa.string()), *(pa.array(x, pa.float64()) for x in scores)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *new[: len(out)]], names=[*keep, *out])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(score, StructType([*fields, StructField(out[0], StringType()), *(StructField(c, DoubleType()) for c in out[1:])]))


def least_fit(predicted: DataFrame, label: str, language: str, fit: str, share: float) -> DataFrame:
    """Columns `language` and least: by predicted language, the fit (in eighths, rounded down) that at most `share` of the rows with any label are below."""
    labelled = predicted.filter(F.col(label).isNotNull()).groupBy(F.col(language), F.floor(F.col(fit) * 8).alias("eighths")).agg(F.count("*").alias("n"))
    each = Window.partitionBy(language)
    low = labelled.withColumns({"below": F.sum("n").over(each.orderBy("eighths")), "all": F.sum("n").over(each)}).filter(F.col("below") > share * F.col("all"))
    return low.groupBy(language).agg((F.min("eighths") / 8).alias("least"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the text and lang of rows that are not held out.

    lang, source and doc_id are no inputs of a prediction.  Rows without doc_id are
    predicted but not learned from; repeated rows are rows.
    """
    model = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, ["doc_id", "held_out"])
