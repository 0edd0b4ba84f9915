"""Removal of repeated word windows, found through anchors on a difference cover.

A window is `length` consecutive words of one text.  Anchors are shorter windows
of `length - period + 1` words that begin where the position modulo `period` is in
a difference cover: for any two positions i and j some shift d < period brings
both i + d and j + d onto the cover, so two equal windows, wherever they begin,
share an anchor that lies at the same place in both.

0. Texts that are equal as a whole are one text to the others, and all of their
   windows repeat.
1. Every text gives the hashes of its anchors; hashes met twice go back to
   their documents.
2. Only windows that hold such an anchor are extended to the full length and
   hashed whole (96 bits); those met twice go back as well.
3. Each text drops the words that these cover.

Before each exchange the repeats inside a task's slice are settled there: all
their places are known at once, and one row stands for them among the other
tasks, so that a passage of a third of all texts sends a row for a slice, not
one for each place.  The known places travel by document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.arrays import Words, byte_view, full, mix, slices, windows
from plinth.llm.common import cut

#: Perfect difference sets: every difference modulo the period occurs.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Hashes that a task remembers having announced as repeated.
REMEMBERED = 1 << 20


def cover(length: int) -> tuple[int, np.ndarray, int]:
    """Period, for each residue whether the cover has it, words of an anchor."""
    period = max((p for p in COVERS if length - p + 1 >= max(4, length * 2 // 5)), default=1)
    there = np.zeros(period, bool)
    there[list(COVERS.get(period, (0,)))] = True
    return period, there, length - period + 1


class Settled:
    """Splits the hashes of a slice into rows for the exchange and places already known to repeat."""

    def __init__(self) -> None:
        self.told = np.zeros(0, np.uint64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices of hashes met once; indices of repeated ones; of these, one each that is not announced yet."""
        order = np.argsort(hashes, kind="stable")
        found = hashes[order]
        same = found[1:] == found[:-1]
        repeat = np.zeros(len(found), bool)
        repeat[1:] |= same
        repeat[:-1] |= same
        lead = repeat.copy()
        lead[1:] &= ~same
        news = order[lead & ~np.isin(found, self.told)]
        if len(self.told) < REMEMBERED:
            self.told = np.union1d(self.told, hashes[news])
        return order[~repeat], order[repeat], news


def _positions(words: Words) -> np.ndarray:
    return np.arange(len(words)) - np.repeat(words.first[:-1], words.count)


def _anchors(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which anchors begin, and the anchors' hashes."""
    period, there, size = cover(length)
    at = full(words, size, np.flatnonzero(there[_positions(words) % period]))
    return at, windows(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)


def _rows(schema: pa.Schema, parts: list[dict]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n = len(part["doc_id"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) if part.get(f.name) is not None else pa.nulls(n, f.type) for f in schema], schema=schema)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _tags(texts: pa.Array) -> np.ndarray:
    data, offsets = byte_view(texts)
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)


def _with_copies(docs: DataFrame) -> DataFrame:
    """docs with copy, first: whether the whole text also is that of another row; of such rows, whether it has the least doc_id.

    Kept as digests of texts by doc_id, so that rows that share a doc_id stay apart.
    """
    digest = lambda: F.unhex(F.md5("text"))
    named = docs.select("doc_id", digest().alias("m")).filter("m is not null")
    # Written before it is joined: then rows of a text that very many documents have can be dealt to several tasks.
    classes = cut(named.groupBy("m").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).filter("rows > 1"))
    found = named.join(classes, "m").groupBy("doc_id").agg(F.collect_set("m").alias("ms"), F.collect_set(F.when(F.col("doc_id") == F.col("least"), F.col("m"))).alias("firsts"))
    has = lambda c: F.coalesce(F.array_contains(c, digest()), F.lit(False))
    return docs.join(found, "doc_id", "left").select(*docs.columns, has("ms").alias("copy"), has("firsts").alias("first"))


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, spans) of rows (doc_id, text, copy, first): for documents with windows that also begin elsewhere, the spans these cover.

    A span is struct(at long, n int): n windows in a row begin at word at >> 32;
    the low half of `at` is the CRC-32 of the text, which tells rows apart that
    share a doc_id.
    """
    # Copies of a whole text repeat everywhere; only the first speaks for them to other texts.
    # All of docs' columns are read everywhere, so that the exchange of texts by doc_id is one.
    docs = docs.filter("not copy or first").drop("first")
    first = pa.schema([("k", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int8())])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle = Settled()
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                at, hashes = _anchors(words, words.hashes(), length)
                ids = part.column("doc_id").to_numpy()[words.text_of()[at]]
                one, known, news = settle(hashes)
                # A document needs each repeated anchor once.
                known = known[np.unique(np.stack([ids[known].view(np.uint64), hashes[known]]), axis=1, return_index=True)[1]] if len(known) else known
                yield from _rows(first, [
                    {"k": _signed(hashes[one]), "doc_id": ids[one], "n": np.ones(len(one), np.int8)},
                    {"k": _signed(hashes[news]), "doc_id": ids[news], "n": np.full(len(news), 2, np.int8)},
                    {"k": _signed(mix(ids[known].astype(np.uint64))), "h": _signed(hashes[known]), "doc_id": ids[known], "n": np.zeros(len(known), np.int8)},
                ])

    # One exchange and one sort: the sum over a hash's rows tells whether it was met twice.
    met = docs.drop("copy").mapInArrow(anchors, "k long, h long, doc_id long, n tinyint").withColumn("c", F.sum("n").over(Window.partitionBy("k")))
    shared = met.filter("n = 0 or n = 1 and c > 1").select("doc_id", F.coalesce("h", "k").alias("h"))
    lists = shared.groupBy("doc_id").agg(F.collect_list("h").alias("hs"))

    second = pa.schema([("k", pa.int64()), ("x", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
    period = cover(length)[0]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle = Settled()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                words = Words(texts)
                hashes = words.hashes()
                at, found = _anchors(words, hashes, length)
                lists = part.column("hs")
                flat = lists.flatten().to_numpy()
                sizes = np.diff(lists.offsets.to_numpy())
                # An anchor counts if it is on its own document's list: (document, hash) as one mixed key.
                owner = np.repeat(np.arange(part.num_rows, dtype=np.uint64), sizes)
                text = words.text_of()
                key = lambda h, t: mix(h + (t + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                hit = at[np.isin(key(found, text[at].astype(np.uint64)), key(flat.view(np.uint64).copy(), owner))]
                # Windows that begin up to period - 1 words before such an anchor hold it.
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, np.maximum(hit - period + 1, words.first[text[hit]]), 1)
                np.add.at(step, hit + 1, -1)
                begin = full(words, length, np.flatnonzero(np.cumsum(step[:-1])))
                if not len(begin):
                    continue
                whole = windows(hashes, length)[begin]
                other = windows(words.hashes(1), length)[begin] >> np.uint64(32)
                ids = part.column("doc_id").to_numpy()[text[begin]]
                counts = np.where(part.column("copy").to_numpy(zero_copy_only=False), 2, 1).astype(np.int32)[text[begin]]
                places = ((begin - words.first[text[begin]]) << 32) | _tags(texts)[text[begin]]
                one, known, news = settle(whole ^ mix(other.copy()))
                known.sort()
                # Neighbouring known windows of a document make one row.
                begins = begin[known]
                edge = np.flatnonzero(np.append(True, (np.diff(begins) != 1) | (np.diff(text[begins]) != 0))) if len(known) else known
                runs = np.diff(np.append(edge, len(known))).astype(np.int32)
                lead = known[edge]
                yield from _rows(second, [
                    {"k": _signed(whole[one]), "x": _signed(other[one]), "doc_id": ids[one], "at": places[one], "n": counts[one]},
                    {"k": _signed(whole[news]), "x": _signed(other[news]), "doc_id": ids[news], "n": np.full(len(news), 2, np.int32)},
                    {"k": _signed(mix(ids[lead].astype(np.uint64))), "doc_id": ids[lead], "at": places[lead], "n": -runs},
                ])

    joined = docs.join(lists, "doc_id")
    met = joined.mapInArrow(candidates, "k long, x long, doc_id long, at long, n int").withColumn("c", F.sum("n").over(Window.partitionBy("k", "x")))
    spans = met.filter("n < 0 or n = 1 and c > 1").select("doc_id", "at", F.abs("n").alias("n"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def drop_repeated(docs: DataFrame, length: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by spaces).

    A word goes if a window of `length` words that covers it also begins anywhere
    else, the same document included.  Windows are those of the input.  A null
    text has no words; rows without a doc_id are places and results like others;
    rows that share a doc_id are separate places, so repeated rows repeat each
    other's windows.  Empty tables give no rows; other columns are ignored.
    """
    # Rows without a doc_id go by a hash of the text: one that another row has as well is told apart like any shared doc_id.
    docs = _with_copies(docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), "text"))
    spans = _repeated_spans(docs, length)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, nameless, text, copy, found in zip(*(batch.column(c) for c in ("doc_id", "nameless", "text", "copy", "spans")), strict=True):
                raw = (text.as_py() or "").encode()
                words = raw.split()
                kept = words
                if copy.as_py():
                    kept = words if len(words) < length else []
                elif found.is_valid:
                    places = found.values
                    at, n = (places.field(i).to_numpy() for i in (0, 1))
                    mine = (at & 0xFFFFFFFF) == zlib.crc32(raw)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, at[mine] >> 32, 1)
                    np.add.at(step, (at[mine] >> 32) + n[mine] + length - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    kept = [words[i] for i in np.flatnonzero(~gone)]
                joined = b" ".join(kept)
                out.append((None if nameless.as_py() else doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]))

    return docs.join(spans, "doc_id", "left").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
