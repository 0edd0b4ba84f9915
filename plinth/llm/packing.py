"""Packing documents into training sequences by first-fit decreasing.

Documents are dealt by a hash into slots of about GROUP_BYTES of text.  A task reads
its slots in order of another hash and packs group after group, each of a slot or,
where very many rows share a slot, of the next 2 * GROUP_BYTES of it; so what a task
holds is bounded whatever the corpus repeats.  A tournament tree over the bins' free
space finds the first bin that a piece fits.  Documents may be cut: whole sequences
first, then what is left of each document by first fit, then the emptiest bins are
cut up to fill the others, and the one bin that remains is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.arrays import slices
from plinth.llm.tokens import word_bpe

#: Bytes of text that make a group, about, and what a row counts besides its text.
GROUP_BYTES, ROW_BYTES = 8 << 20, 64
#: Pieces handed on at once, and bytes of their ids, about.
PIECES, PIECES_BYTES = 1024, 2 << 20

#: (document, start, length) of consecutive tokens.
Piece = tuple[int, int, int]


class Bins:
    """Free space of bins as the leaves of a tournament tree; inner nodes hold the larger of two."""

    def __init__(self, most: int, capacity: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.size)

    def take(self, length: int) -> int:
        """The first bin with room for `length`, which is taken from it."""
        tree, node = self.tree, 1
        while node < self.size:
            node *= 2
            if tree[node] < length:
                node += 1
        tree[node] -= length
        place = node - self.size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return place


def _cut(pieces: list[Piece], length: int) -> tuple[list[Piece], list[Piece]]:
    """The first `length` tokens of pieces, and the others."""
    head: list[Piece] = []
    for i, (doc, start, size) in enumerate(pieces):
        if size > length:
            return (head + [(doc, start, length)] if length else head), [(doc, start + length, size - length), *pieces[i + 1 :]]
        head.append((doc, start, size))
        length -= size
    return head, []


def pack_lengths(lengths: list[int], capacity: int = 4096) -> list[list[Piece]]:
    """Sequences of pieces of documents of the given lengths: full ones, and at last some that are powers of two.

    Every token is in exactly one piece; ties of length go by the document's place; lengths of 0 have no piece.
    """
    done = [[(doc, start, capacity)] for doc, n in enumerate(lengths) for start in range(0, n - capacity + 1, capacity)]
    rest = sorted(((n % capacity, doc) for doc, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    bins, held = Bins(len(rest), capacity), {}
    for n, doc in rest:
        held.setdefault(bins.take(n), []).append((doc, lengths[doc] - n, n))
    open_now = []
    for pieces in held.values():
        free = capacity - sum(p[2] for p in pieces)
        if free:
            open_now.append((free, pieces))
        else:
            done.append(pieces)
    open_now.sort(key=lambda x: (x[0], x[1]))
    low, spare = 0, []
    while low < len(open_now) or spare:
        if not spare:
            spare = open_now.pop()[1]  # the emptiest
            continue
        if low == len(open_now):
            break
        free, pieces = open_now[low]
        head, spare = _cut(spare, free)
        got = sum(p[2] for p in head)
        if got == free:
            done.append(pieces + head)
            low += 1
        else:
            open_now[low] = (free - got, pieces + head)
    left = sum(p[2] for p in spare)
    for bit in reversed(range(capacity.bit_length())):
        if left >> bit & 1:
            head, spare = _cut(spare, 1 << bit)
            done.append(head)
    return done


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, with_ids: bool = True, seed: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (null unless with_ids).

    A document's tokens are those of its whole text (null: none) and end_id.
    tokenizer: path of a vocabulary file, the same on all executors.  ids are
    unsigned 32-bit little-endian.  Rows that share a doc_id are packed as separate
    documents.  An empty table gives no rows; other columns are ignored.

    Slots are a hash of the row and of the partition it is read in: a partition
    that is made again has the same rows, and rows that are equal may swap places.
    So neither a doc_id of very many rows nor very many equal rows meet in a task.
    """
    docs = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    total = docs.agg(F.sum(size)).first()[0] or 0
    slots = max(1, round(total / GROUP_BYTES))
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    dealt = docs.select("doc_id", "text", key.alias("key"), F.spark_partition_id().alias("part")).withColumn("slot", F.pmod(F.xxhash64("key", "part"), F.lit(slots)))
    ordered = dealt.drop("part").repartition("slot").sortWithinPartitions("slot", "key", "doc_id", "text").select("slot", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def pieces(names: list[int | None], ids: list[np.ndarray], first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        """The sequences that a group makes, and their pieces; sequences are numbered from `first`."""
        sequences = pack_lengths([len(x) for x in ids], capacity)

        def rows() -> Iterator[tuple]:
            for i, sequence in enumerate(sequences):
                offset = 0
                for doc, start, n in sequence:
                    raw = ids[doc][start : start + n].astype("<u4").tobytes()
                    yield names[doc], start, n, zlib.crc32(raw), len(ids[doc]), first + i, offset, raw if with_ids else None
                    offset += n

        return len(sequences), _batches(rows(), schema)

    def pack_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_bpe(tokenizer), None
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        slot, held, made = None, 0, 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                for at, name, text, tokens in zip(part.column("slot").to_pylist(), part.column("doc_id").to_pylist(), texts, encode.encode(texts), strict=True):
                    if at != slot or held >= 2 * GROUP_BYTES:
                        if ids:
                            n, found = pieces(names, ids, (slot << 32) + made)
                            yield from found
                            made += n
                        if at != slot:
                            slot, made = at, 0
                        names, ids, held = [], [], 0
                    end = np.array(end_id, tokens.dtype) if end is None else end
                    names.append(name)
                    ids.append(np.append(tokens, end))
                    # Characters: a bound of the tokens, which are what is held.
                    held += len(text or "") + ROW_BYTES
        if ids:
            yield from pieces(names, ids, (slot << 32) + made)[1]

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return ordered.mapInArrow(pack_slots, kinds)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most PIECES; one that holds PIECES_BYTES of ids, in the last column, is handed on."""
    some: list[tuple] = []
    held = 0
    for row in rows:
        some.append(row)
        held += len(row[-1] or b"")
        if len(some) >= PIECES or held >= PIECES_BYTES:
            yield _batch(some, schema)
            some, held = [], 0
    if some:
        yield _batch(some, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
